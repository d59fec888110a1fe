"""The corpus queries: each applies one operator, with its production settings, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm import bagminhash, bpe, chat, decontam, exactdedup, gam, linedup, merkle, negatives, pitman_yor, secrets, toxicity, vafile
from voxtide.llm.common import discard, fold

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip of every document."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encode_digests(documents(spark, sf_dir), vocab, public_tokenizers.PATTERN)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and same_text of every document."""
    return bagminhash.near_classes(documents(spark, sf_dir))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return merkle.compare_with_next(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = fold("doc_id", 5) == 0
    model = toxicity.train(docs, "toxic", labels=labels.where(~held))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, token counts, base and model log10 probability, and perplexity of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = fold("doc_id", 10) == 0
    blocks = pitman_yor.encode(docs, ~held)
    model = pitman_yor.fit(blocks)
    scored = pitman_yor.score_blocks(blocks, model)
    discard(model.seated)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "open_score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return secrets.digests(secrets.scan(docs, secrets.train(docs)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the cleaned text of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return linedup.remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = gam.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> gam.Gam:
    """The additive model, from the labelled documents outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return gam.train(docs, "quality", labels=labels.where(fold("doc_id", 4) != 2))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and overlaps of every benchmark item found in a document."""
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from its tokens, and of conversation -1, whose texts are control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    vocab = bpe.vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return chat.read_back(turns.unionAll(extra), vocab, public_tokenizers.PATTERN).drop("n_tokens", "loss_tokens")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_va_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, inertia and centroid of every vector of 64 components."""
    return vafile.cluster(embeddings(spark, sf_dir))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document; texts are read once and not shuffled."""
    digests = documents(spark, sf_dir).select("doc_id", exactdedup.digest(F.col("text")).alias("text_sha256"))
    return exactdedup.mark(digests).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among the embeddings."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0, label=label)


ALL = (op1_byte_bpe, op2_near_dedup, op3_merkle, op4_toxicity, op5_pitman_yor, op6_secrets, op7_line_dedup, op8_quality, op9_decontamination, op10_chat, op11_va_centroids, op12_exact_dedup, op13_hard_negatives)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}


def _centroids_sql(rounds: int) -> str:
    """Plain assignment and means, round by round."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    parts = [
        """
with v as (
  select vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
first_ones as (select vec_id, x, sha256('1:' || vec_id::varchar) as h from v where vec_id is not null order by h limit 16),
c0 as (select row_number() over (order by h) - 1 as cluster, x from first_ones)"""
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} as (select v.vec_id, arg_min(c.cluster, ({distance}, c.cluster)) as cluster, min({distance}) as distance, any_value(v.x) as x from v, c{k} c group by v.vec_id)")
        if k < rounds:
            parts.append(f"""s{k} as (
  select cluster, place, sum(value)::bigint as s, count(*) as n
  from (select cluster, unnest(x) as value, generate_subscripts(x, 1) as place from a{k}) group by cluster, place),
m{k} as (select cluster, list((s - ((s % n) + n) % n) // n order by place) as x from s{k} group by cluster),
c{k + 1} as (select c.cluster, coalesce(m.x, c.x) as x from c{k} c left join m{k} m on c.cluster = m.cluster)""")
    last = f"""
select a.vec_id, a.cluster::int as cluster, a.distance, (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia,
  (sum(a.distance) over ())::bigint as inertia, sha256(list_aggregate(c.x, 'string_agg', ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.cluster = c.cluster"""
    return ",\n".join(parts) + last


ORACLES: dict[str, str] = {
    "op7_line_dedup": """
with l as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from documents),
boilerplate as (
  select line, min((doc_id, place)) as first from l where trim(line) <> '' group by line having count(distinct source) >= 10),
marked as (select l.*, b.line is not null and (l.doc_id, l.place) <> b.first as gone from l left join boilerplate b on l.line = b.line)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
  coalesce(string_agg(line, chr(10) order by place) filter (not gone), '') as text
from marked group by doc_id""",
    "op10_chat": r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
t as (
  select *, case when role = 'assistant' then text else '' end as lost,
    replace(replace(role, '%', '%25'), chr(10), '%0A') as line,
    length('<|im_start|>') + length('<|im_end|>') + 2 as marks,
    len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) as escapes
  from said)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
  sum(length(lost))::bigint as loss_chars, sha256(string_agg(lost, '' order by turn, role)) as loss_sha256,
  sum(marks + length(line) + length(text) + escapes)::bigint as formatted_chars
from t group by conv_id""",
    "op11_va_centroids": _centroids_sql(rounds=3),
    "op12_exact_dedup": """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256
from t window w as (partition by text)""",
    "op13_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda e: floor(256 * e::double)) as x
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same, list_dot_product(a.x, r.x)::bigint as score
  from v a join v r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over w as int) as rank, s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)
qualify row_number() over w <= 10""",
}
