"""Operators over the whole corpus against brute force, and their edge cases."""

import glob
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import xxhash

import corpus_pipeline
from voxtide.functions.tables import shared_folder
from voxtide.llm import bagminhash, decontam, gam, linedup, pitman_yor, queries
from voxtide.llm.common import crc_fold

SMALL = "/root/testdata/sf0.01"
LONG = "aword bword\n" * 20_000 + "x" * 50_000
EDGE = [(1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (3, "two words", "b"), (None, "no id", "b"), (9, LONG, "c"), (8, LONG + " y", "c"), (10, " \n ", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, node string")


def bag(text):
    words = text.lower().split()
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def jaccard(a, b):
    same = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - same
    return same / total if total else 0.0


def brute_classes(docs):
    """doc_id to least doc_id of its class, from all pairs that share a shingle."""
    first, bags, index, up = {}, {}, {}, {}
    for own, text in docs:
        first.setdefault(text, own)
        up[own] = own

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for text, own in first.items():
        bags[own] = bag(text)
        for s in bags[own]:
            index.setdefault(s, []).append(own)
    pairs = {(a, b) for v in index.values() for i, a in enumerate(v) for b in v[:i]}
    for a, b in pairs:
        if top(a) != top(b) and jaccard(bags[a], bags[b]) >= 0.8:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {own: top(first[text]) for own, text in docs}


def near_data():
    """Hubs whose copies are alike the hub but not each other, chains, exact copies, repeats and unrelated texts."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    docs = []
    for _ in range(4):
        hub = [word() for _ in range(150)]
        for _ in range(25):
            copy = list(hub)
            for k in rng.choice(150, 3, replace=False):
                copy[k] = word()
            docs.append(" ".join(copy))
        docs.append(" ".join(hub))
        chain = list(hub)
        for k in range(0, 120, 12):
            chain[k], chain[k + 1] = word(), word()
            docs.append(" ".join(chain))
    docs += ["same line again " * k for k in (50, 52, 60, 200)] + ["few words", "few words", "Few  Words", "", ""]
    docs += [" ".join(word() for _ in range(60)) for _ in range(40)]
    order = rng.permutation(len(docs))
    return [(int(i), docs[j]) for i, j in enumerate(order)]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 60).astype(np.uint64)
    for high in (2, 40):
        a, b = rng.integers(1, high, 40), rng.integers(1, high, 40)
        x, y = (np.sort(keys[:40]), a), (np.sort(keys[20:60]), b)
        one, other = bagminhash.signatures([x, y], 4096)
        true = bagminhash.similarity(bagminhash.pack(*x), bagminhash.pack(*y))
        assert abs((one == other).mean() - true) < 5 * math.sqrt(true * (1 - true) / 4096)
    assert np.isinf(bagminhash.signatures([(np.zeros(0, np.uint64), np.zeros(0, int))], 8)).all()


def test_near_classes_on_hubs_and_chains(spark):
    docs = near_data()
    got = bagminhash.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(docs)


def test_stragglers_of_a_hot_group(spark, monkeypatch):
    """Copies of one text with many edits each, some shared: most are apart from it and from each other, some are alike in pairs; blocks are small."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    hub, docs = [word() for _ in range(150)], []
    for _ in range(120):
        copy = [w for k, w in enumerate(hub) if k not in set(rng.choice(150, int(rng.integers(1, 12)), replace=False))]
        docs.append(" ".join(copy))
        if rng.random() < 0.3:
            copy[int(rng.integers(len(copy)))] = word()
            docs.append(" ".join(copy))
        if rng.random() < 0.2:
            docs.append(" ".join(copy[: int(len(copy) * rng.uniform(0.5, 1))]))
    docs = list(enumerate(docs))
    monkeypatch.setattr(bagminhash, "BLOCK_BYTES", 20_000)
    got = bagminhash.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in got} == want and 5 < len(set(want.values())) < len(docs) - 20


def test_recall_by_similarity(spark):
    """Of planted copies with 1 to 14 words changed, those at 0.8 or more are classed with their text, the others are not."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    rows, alike = [], {}
    for k in range(80):
        base = list(rng.choice(words, 150))
        rows.append((1000 * k, " ".join(base)))
        for n in range(1, 15):
            copy = list(base)
            at = int(rng.integers(0, 150 - n))
            copy[at : at + n] = [f"x{k}_{n}_{j}" for j in range(n)]
            rows.append((1000 * k + n, " ".join(copy)))
            alike[1000 * k + n] = jaccard(bag(rows[-1][1]), bag(" ".join(base)))
    got = {r.doc_id: r.class_id for r in bagminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i for i, s in alike.items() if s >= 0.8]
    assert len(near) > 300 and len({round(alike[i], 2) for i in near}) >= 5
    assert np.mean([got[i] == got[i // 1000 * 1000] for i in near]) >= 0.99
    assert got == brute_classes(rows)


def test_op2(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r.class_id for r in queries.op2_near_dedup(spark, SMALL).collect()}
    assert got == brute_classes(docs)


def test_near_classes_edge_rows(spark, edge):
    got = bagminhash.near_classes(edge).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted([("1", "1"), ("2", "1"), ("3", "3"), ("3", "3"), ("3", "3"), ("None", "None"), ("9", "8"), ("8", "8"), ("10", "10")])
    assert bagminhash.near_classes(edge.limit(0)).count() == 0


def test_spelling_sums_to_one():
    words = [b"abc", b"abd", b"", b"b", b"abc"]
    levels, symbols, _ = pitman_yor.contexts(words)
    keys, counts = np.unique(levels[3] * pitman_yor.SYMBOLS + symbols, return_counts=True)
    spelling = pitman_yor.Spelling.sample(keys, counts)
    # of every start, the words that end there and the starts one byte longer share its probability
    for context in (b"", b"a", b"ab", b"zz"):
        shared = np.zeros(spelling.masses[0].shape[0])
        levels, _, _ = pitman_yor.contexts([context + b"x"])
        at = len(context)
        for symbol in range(pitman_yor.SYMBOLS):
            prob = np.full(len(shared), 1 / pitman_yor.SYMBOLS)
            for level in range(4):
                room = levels[level][at]
                dish = np.flatnonzero(spelling.dishes[level] == room * pitman_yor.SYMBOLS + symbol)
                mass = spelling.masses[level][:, dish[0]] if len(dish) else 0.0
                there = np.flatnonzero(spelling.rooms[level] == room)
                prob = mass + (spelling.weights[level][:, there[0]] if len(there) else 1.0) * prob
            shared += prob
        assert shared == pytest.approx(np.ones(len(shared)), abs=1e-5)


def test_op5(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    counts, got = Counter(), queries.op5_pitman_yor(spark, SMALL).collect()
    for own, text in docs.items():
        if crc_fold(own, 10):
            counts.update([*split(text), b""])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for r in got:
        own = [*split(docs[r.doc_id]), b""]
        assert r.held_out == (crc_fold(r.doc_id, 10) == 0) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(own), sum(w in counts for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_do_not_depend_on_partitions(spark):
    found = []
    for n in (2, 4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(n)
        found.append(sorted(map(tuple, pitman_yor.score(docs, pitman_yor.train(docs.where("doc_id % 3 > 0"))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] == found[2]


def test_pitman_yor_words_in_context(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 97) for _ in range(30)] + [None, "", "w1 w2 w1 w2 w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter()
    for text in texts:
        own = [b"", *pitman_yor.tokens(text or ""), b""]
        counts.update(zip(own, own[1:], strict=False))
    for bucket_tokens in (100, 10**6):
        monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", bucket_tokens)
        model = pitman_yor.train(docs)
        seats = {bytes(r.word): r for r in model.seats.collect()}
        word_of = {int(pitman_yor.hashed([w])[0]): w for w in seats}
        assert 0 < len(model.rooms.hot) < len(seats) and (model.rooms.buckets > 1) == (bucket_tokens == 100)
        found, mass, tables = {}, {}, np.zeros(pitman_yor.SAMPLES)
        for r in model.pairs.collect():
            u, w, c = np.frombuffer(r.u, np.uint64), np.frombuffer(r.w, np.uint64), np.frombuffer(r.c, np.int32)
            t = pitman_yor.tables_of(c, np.frombuffer(r.t, np.int32))
            assert (t >= 1).all() and (t <= c).all()
            tables += t.sum(1)
            for a, b, n, mean in zip(u.tolist(), w.tolist(), c.tolist(), t.mean(0), strict=True):
                pair = word_of[a], word_of[b]
                assert pair not in found
                found[pair] = n
                mass[pair] = (n - model.pair_discount * mean) / (pitman_yor.PAIR_STRENGTH + seats[pair[0]].c)
        assert found == counts and model.customers == tables.tolist()
        unknown = 10 ** model.unknown()
        for u in seats:  # the words and the outcome of all others share a context's probability
            assert sum(mass.get((u, w), 0) + seats[u].b * seats[w].p for w in seats) + seats[u].b * unknown == pytest.approx(1, abs=1e-6)
        asked = spark.createDataFrame([*enumerate(texts), (90, "w1 w2 new w3 w3"), (91, "w3 w3 new w2 w1")], "doc_id long, text string")
        got = {r.doc_id: r.score for r in pitman_yor.score(asked, model).collect()}
        for own, text in [*enumerate(texts), (90, "w1 w2 new w3 w3"), (91, "w3 w3 new w2 w1")]:
            line = [b"", *pitman_yor.tokens(text or ""), b""]
            wanted = sum(math.log10(mass.get((u, w), 0) + (seats[u].b if u in seats else 1) * (seats[w].p if w in seats else unknown)) for u, w in zip(line, line[1:], strict=False))
            assert got[own] == pytest.approx(wanted, rel=1e-5)
        assert got[90] != pytest.approx(got[91], rel=1e-3)


def test_pitman_yor_pairs_are_small(spark):
    before = set(glob.glob(f"{shared_folder(spark)}/pairs-*"))
    model = pitman_yor.train(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    (folder,) = set(glob.glob(f"{shared_folder(spark)}/pairs-*")) - before
    pairs = sum(len(r.c) // 4 for r in model.pairs.collect())
    assert sum(p.stat().st_size for p in Path(folder).glob("*.parquet")) < 8 * pairs


def test_pitman_yor_blocks(spark, monkeypatch):
    texts = [f"w{i % 7} x{i % 5} w{i % 3} \u00e4{i}" for i in range(40)] + [None, "", "w1 w2 w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, "doc_id")
    trains, found = F.col("doc_id") % 3 > 0, []
    for tokens in (9, 10**6):
        monkeypatch.setattr(pitman_yor, "HELD_TOKENS", tokens)
        blocks = pitman_yor.encode(docs, trains)
        assert (blocks.count() > 10) == (tokens == 9)
        found.append(sorted(map(tuple, pitman_yor.score_blocks(blocks, pitman_yor.fit(blocks)).collect())))
    apart = sorted(map(tuple, pitman_yor.score(docs, pitman_yor.train(docs.where(trains))).collect()))
    assert found[0] == found[1] == apart and len(apart) == len(texts)


def test_op5_known_words_above_base(spark):
    rows = [r for r in queries.op5_pitman_yor(spark, SMALL).collect() if r.held_out and r.n_known == r.n_tokens]
    assert len(rows) > 10 and sum(r.open_score for r in rows) > sum(r.base_score for r in rows)


def test_pitman_yor_edge_rows(spark, edge):
    model = pitman_yor.train(edge.where("doc_id <> 9"))
    got = pitman_yor.score(edge, model).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").split()) + 1 for _, t, _ in EDGE)
    assert all(math.isfinite(r.score) for r in got)
    assert pitman_yor.score(edge.limit(0), model).count() == 0
    empty = pitman_yor.score(edge, pitman_yor.train(edge.limit(0))).collect()
    assert len(empty) == len(EDGE) and all(math.isfinite(r.score) and r.n_known == 0 for r in empty)


def scores_by_hand(items, query):
    """BM25 of each item for a set of words over its score for itself, 0 for items without words."""
    bags = [Counter(decontam.words(t)) for t in items]
    used = [b for b in bags if b]
    mean, df = np.mean([sum(b.values()) for b in used]), Counter(w for b in used for w in b)

    def of(b, chosen):
        norm = decontam.K1 * (1 - decontam.B + decontam.B * sum(b.values()) / mean)
        return sum((math.log(1 + (len(used) - df[w] + 0.5) / (df[w] + 0.5)) + 0.05) * c * (decontam.K1 + 1) / (c + norm) for w, c in b.items() if w in chosen)

    return [of(b, query) / of(b, b) if b else 0.0 for b in bags]


def test_wand_equals_scoring_all():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(vocabulary, 12)) for _ in range(100)]
    index = decontam.Index.of(list(range(100)), texts)
    for _ in range(200):
        chosen = set(rng.choice(vocabulary, 15))
        query = np.unique([index.terms[w] for w in chosen])
        score = np.array(scores_by_hand(texts, chosen))
        for threshold in (0.3, 0.5):
            assert index.retrieve(query, threshold) == np.flatnonzero(score >= threshold - 1e-9).tolist()


def matches_by_hand(text, items):
    """Every window against every item by its score, then the overlaps."""
    tokens, longest = decontam.words(text), max(len(decontam.words(t)) for _, t in items)
    index = decontam.Index.of([i for i, _ in items], [t for _, t in items])
    found = {}
    for start in range(0, max(1, len(tokens)), longest):
        part = tokens[start : start + 2 * longest]
        for k, score in enumerate(scores_by_hand([t for _, t in items], set(part))):
            if score >= decontam.THRESHOLD - 1e-9:
                question, answer = index.verify(k, part)
                if question >= decontam.OVERLAP and answer >= decontam.ANSWER_OVERLAP:
                    found[items[k][0]] = max(found.get(items[k][0], (0, 0)), (question, answer))
        if start + 2 * longest >= len(tokens):
            break
    return found


def test_decontamination_is_the_same_in_shards(spark):
    small = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    held = [(r.item_id, r.text) for r in items.orderBy("item_id").collect()]
    planted = spark.createDataFrame([(-1 - i, f"before it {t} and after") for i, (_, t) in enumerate(held[:40])], "doc_id long, text string")
    docs = docs.select("doc_id", "text").orderBy("doc_id").limit(60).unionAll(planted)
    one, two, many = (sorted(map(tuple, decontam.contaminated(docs, items, postings=n).collect())) for n in (500_000, 900, 150))  # the last in several passes
    assert one == two == many and decontam.shards(items, postings=150).count() >= 8 > decontam.shards(items, postings=900).count() >= 2
    wanted = [(r.doc_id, i, q, a) for r in docs.collect() for i, (q, a) in matches_by_hand(r.text or "", held).items()]
    assert one == sorted(wanted) and len(one) >= 40


def test_op9(spark):
    docs = [(r.doc_id, decontam.words(r.text or "")) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, decontam.words(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap) for r in queries.op9_decontamination(spark, SMALL).collect()}
    whole = {(d, i) for d, t in docs for i, w in items if f" {' '.join(w)} " in f" {' '.join(t)} "}
    assert whole and whole <= set(got)
    grams = {d: decontam.runs(t, 5) for d, t in docs}
    for own, item in set(got) - whole:  # found otherwise: most of the item's runs stand in the text
        wanted = decontam.runs(dict(items)[item], 5)
        assert len(wanted & grams[own]) / len(wanted) > 0.6
    held = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for own in {d for d, _ in got}:  # every overlap of every text with a match, against all items
        if len(texts[own]) < 20_000:
            assert {i: got[own, i] for d, i in got if d == own} == matches_by_hand(texts[own], held)


def test_decontamination_edge_rows(spark, edge):
    items = spark.createDataFrame([(1, "aword bword aword bword aword bword"), (2, None), (3, ""), (None, "x"), (4, "Never seen. At all.")], "item_id long, text string")
    got = decontam.contaminated(edge, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(8, 1), (9, 1)]
    assert decontam.contaminated(edge.limit(0), items).count() == 0
    assert decontam.contaminated(edge, items.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in decontam.clean(edge, items).collect()) == sorted(str(r[0]) for r in EDGE if r[0] not in (8, 9))


def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    text = {r.doc_id: r.text for r in docs}
    for r in got.values():
        lines = text[r.doc_id].split("\n")
        left = iter(lines)
        assert all(x in left for x in r.text.split("\n") if x)  # lines only go, in order
        assert r.round_trip and r.n_chars == len(r.text) and r.source and r.lang
    assert len({r.text for r in got.values()}) == len(got)  # no equal texts
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    assert not any(i in r.text for r in got.values() for i in items)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert np.mean([labels[d] for d in got if d in labels]) > 0.97
    assert public_tokenizers.PATTERN


def key_of(own, text):
    """Order of documents: a null id first, then ids, then Spark's hash of the text."""
    hashed = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return (own is not None, own or 0, hashed - (hashed >> 63 << 64))


def brute_lines(docs):
    """The documents (id, text, source and others) without boilerplate lines."""
    sites, first = {}, {}
    split = lambda text: [] if text is None else text.split("\n")
    for own, text, source, *_ in docs:
        for at, line in enumerate(split(text)):
            if line.strip(" "):
                sites.setdefault(line, set()).add(source)
                first[line] = min(first.get(line, (key_of(own, text), at)), (key_of(own, text), at))
    bad = {x for x in sites if len(sites[x] - {None}) >= linedup.MIN_SITES}
    keep = lambda own, text: text and "\n".join(x for at, x in enumerate(text.split("\n")) if x not in bad or first[x] == (key_of(own, text), at))
    return [(own, keep(own, text), *more) for own, text, *more in docs]


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    small, folder = "/root/testdata/sf0.001", str(tmp_path)
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars").orderBy("doc_id")
    docs = [tuple(r) for r in table.collect()]
    for k in range(1, len(docs)):
        own, text, *more = docs[k]
        if k % 4 == 1:
            text = f"{text}\nA footer of every site."
        docs[k] = ({1: None, 3: docs[k - 1][0]}.get(k % 8, own), text, *more)
    docs += [docs[1], docs[3], docs[9], (None, None, "s", "en", 0), (None, "", "s", "en", 0)]
    spark.createDataFrame(docs, table.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    got = [(r.doc_id, r.text, r.source, r.lang) for r in corpus_pipeline.run(spark, folder).collect()]

    model = queries.quality_model(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    good = [d for d, s in zip(docs, model.score(np.array([gam.text_features(d[1] or "") for d in docs])), strict=True) if s >= corpus_pipeline.KEEP]
    lined = brute_lines(good)
    classes = brute_classes(sorted((key_of(d[0], d[1]), d[1] or "") for d in lined))
    single = {key_of(d[0], d[1]): d for d in sorted(lined, key=repr) if classes[key_of(d[0], d[1])] == key_of(d[0], d[1])}
    items = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id", "text").collect()
    index = decontam.Index.of([r.item_id for r in items], [r.text for r in items])
    wanted = [(own, text, source, lang) for own, text, source, lang, _ in single.values() if not index.matches(decontam.words(text or ""))]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    ids = Counter(r[0] for r in wanted)
    assert ids[None] > 3 and any(n > 1 for own, n in ids.items() if own is not None)
    assert any(a[1] != b[1] for a, b in zip(good, lined, strict=True) if a[0] is None)
