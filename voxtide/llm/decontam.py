"""Benchmark decontamination by a BM25 inverted index and block-max WAND.

The test items are the indexed side and every passage of every training text
is a query.  Impacts are BM25 weights divided by the item's score against
itself, so an item's score for a passage is 1 when the passage holds all of
it.  A posting list keeps its largest impact, and the largest of each block of
items that it reaches.  A passage whose terms' largest impacts reach the
threshold is searched: cursors over the posting lists stand in order of item,
the *pivot* is the first item whose bound reaches the threshold, lists skip to
it if the block's bound does too and beyond the block if not.  All items at or
above the threshold are retrieved.  Each retrieved pair is then verified: the
item's question (its first sentences) and answer (its last) must both lie in
the text, in order, word for word but for a small share.

The index is made by Spark: document frequencies, mean length and longest item
come from all items, and the postings are dealt to shards of bounded size, each
built in a task.  A pass over the texts holds several shards, as broadcasts of
bounded size in all, and a text's words are told apart once for them; where
the items need more passes, what a pass found is stored and its broadcasts are
let go before the next begins.  As nothing but the postings depends on the
shard, the results are the same for any number of shards and passes.

Rows: null and empty texts give no pairs; texts are read whole, as windows
that overlap by more than the longest item; items without words are never
found, nor are null items; an item id that comes with several texts is found
by any of them, with its best overlaps, repeated rows are found once; rows of
docs that repeat give a row each, a null id is an id.  Other columns of docs
pass through ``clean`` whatever their names.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from voxtide.llm.common import alone, arrow_schema, record_batch, stored, unused

#: Postings of one broadcast shard: about 60 MB of a task's and of the driver's memory.
SHARD_POSTINGS = 500_000
#: Shards of one pass over the texts, about 250 MB of a task's and of the driver's memory.
PASS_SHARDS = 4
BLOCK, K1, B, THRESHOLD = 4, 1.2, 0.3, 0.5
#: Entries of a shard's table of block bounds that is kept beside the lists, 16 MB.
TABLE = 2_000_000
#: Room for rounding in comparisons with a threshold.
NONE = 1e-9
#: Share of an item's question and of its answer that must be found.
OVERLAP, ANSWER_OVERLAP = 0.7, 0.5
#: Words in a run that counts as found.
RUN = 5
_WORDS = re.compile(r"[^\W_]+").findall
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """All sentences but the last, and the last; the whole text twice if it is one sentence."""
    parts = [p for p in _SENTENCE.split(text.strip()) if words(p)]
    if len(parts) < 2:
        return words(text), words(text)
    return words(" ".join(parts[:-1])), words(parts[-1])


def runs(tokens: list[str], size: int) -> set[tuple[str, ...]]:
    size = min(size, len(tokens))
    return set(zip(*(tokens[k:] for k in range(size)), strict=False)) if tokens else set()


@dataclass
class Index:
    """Postings of one shard, a list after another: item numbers and impacts, and the largest impact of each block that a list reaches."""

    ids: list
    texts: list[str]
    terms: dict[str, int]
    start: np.ndarray  # of each term's postings, and the end of all
    items: np.ndarray
    impacts: np.ndarray
    block_start: np.ndarray
    blocks: np.ndarray
    block_tops: np.ndarray
    top: np.ndarray  # per term; one more entry, 0, for words of no item
    longest: int
    table: np.ndarray | None = None  # the blocks' largest impacts, terms x blocks, where that is small

    @classmethod
    def build(cls, rows: list[tuple], longest: int) -> Index:
        """From (item, text, terms, impacts before division) of each item."""
        terms: dict[str, int] = {}
        term, impact = [], []
        for _, _, own, raw in rows:
            term += [terms.setdefault(w, len(terms)) for w in own]
            impact += list(np.array(raw) / sum(raw))
        owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        term, impact = np.array(term, np.int64), np.array(impact)
        order = np.lexsort((owner, term))
        term, owner, impact = term[order], owner[order], impact[order]
        start = np.searchsorted(term, np.arange(len(terms) + 1))
        key = term * (len(rows) // BLOCK + 1) + owner // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        tops = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0)
        top = np.append(np.maximum.reduceat(impact, start[:-1]) if len(terms) else np.zeros(0), 0.0)
        n = len(rows) // BLOCK + 1
        made = cls([r[0] for r in rows], [r[1] for r in rows], terms, start, owner.astype(np.int32), impact, np.searchsorted(term[first], np.arange(len(terms) + 1)), (owner[first] // BLOCK).astype(np.int32), tops, top, longest)
        if len(terms) * n <= TABLE:
            made.table = np.zeros((len(terms), n))
            made.table[term[first], made.blocks] = tops
        return made

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Index:
        """One shard of all items, without Spark."""
        bags = [Counter(words(t)) for t in texts]
        sizes = [sum(b.values()) for b in bags]
        df = Counter(w for b in bags for w in b)
        used = [i for i, n in enumerate(sizes) if n]
        mean = float(np.mean([sizes[i] for i in used] or [1]))
        rows = [(ids[i], texts[i], sorted(bags[i]), [weight(bags[i][w], df[w], len(used), sizes[i], mean) for w in sorted(bags[i])]) for i in used]
        return cls.build(rows, max(sizes, default=1))

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """Of each block, the sum of the query terms' largest impacts in it."""
        if self.table is not None:
            return self.table[query].sum(0)
        parts = [slice(self.block_start[t], self.block_start[t + 1]) for t in query]
        return np.bincount(np.concatenate([self.blocks[p] for p in parts]), np.concatenate([self.block_tops[p] for p in parts]))

    def retrieve(self, query: np.ndarray, threshold: float = THRESHOLD) -> list[int]:
        """Numbers of the items whose score for the distinct query terms reaches the threshold (block-max WAND)."""
        limit = threshold - NONE
        if self.top[query].sum() < limit:
            return []
        good = self.bounds(query) >= limit
        if not good.any():
            return []
        good = good.tolist()
        lists = [self.items[self.start[t] : self.start[t + 1]].tolist() for t in query]
        at, top, found = [0] * len(lists), self.top[query].tolist(), []
        live = list(range(len(lists)))
        while True:
            live = sorted((k for k in live if at[k] < len(lists[k])), key=lambda k: lists[k][at[k]])
            bound, pivot = 0.0, -1
            for j, k in enumerate(live):
                bound += top[k]
                if bound >= limit:
                    pivot = j
                    break
            if pivot < 0:
                return found
            item = lists[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            block, below = item // BLOCK, live[: pivot + 1]
            if not good[block]:
                to = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    to = min(to, lists[live[pivot + 1]][at[live[pivot + 1]]])
            elif lists[live[0]][at[live[0]]] == item:
                if sum(self.impacts[self.start[query[k]] + at[k]] for k in below) >= limit:
                    found.append(item)
                to = item + 1
            else:
                to = item
            for k in below:
                at[k] = bisect_left(lists[k], to, at[k])

    def passages(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Windows of twice the longest item, half overlapping, whose distinct terms' bounds sum to the threshold."""
        step, n = self.longest, len(numbers)
        last = max(0, -(-(n - step) // step) - 1)  # the last window that is not inside the one before
        at = np.flatnonzero(numbers < len(self.terms))
        if not len(at):
            return []
        term = numbers[at]
        order = np.argsort(term, kind="stable")
        before = np.full(len(at), -1)
        same = term[order][1:] == term[order][:-1]
        before[order[1:][same]] = at[order[:-1][same]]
        bound = np.zeros(last + 2)
        top = self.top[term]
        # a place lies in the window of its step and in the one before; a term counts where it is first in a window
        for window in (np.minimum(at // step, last + 1), at // step - 1):
            first = (before < window * step) & (window >= 0) & (window <= last)
            bound += np.bincount(window[first], top[first], last + 2)
        return [(int(w) * step, min(n, int(w) * step + 2 * step)) for w in np.flatnonzero(bound[: last + 1] >= THRESHOLD - NONE)]

    def verify(self, item: int, tokens: list[str]) -> tuple[float, float]:
        """Share of the question's and of the answer's word runs that the passage holds in order."""
        out = []
        for part in question_and_answer(self.texts[item]):
            wanted = runs(part, RUN)
            have = runs(tokens, min(RUN, len(part)) or 1)
            out.append(len(wanted & have) / len(wanted) if wanted else 0.0)
        return out[0], out[1]

    def matches(self, tokens: list[str]) -> dict:
        """Item id to (question overlap, answer overlap) of the verified items of a text with these words, best window each."""
        get, none = self.terms.get, len(self.terms)
        numbers = np.fromiter(map(get, tokens, repeat(none)), np.int64, len(tokens))
        out: dict = {}
        for start, end in self.passages(numbers):
            query = np.unique(numbers[start:end])
            for item in self.retrieve(query[query < none]):
                question, answer = self.verify(item, tokens[start:end])
                if question >= OVERLAP and answer >= ANSWER_OVERLAP:
                    out[self.ids[item]] = max(out.get(self.ids[item], (0.0, 0.0)), (question, answer))
        return out


def weight(count: int, df: int, n: int, size: int, mean: float) -> float:
    """BM25 weight of a term in an item."""
    idf = float(np.log(1 + (n - df + 0.5) / (df + 0.5))) + 0.05
    return idf * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))


def shards(items: DataFrame, item_col: str = "item_id", text_col: str = "text", postings: int = SHARD_POSTINGS) -> DataFrame:
    """shard, index (a pickled Index): the index of all items with words, in parts of about so many postings."""
    usable = items.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    schema = StructType([StructField("item", items.schema[item_col].dataType), *StructType.fromDDL("text string, size int, bag map<string,int>")])
    kinds = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [(own, text, Counter(words(text))) for own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield record_batch([(own, text, sum(b.values()), sorted(b.items())) for own, text, b in bags if b], kinds)

    bags = stored(usable.mapInArrow(count, schema), "item-bags")
    whole = bags.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.max("size").alias("longest"), F.sum(F.size("bag")).alias("postings")).first()
    n, mean, longest, parts = whole["n"], whole["mean"], whole["longest"], 1 + (whole["postings"] or 0) // postings
    each = bags.select("item", "text", "size", F.explode("bag").alias("term", "count"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) + 0.05
    raw = idf * F.col("count") * (K1 + 1) / (F.col("count") + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
    weighed = each.join(df, "term").groupBy("item", "text").agg(F.sort_array(F.collect_list(F.struct("term", raw.alias("raw")))).alias("bag"))
    dealt = weighed.select(F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("shard"), "item", "text", "bag.term", "bag.raw")
    made = arrow_schema("shard int, index binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and shard != now:
                    yield record_batch([(now, pickle.dumps(Index.build(rows, longest)))], made)
                    rows = []
                now = shard
                rows.append(tuple(row))
        if rows:
            yield record_batch([(now, pickle.dumps(Index.build(rows, longest)))], made)

    return dealt.repartition(int(parts), "shard").sortWithinPartitions("shard", "item", "text").mapInArrow(build, "shard int, index binary")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", postings: int = SHARD_POSTINGS) -> DataFrame:
    """(id, item_id, question_overlap, answer_overlap) of every text and test item that it holds."""
    spark = docs.sparkSession
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("item_id", items.schema[item_col].dataType), *StructType.fromDDL("question_overlap double, answer_overlap double")])
    kinds = arrow_schema(schema)

    def search(held: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            alone("decontam")
            indexes = [pickle.loads(h.value) for h in held]
            for batch in batches:
                rows = []
                for own, text in zip(batch.column(0), batch.column(1), strict=True):
                    tokens, own = words(text.as_py() or ""), own.as_py()
                    rows += [(own, item, q, a) for index in indexes for item, (q, a) in sorted(index.matches(tokens).items())]
                if rows:
                    yield record_batch(rows, kinds)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    made = stored(shards(items, item_col, text_col, postings), "index")
    numbers = [r["shard"] for r in made.select("shard").orderBy("shard").collect()]
    passes = [numbers[i : i + PASS_SHARDS] for i in range(0, len(numbers), PASS_SHARDS)]
    out = spark.createDataFrame([], schema)
    for shard_numbers in passes:
        held = [spark.sparkContext.broadcast(bytes(r["index"])) for r in made.where(F.col("shard").isin(shard_numbers)).orderBy("shard").toLocalIterator()]
        found = search(held)
        if len(passes) > 1:
            found = stored(found, "found")
            for one in held:
                one.destroy()
        out = found if shard_numbers is passes[0] else out.unionAll(found)
    return out


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones; a text is dropped with its id and hash, found pairs are few beside docs."""
    (row,) = unused(docs.columns, "row")
    own = F.xxhash64(F.col(id_col), F.col(text_col))
    bad = contaminated(docs.select(own.alias(row), text_col), items, row, text_col).select(row).distinct()
    return docs.join(bad, own == F.col(row), "left_anti")
