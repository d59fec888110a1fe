"""Language-model scores by a hierarchical Pitman-Yor process.

Every word (a run of bytes other than white space, A-Z in lower case) has a
restaurant, and so has the start of a text.  The customers of a word's
restaurant are the tokens that follow it, its dishes words and one end per
text; its parent is the top restaurant, whose customers are the tables of all
of them.  The top restaurant's tables send one customer each to the spelling
restaurants, which generate a word byte by byte: the restaurant of the last
three bytes has that of the last two as its parent, then that of the last one,
then one for all, then a uniform base.  Contexts that differ only in older
bytes share parents, and a word never seen still has the probability of its
spelling.

Seating is sampled by Gibbs: a dish's customers leave and are seated again one
block at a time, each opening a table in proportion to the strength of the
parent and joining one in proportion to its discounted size.  Words are seated
by their tokens first, which gives the pairs of neighbours their parent; the
pairs are seated, and the words again by the tables of the pairs.  Words and
pairs are seated in Spark, where they lie; the spelling restaurants, bounded
by the number of byte contexts and not by the corpus, on the driver.
Predictive probabilities are averaged over the samples kept, level by level.

Texts are split once, into blocks of numbered words.  Counts come from all
training texts.  Pairs lie in buckets by the first word, so that a restaurant
is seated whole; those of the few words that are a large share of the corpus
are spread over all buckets.  A block sends a bucket its distinct pairs, as
places in sorted lists of hashes.  To score, each block asks for its distinct
words and pairs in the same way, and their answers meet the block again, so no
text is shuffled and no vocabulary is broadcast or collected.  Words in pairs,
and pairs, are told apart by 64-bit hashes.

``score`` has one outcome for all words without customers, as the base score
has: its probability is what is left of a new table's after the known words'
spellings.  ``open_score`` spells each of those words instead.

Rows: a null text counts as empty and has the end alone; long texts are one
block each; rows repeat as they are; without training texts the base is
uniform over one word and the model is its spelling base.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from voxtide.llm import common
from voxtide.llm.common import arrow_schema, discard, mix

#: Symbols of the spelling model: bytes and the end of a word (also the mark before its start).
SYMBOLS, MARK = 257, 256
#: How far the second and third last byte are told apart: with these there are at most 257 * 16 * 8 contexts.
CLASSES = (16, 8)
SWEEPS, SAMPLES = 12, 4
STRENGTH, DISCOUNTS, WORD_STRENGTH = 1.0, (0.2, 0.5, 0.7, 0.8), 50.0
#: Customers are seated in blocks of this share of those seated before.
BLOCK_SHARE = 1 / 16
#: Distinct words, about, that are seated together; the buckets follow from the words alone.
BUCKET_WORDS = 32_768
#: Strength of the restaurants of words, and the sweeps over them up to the first sample; each later sample is a sweep further on.
PAIR_STRENGTH, PAIR_SWEEPS = 1.0, 3
#: Tokens of a block of texts; training tokens, about, whose pairs lie in a bucket.
HELD_TOKENS, BUCKET_TOKENS = 4_000_000, 2_000_000
#: Words that are more than this share of the corpus are spread over the buckets.
HOT_SHARE = 1 / 256

#: Spark then deletes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """As common.stored; of what was shuffled to make the table nothing stays."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return common.stored(df, name)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def tokens(text: str) -> list[bytes]:
    """The words; the end is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def contexts(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(context number of each symbol at levels 0 to 3, symbols, first symbol of each word)."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.full(int(size.sum()) + 4 * len(words), MARK, np.int64)
    start = np.concatenate([[0], np.cumsum(size + 4)[:-1]]) if len(words) else np.zeros(0, np.int64)
    letters = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(len(letters)) + np.repeat(4 * np.arange(len(words)) + 3, size)
    flat[at] = letters
    used = np.ones(len(flat), bool)
    for k in range(3):
        used[start + k] = False
    here = np.flatnonzero(used)
    one, two, three = flat[here - 1], flat[here - 2] % CLASSES[0], flat[here - 3] % CLASSES[1]
    second = one * CLASSES[0] + two
    levels = [np.zeros(len(here), np.int64), one, second, second * CLASSES[1] + three]
    first = start - 3 * np.arange(len(words))
    return levels, flat[here], first


def seat(customers: np.ndarray, before: np.ndarray, strength: float, discount: float, parent: np.ndarray, rng) -> np.ndarray:
    """Tables of each dish after its customers are seated anew, ``before`` being its restaurant's tables of other dishes."""
    seated = np.minimum(customers, 1)
    tables = seated.astype(float)
    live = np.flatnonzero(customers > 1)
    while len(live):
        n, t = seated[live], tables[live]
        block = np.minimum(np.maximum(1, (n * BLOCK_SHARE).astype(np.int64)), customers[live] - n)
        new = (strength + discount * (before[live] + t)) * parent[live]
        opened = rng.binomial(block, new / (new + n - discount * t))
        tables[live] += opened
        seated[live] += block
        live = live[seated[live] < customers[live]]
    return tables


@dataclass
class Spelling:
    """Averaging samples of the spelling restaurants: per level, dish keys and masses, context keys and back-off weights."""

    dishes: list[np.ndarray]
    masses: list[np.ndarray]  # samples x dishes
    rooms: list[np.ndarray]
    weights: list[np.ndarray]  # samples x contexts
    _deepest: tuple | None = field(default=None, repr=False)

    @classmethod
    def sample(cls, keys: np.ndarray, counts: np.ndarray, seed: int = 11, sweeps: int = SWEEPS, samples: int = SAMPLES) -> Spelling:
        """Gibbs over all levels; keys are context * SYMBOLS + symbol of the deepest level, counts its customers."""
        rng = np.random.default_rng(seed)
        order = np.argsort(keys)
        dishes, up = [keys[order]], []
        shrink = [CLASSES[1], CLASSES[0], SYMBOLS]
        for by in shrink:
            room, symbol = dishes[0] // SYMBOLS, dishes[0] % SYMBOLS
            parents, to = np.unique((room // by) * SYMBOLS + symbol, return_inverse=True)
            dishes.insert(0, parents)
            up.insert(0, to)
        rooms, room_of = zip(*(np.unique(d // SYMBOLS, return_inverse=True) for d in dishes), strict=True)
        customers = [None, None, None, counts[order].astype(np.int64)]
        tables = [None, None, None, np.minimum(customers[3], 1).astype(float)]
        for level in (2, 1, 0):
            customers[level] = np.bincount(up[level], tables[level + 1], len(dishes[level])).astype(np.int64)
            tables[level] = np.minimum(customers[level], 1).astype(float)
        kept: list[tuple[list, list]] = []

        def predictive():
            masses, weights, probs = [], [], []
            for level in range(4):
                total = np.bincount(room_of[level], customers[level], len(rooms[level])) + STRENGTH
                opened = np.bincount(room_of[level], tables[level], len(rooms[level]))
                mass = (customers[level] - DISCOUNTS[level] * tables[level]) / total[room_of[level]]
                weight = (STRENGTH + DISCOUNTS[level] * opened) / total
                below = probs[-1][up[level - 1]] if level else np.full(len(dishes[0]), 1 / SYMBOLS)
                masses.append(mass)
                weights.append(weight)
                probs.append(mass + weight[room_of[level]] * below)
            return masses, weights, probs

        for sweep in range(sweeps):
            _, _, probs = predictive()
            for level in (3, 2, 1, 0):
                opened = np.bincount(room_of[level], tables[level], len(rooms[level]))
                others = opened[room_of[level]] - tables[level]
                parent = probs[level - 1][up[level - 1]] if level else np.full(len(dishes[0]), 1 / SYMBOLS)
                tables[level] = seat(customers[level], others, STRENGTH, DISCOUNTS[level], parent, rng)
                if level:
                    customers[level - 1] = np.bincount(up[level - 1], tables[level], len(dishes[level - 1])).astype(np.int64)
            if sweep >= sweeps - samples:
                kept.append(predictive()[:2])
        stack = lambda part, level: np.stack([k[part][level] for k in kept]).astype(np.float32)
        return cls(dishes, [stack(0, i) for i in range(4)], list(rooms), [stack(1, i) for i in range(4)])

    def deepest(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each dish of the deepest level by its key, -1 for others; logarithms of the dishes' probabilities, samples x dishes)."""
        if self._deepest is None:
            prob = self.masses[0] + self.weights[0][:, np.searchsorted(self.rooms[0], self.dishes[0] // SYMBOLS)].astype(float) / SYMBOLS
            for level, by in ((1, SYMBOLS), (2, CLASSES[0]), (3, CLASSES[1])):
                room, symbol = self.dishes[level] // SYMBOLS, self.dishes[level] % SYMBOLS
                up = np.searchsorted(self.dishes[level - 1], room // by * SYMBOLS + symbol)
                prob = self.masses[level] + self.weights[level][:, np.searchsorted(self.rooms[level], room)] * prob[:, up]
            place = np.full(SYMBOLS * CLASSES[0] * CLASSES[1] * SYMBOLS, -1, np.int32)
            place[self.dishes[3]] = np.arange(len(self.dishes[3]))
            self._deepest = place, np.log(prob)
        return self._deepest

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's spelling, samples x words."""
        if not words or not len(self.dishes[3]):
            return self.by_levels(words)
        place, logs = self.deepest()
        levels, symbols, first = contexts(words)
        at = place[levels[3] * SYMBOLS + symbols]
        out = np.add.reduceat(logs[:, at], first, axis=1)
        odd = np.flatnonzero(np.minimum.reduceat(at, first) < 0)
        out[:, odd] = self.by_levels([words[i] for i in odd])
        return out

    def by_levels(self, words: list[bytes]) -> np.ndarray:
        """The same for words whose symbols need not be dishes of the deepest level."""
        n = self.masses[0].shape[0]
        if not words:
            return np.zeros((n, 0))
        levels, symbols, first = contexts(words)
        prob = np.full((n, len(symbols)), 1 / SYMBOLS)
        for level, room in enumerate(levels):
            if not len(self.dishes[level]):
                continue
            key = room * SYMBOLS + symbols
            at = np.minimum(np.searchsorted(self.dishes[level], key), len(self.dishes[level]) - 1)
            mass = np.where(self.dishes[level][at] == key, self.masses[level][:, at], 0.0)
            there = np.minimum(np.searchsorted(self.rooms[level], room), len(self.rooms[level]) - 1)
            weight = np.where(self.rooms[level][there] == room, self.weights[level][:, there], 1.0)
            prob = mass + weight * prob
        return np.add.reduceat(np.log(prob), first, axis=1)


ZSTD = pa.Codec("zstd", 1)


def packed(x: np.ndarray) -> bytes:
    """How many numbers, and the planes of their bytes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + ZSTD.compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(ZSTD.decompress(data[8:], n * size, asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def packed_hashes(x: np.ndarray) -> bytes:
    """Sorted hashes, by their differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def each(batches: Iterator[pa.RecordBatch] | list[pa.Table], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(map(lambda x: x.as_py(), batch.column(name)) for name in names), strict=True)


class Numbers(dict):
    """Words in the order in which they were met first."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Columns of a block of texts besides its number and the ids of its texts, packed: whether texts train, their tokens; lengths and bytes of the block's words, common ones first, and their training tokens; the texts' tokens as places among the words.
PARTS = ("trains", "sizes", "lengths", "words", "counts", "tokens")


def encode(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of texts, stored: block, ids and PARTS.  A block is numbered by its task, whose rows must come in the same order if it is run again, as those of files do."""
    schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(docs.schema[id_col].dataType)), *(StructField(x, BinaryType()) for x in PARTS)])
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, flags, held, numbers, size = TaskContext.get().partitionId() << 32, [], [], [], Numbers({b"": 0}), 0

        def pack() -> pa.RecordBatch:
            at, trained, sizes = np.concatenate(held), np.array(flags, np.uint8), np.array([len(x) for x in held], np.int32)
            order = np.argsort(-np.bincount(at), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            words = list(numbers)
            words, at = [words[i] for i in order], rank[at]
            counts = np.bincount(at[np.repeat(trained, sizes) > 0], minlength=len(words))
            parts = (trained, sizes, np.array([len(x) for x in words], np.int32), np.frombuffer(b"".join(words), np.uint8), counts, at)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, ids, *map(packed, parts)), shape, strict=True)], schema=shape)

        for batch in batches:
            for own, text, flag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = [*tokens(text.as_py() or ""), b""]
                ids.append(own)
                flags.append(bool(flag))
                held.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(held[-1])
                if size >= HELD_TOKENS:
                    yield pack()
                    block, ids, flags, held, numbers, size = block + 1, [], [], [], Numbers({b"": 0}), 0
        if held:
            yield pack()

    return stored(docs.select(F.col(id_col), F.col(text_col), trains).mapInArrow(run, schema), "blocks")


def words_of(lengths: bytes, words: bytes) -> pa.Array:
    """The words of a block."""
    ends = np.cumsum(np.append(np.int32(0), unpacked(lengths, np.int32)), dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(unpacked(words, np.uint8))]).cast(pa.binary())


def word_counts(blocks: DataFrame) -> DataFrame:
    """word binary, c long over the training texts; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lengths, words, counts in each(batches, "lengths", "words", "counts"):
            c = unpacked(counts, np.int64)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(c > 0)) for x in (words_of(lengths, words), pa.array(c))], ["word", "n"])

    return blocks.select("lengths", "words", "counts").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of words, as Spark's xxhash64 makes them."""
    return np.fromiter((xxhash.xxh64_intdigest(word, 42) for word in words), np.uint64, len(words))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs, from those of their words."""
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(0x9FB21C651E98DF25) + second)


@dataclass
class Rooms:
    """Where pairs lie: the number of buckets, and the words spread over all of them (in order), with their training tokens."""

    buckets: int
    hot: np.ndarray
    tokens: np.ndarray

    def is_hot(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is spread, and its place among those that are."""
        if not len(self.hot):
            return np.zeros(len(first), bool), np.zeros(len(first), np.int64)
        at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
        return self.hot[at] == first, at

    def bucket(self, first: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return (np.where(self.is_hot(first)[0], pair, first) % np.uint64(self.buckets)).astype(np.int32)


@dataclass
class Pairs:
    """Distinct pairs in order: the first words' hashes (in order) and how many pairs each has; the hashes of second words (in order) and the place there of each pair's; counts."""

    u: np.ndarray
    n: np.ndarray
    w: np.ndarray
    at: np.ndarray
    c: np.ndarray

    @classmethod
    def of(cls, u: np.ndarray, w: np.ndarray, key: np.ndarray, c: np.ndarray) -> Pairs:
        """From hashes in order, and places in u and w, in order, as key."""
        there, n = np.unique(key >> np.uint64(32), return_counts=True)  # w can hold more than is used
        used, at = np.unique(key & np.uint64(0xFFFFFFFF), return_inverse=True)
        return cls(u[there], n.astype(np.int32), w[used], at.astype(np.int32), c.astype(np.int32))

    @classmethod
    def read(cls, row: tuple) -> Pairs:
        u, n, w, at, c = row
        return cls(unpacked_hashes(u), unpacked(n, np.int32), unpacked_hashes(w), unpacked(at, np.int32), unpacked(c, np.int32))

    def row(self) -> tuple:
        return packed_hashes(self.u), packed(self.n), packed_hashes(self.w), packed(self.at), packed(self.c)

    def room(self) -> np.ndarray:
        """Place of each pair's first word."""
        return np.repeat(np.arange(len(self.u)), self.n)

    def key(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Places of the pairs' words in other lists, given those of u and w; in order if the lists are."""
        return np.repeat(u.astype(np.uint64), self.n) << np.uint64(32) | w.astype(np.uint64)[self.at]


#: Columns of Pairs.
PAIRS = ("u", "n", "w", "at", "c")
PAIRS_TYPE = ", ".join(f"{x} binary" for x in PAIRS)


@dataclass
class Dealt:
    """Distinct pairs of a block by bucket and pair: hashes of its words in order, places there as keys, counts, and where buckets begin and end."""

    hashes: np.ndarray
    key: np.ndarray
    n: np.ndarray
    buckets: np.ndarray
    cut: list[tuple[int, int]]
    pair_of: np.ndarray | None = None  # of each token

    @classmethod
    def out(cls, hashes: np.ndarray, at: np.ndarray, used: np.ndarray | None, rooms: Rooms, asks: bool = False) -> Dealt:
        """From the hashes of the block's words and the tokens, of which those used count; asks: with pair_of."""
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        hashes, second = hashes[order], rank[at]
        key = np.roll(second, 1) << np.uint64(32) | second  # before a text stands the end of another
        pair_of = None
        if asks:
            key, pair_of, n = np.unique(key, return_inverse=True, return_counts=True)
        else:
            key, n = np.unique(key if used is None else key[used], return_counts=True)
        u, w = hashes[key >> np.uint64(32)], hashes[key & np.uint64(0xFFFFFFFF)]
        bucket = rooms.bucket(u, joined(u, w))
        order = np.argsort(bucket.astype(np.int16) if rooms.buckets < 1 << 15 else bucket, kind="stable")
        if asks:
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            pair_of = place[pair_of]
        key, n, bucket = key[order], n[order], bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        return cls(hashes, key, n, bucket[first], list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True)), pair_of)


def pair_mail(blocks: DataFrame, rooms: Rooms, training: bool) -> DataFrame:
    """bucket, block and PAIRS: each block's distinct pairs, of training texts or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, trains, sizes, lengths, words, at in each(batches, "block", "trains", "sizes", "lengths", "words", "tokens"):
            used = np.repeat(unpacked(trains, np.uint8) > 0, unpacked(sizes, np.int32)) if training else None
            if training and not used.any():
                continue
            dealt = Dealt.out(hashed(words_of(lengths, words).to_pylist()), unpacked(at, np.int32), used, rooms)
            for bucket, (i, j) in zip(dealt.buckets, dealt.cut, strict=True):
                row = Pairs.of(dealt.hashes, dealt.hashes, dealt.key[i:j], dealt.n[i:j]).row()
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((bucket, block, *row), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], ["bucket", "block", *PAIRS])

    return blocks.select("block", "trains", "sizes", "lengths", "words", "tokens").mapInArrow(run, f"bucket int, block long, {PAIRS_TYPE}")


def pair_counts(blocks: DataFrame, rooms: Rooms) -> DataFrame:
    """bucket and PAIRS of the training texts; once, twice count those pairs."""

    def count(rows: pa.Table) -> pa.Table:
        cells = [Pairs.read(x) for x in each([rows], *PAIRS)]
        u, w = (np.unique(np.concatenate([getattr(x, name) for x in cells])) for name in ("u", "w"))
        key = np.concatenate([x.key(np.searchsorted(u, x.u), np.searchsorted(w, x.w)) for x in cells])
        order = np.argsort(key)
        key, n = key[order], np.concatenate([x.c for x in cells])[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        c = np.add.reduceat(n, first)
        row = Pairs.of(u, w, key[first], c).row()
        return pa.table([rows.column("bucket")[:1], *(pa.array([x], pa.binary()) for x in row), *(pa.array([int(x)]) for x in ((c == 1).sum(), (c == 2).sum()))], names=["bucket", *PAIRS, "once", "twice"])

    return pair_mail(blocks, rooms, True).drop("block").groupBy("bucket").applyInArrow(count, f"bucket int, {PAIRS_TYPE}, once long, twice long")


def seat_pairs(pairs: DataFrame, known: DataFrame, rooms: Rooms, discount: float) -> DataFrame:
    """bucket, PAIRS and t (packed int32, samples x pairs of several customers; others have one table), given the words' probabilities (h, p) in the parent."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, n in each(batches, "u", "n"):
            is_hot, at = rooms.is_hot(unpacked_hashes(u))
            yield pa.RecordBatch.from_arrays([pa.array(at[is_hot].astype(np.int32)), pa.array(unpacked(n, np.int32)[is_hot].astype(np.int64))], ["at", "n"])

    outside = np.zeros(len(rooms.hot))
    for r in pairs.select("u", "n").mapInArrow(sizes, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        outside[r["at"]] = r["n"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, w, at, c in each(batches, "bucket", "w", "at", "c"):
            asked = np.unique(unpacked(at, np.int32)[unpacked(c, np.int32) > 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), bucket, np.int32)), pa.array(unpacked_hashes(w)[asked].view(np.int64))], ["bucket", "h"])

    def run(own: pa.Table, parents: pa.Table) -> pa.Table:
        pairs = Pairs.read(next(each([own], *PAIRS)))
        room, c = pairs.room(), pairs.c.astype(np.int64)
        again = np.flatnonzero(c > 1)  # one customer has one table
        p = np.zeros(len(pairs.w))
        p[np.searchsorted(pairs.w, parents.column("h").to_numpy().view(np.uint64))] = parents.column("p").to_numpy()
        parent = p[pairs.at[again]]
        is_hot, place = rooms.is_hot(pairs.u)
        others = np.where(is_hot, outside[place] - pairs.n, 0.0) if len(outside) else np.zeros(len(pairs.u))
        rng = np.random.default_rng([own.column("bucket")[0].as_py(), 3])
        samples, t, room_again, c_again = [], np.ones(len(c)), room[again], c[again]
        for sweep in range(PAIR_SWEEPS + SAMPLES - 1):
            opened = np.bincount(room, t) + others
            t[again] = seat(c_again, opened[room_again] - t[again], PAIR_STRENGTH, discount, parent, rng)
            if sweep >= PAIR_SWEEPS - 1:
                samples.append(t[again].astype(np.int32))
        return pa.table([*(own.column(x) for x in ("bucket", *PAIRS)), pa.array([packed(np.concatenate(samples))], pa.binary())], names=["bucket", *PAIRS, "t"])

    asked = pairs.select("bucket", "w", "at", "c").mapInArrow(ask, "bucket int, h long").join(known, "h")
    own = pairs.select("bucket", *PAIRS)
    return own.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, f"bucket int, {PAIRS_TYPE}, t binary")


def numbered(name: str) -> list[str]:
    """Columns of the samples."""
    return [f"{name}{i}" for i in range(SAMPLES)]


def tables_of(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """samples x pairs, from the tables of pairs of several customers."""
    out = np.ones((SAMPLES, len(c)), np.int32)
    out[:, c > 1] = t.reshape(SAMPLES, -1)
    return out


def plain(seated: DataFrame) -> DataFrame:
    """bucket, u, w (hashes), c and t of the pairs, as bytes of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, *row, t in each(batches, "bucket", *PAIRS, "t"):
            pairs = Pairs.read(row)
            columns = (pairs.u[pairs.room()], pairs.w[pairs.at], pairs.c, unpacked(t, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["bucket", "u", "w", "c", "t"])

    return seated.mapInArrow(run, "bucket int, u binary, w binary, c binary, t binary")


def tables_of_words(seated: DataFrame) -> DataFrame:
    """h, r (tables in the word's own restaurant, on average) and k0, ... (tables that serve it in all restaurants, of each sample)."""
    named = numbered("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *row, t in each(batches, *PAIRS, "t"):
            pairs = Pairs.read(row)
            t = tables_of(pairs.c, unpacked(t, np.int32))
            h = np.union1d(pairs.u, pairs.w)
            r, k = np.zeros(len(h)), np.zeros((SAMPLES, len(h)), np.int32)
            r[np.searchsorted(h, pairs.u)] = np.bincount(pairs.room(), t.mean(0))
            k[:, np.searchsorted(h, pairs.w)] = [np.bincount(pairs.at, x) for x in t]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), r, *k)], ["h", "r", *named])

    return seated.select(*PAIRS, "t").mapInArrow(run, ", ".join(["h long", "r double", *(f"{x} int" for x in named)])).groupBy("h").agg(F.sum("r").alias("r"), *(F.sum(x).alias(x) for x in named))


def spelling_counts(words: DataFrame, tables: str) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the deepest spelling dishes, given the words' tables: at most 257 * 16 * 8 * 257 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                levels, symbols, first = contexts(batch.column(0).to_pylist())
                weight = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff([*first, len(symbols)]))
                keys, at = np.unique(levels[3] * SYMBOLS + symbols, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, weight).astype(np.int64))], ["key", "n"])

    counted = words.select("word", F.col(tables).cast("long")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


@dataclass
class Model:
    """Spelling restaurants and the top restaurant's totals; the seats of words and pairs stay in the tables ``seats`` and ``pairs``."""

    spelling: Spelling
    seats: DataFrame  # word, c, p (averaged predictive probability in the top restaurant), b (weight of the top restaurant behind the word's own)
    train_tokens: int
    distinct: int
    discount: float
    tables: list[float]  # of each sample
    known: list[float]  # spelling probability of all words with customers, of each sample
    customers: list[float]  # of the top restaurant, of each sample
    seated: DataFrame | None = None  # bucket, PAIRS, t
    pairs: DataFrame | None = None  # the same, plain
    rooms: Rooms | None = None
    pair_discount: float = 0.0

    def share(self) -> np.ndarray:
        """Probability of a new table in the top restaurant, of each sample."""
        return (WORD_STRENGTH + self.discount * np.array(self.tables)) / (WORD_STRENGTH + np.array(self.customers))

    def unknown(self) -> float:
        """log10 probability, in the top restaurant, that a token is any word without customers."""
        return float(np.log10(np.mean(self.share() * np.maximum(1e-12, 1 - np.array(self.known)))))

    def unseen(self, spelled: np.ndarray) -> np.ndarray:
        """log10 probability of words without customers, from their spelling (samples x words)."""
        with np.errstate(divide="ignore"):
            return np.logaddexp.reduce(spelled + np.log(self.share())[:, None], axis=0) / math.log(10) - math.log10(len(self.tables))


def estimated(once: int, twice: int) -> float:
    """Discount by the numbers of dishes with one and with two customers."""
    return min(0.95, max(0.1, (once + 1) / (once + 2 * twice + 2)))


def train(texts: DataFrame) -> Model:
    """Count, seat and sample over the training texts (text)."""
    blocks = encode(texts.select(F.lit(0).alias("id"), "text"), F.lit(True), "id")
    model = fit(blocks)
    discard(blocks)
    return model


def fit(blocks: DataFrame) -> Model:
    """The same from encoded texts, of which those that train count."""
    spark = blocks.sparkSession
    words = stored(word_counts(blocks), "words")
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v = total["n"] or 0, total["v"]
    discount = estimated(total["once"], total["twice"])
    spelling = Spelling.sample(*spelling_counts(words.withColumn("t", F.lit(1)), "t"))
    frequent = sorted((int(hashed([bytes(r["word"])])[0]), r["c"]) for r in words.where(F.col("c") > n * HOT_SHARE).collect())
    rooms = Rooms(1 + n // BUCKET_TOKENS, np.array([h for h, _ in frequent], np.uint64), np.array([c for _, c in frequent], float))

    def seated(words: DataFrame, spelling: Spelling, tables: list[float], salt: int) -> DataFrame:
        """words (word, c and the customers of each sample, k0, ..., or of all, k0) with t and s, of each sample."""
        held, columns = spark.sparkContext.broadcast(spelling), words.columns
        given = [x for x in columns if x.startswith("k")]

        def run(rows: pa.Table) -> pa.Table:
            # a bucket holds the same words in the same order whatever the partitions, so its draws are the same
            rows = rows.sort_by("word")
            own, bucket = rows.column("word").to_pylist(), rows.column("bucket")[0].as_py()
            k = [rows.column(x).to_numpy() for x in given]
            rng = np.random.default_rng([bucket, salt])
            spelled = held.value.log_probability(own)
            customers = [k[min(i, len(k) - 1)] for i in range(len(tables))]
            t = [seat(c, np.full(len(c), max(0.0, whole - 1.0)), WORD_STRENGTH, discount, np.exp(s), rng) for c, s, whole in zip(customers, spelled, tables, strict=True)]
            made = [*(pa.array(x.astype(np.int64)) for x in t), *(pa.array(x.astype(np.float32)) for x in spelled)]
            return pa.table([*(rows.column(x) for x in columns), *made], names=[*columns, *numbered("t"), *numbered("s")])

        dealt = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(1 + v // BUCKET_WORDS)).cast("int"))
        schema = ", ".join([*(f"{x} {kind}" for x, kind in words.dtypes), *(f"{x} long" for x in numbered("t")), *(f"{x} float" for x in numbered("s"))])
        return stored(dealt.groupBy("bucket").applyInArrow(run, schema), "seats")

    def summed(frame: DataFrame, *columns: Column) -> list[list[float]]:
        row = [float(x) for x in frame.agg(*(F.sum(x) for x in columns)).first()]
        return [row[i : i + SAMPLES] for i in range(0, len(row), SAMPLES)]

    def predictive(i: int, customers: Column, tables: list[float], total: float) -> Column:
        return (customers - discount * F.col(f"t{i}") + (WORD_STRENGTH + discount * tables[i]) * F.exp(f"s{i}")) / (WORD_STRENGTH + total)

    def averaged(each: list[Column]) -> Column:
        return sum(each[1:], each[0]) / SAMPLES

    if not v:
        none = spark.createDataFrame([], f"bucket int, {PAIRS_TYPE}, t binary")
        seats = words.select("word", "c", F.lit(1.0).alias("p"), F.lit(1.0).alias("b"))
        return Model(spelling, seats, n, v, discount, [0.0] * SAMPLES, [0.0] * SAMPLES, [0.0] * SAMPLES, none, plain(none), rooms)
    first = seated(words.select("word", "c", F.col("c").alias("k0")), spelling, [float(v)] * SAMPLES, 1)
    (tables,) = summed(first, *map(F.col, numbered("t")))
    counted = stored(pair_counts(blocks, rooms), "pair-counts")
    once, twice = counted.agg(F.sum("once"), F.sum("twice")).first()
    pair_discount = estimated(once, twice)
    parents = first.select(F.xxhash64("word").alias("h"), averaged([predictive(i, F.col("c"), tables, n) for i in range(SAMPLES)]).alias("p"))
    pairs = stored(seat_pairs(counted, parents, rooms, pair_discount), "pairs")
    discard(counted)
    spelling = Spelling.sample(*spelling_counts(first, numbered("t")[-1]))
    last = seated(words.withColumn("h", F.xxhash64("word")).join(tables_of_words(pairs), "h").select("word", "c", "r", *numbered("k")), spelling, tables, 2)
    discard(first, words)
    # probabilities are summed as whole numbers, so that the order of the parts does not tell
    tables, customers, known = summed(last, *map(F.col, (*numbered("t"), *numbered("k"))), *((F.exp(x) * 2.0**60).cast("long") for x in numbered("s")))
    known = [x / 2.0**60 for x in known]
    probable = [predictive(i, F.col(f"k{i}"), tables, customers[i]) for i in range(SAMPLES)]
    behind = (PAIR_STRENGTH + pair_discount * F.col("r")) / (PAIR_STRENGTH + F.col("c"))
    return Model(spelling, last.select("word", "c", averaged(probable).alias("p"), behind.alias("b")), n, v, discount, tables, known, customers, pairs, plain(pairs), rooms, pair_discount)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score and open_score (log10) of every text."""
    return score_blocks(encode(docs, F.lit(False), id_col, text_col), model, id_col)


def pair_masses(blocks: DataFrame, model: Model) -> DataFrame:
    """block, bucket, mass: for a block's pairs there, discounted shares in the first word's restaurant (packed float32), 0 for pairs without customers."""
    rooms, discount = model.rooms, model.pair_discount

    def reply(asked: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            *row, t = next(each([own], *PAIRS, "t"))
            pairs = Pairs.read(row)
            room = pairs.room()
            t = tables_of(pairs.c, unpacked(t, np.int32)).mean(0)
            is_hot, place = rooms.is_hot(pairs.u)
            total = np.bincount(room, pairs.c)
            total = np.where(is_hot, rooms.tokens[place], total) if len(rooms.hot) else total
            mass = ((pairs.c - discount * t) / (PAIR_STRENGTH + total[room])).astype(np.float32)
            key = pairs.key(np.arange(len(pairs.u)), np.arange(len(pairs.w)))
        for row in each([asked], *PAIRS):
            cell = Pairs.read(row)
            found = np.zeros(len(cell.at), np.float32)
            if own.num_rows:
                u, w = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((pairs.u, cell.u), (pairs.w, cell.w)))
                wanted = cell.key(u, w)
                there = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                same = (key[there] == wanted) & np.repeat(pairs.u[u] == cell.u, cell.n) & (pairs.w[w] == cell.w)[cell.at]
                found[same] = mass[there[same]]
            out.append(packed(found))
        return pa.table([asked.column("block"), asked.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "mass"])

    asked = pair_mail(blocks, rooms, False)
    return asked.groupBy("bucket").cogroup(model.seated.groupBy("bucket")).applyInArrow(reply, "block long, bucket int, mass binary")


def score_blocks(blocks: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """The same for encoded texts; model.seated and model.pairs are not read again after."""
    held = blocks.sparkSession.sparkContext.broadcast(model.spelling)
    n, base_total, unknown = model.train_tokens, model.train_tokens + 0.1 * (model.distinct + 1), model.unknown()
    unseen = Model(None, None, model.train_tokens, model.distinct, model.discount, model.tables, model.known, model.customers).unseen
    rooms = model.rooms
    masses = stored(pair_masses(blocks, model), "masses")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lengths, words in each(batches, "block", "lengths", "words"):
            words = words_of(lengths, words)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)), words], ["block", "at", "word"])

    asked = blocks.select("block", "lengths", "words").mapInArrow(ask, "block long, at int, word binary")
    known = asked.join(model.seats, "word").select("block", "at", "c", F.log10("p").cast("float").alias("p"), F.col("b").cast("float").alias("b"))
    known = stored(known, "known")  # so that what was asked is gone before blocks and answers are shuffled
    answers = known.unionByName(masses, allowMissingColumns=True)

    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    names = ["id", "n_tokens", "n_known", "base_score", "score", "open_score"]

    def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in (texts.schema.field("ids").type.value_type, *kinds)], names=names)
        sizes, lengths, words, at = next(each([texts], "sizes", "lengths", "words", "tokens"))
        words, at, ends = words_of(lengths, words), unpacked(at, np.int32), np.cumsum(unpacked(sizes, np.int32), dtype=np.int64)
        known = answers.filter(answers.column("at").is_valid())
        there = known.column("at").to_numpy()
        c, opened, behind = np.zeros(len(words)), np.zeros(len(words)), np.ones(len(words))
        for to, name in ((c, "c"), (opened, "p"), (behind, "b")):
            to[there] = known.column(name).to_numpy()
        logs = np.where(c > 0, opened, unknown)
        fresh = np.flatnonzero(c == 0)
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            opened[part] = unseen(held.value.log_probability(words.take(pa.array(part)).to_pylist()))
        base = np.log10((c + 0.1) / base_total)
        hashes = hashed(words.to_pylist())
        dealt = Dealt.out(hashes, at, None, rooms, True)
        mass, place = np.zeros(len(dealt.key)), dict(zip(dealt.buckets.tolist(), dealt.cut, strict=True))
        for bucket, found in each([answers.filter(answers.column("mass").is_valid())], "bucket", "mass"):
            i, j = place[bucket]
            mass[i:j] = unpacked(found, np.float32)
        word = np.argsort(hashes)  # of each hash in order
        first, second = word[dealt.key >> np.uint64(32)], word[dealt.key & np.uint64(0xFFFFFFFF)]

        alone = np.log10(behind)[first]
        score, spelt = alone + logs[second], alone + opened[second]  # may be less than the least double
        there = np.flatnonzero(mass > 0)  # never of words without customers
        score[there] = spelt[there] = np.log10(mass[there] + 10.0 ** score[there])
        starts = np.append(0, ends[:-1])
        summed = [np.add.reduceat(x, starts) for x in ((c > 0)[at].astype(np.int64), base[at], score[dealt.pair_of], spelt[dealt.pair_of])]
        return pa.table([texts.column("ids").combine_chunks().flatten(), *map(pa.array, (ends - starts, *summed))], names=names)

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, base_score double, score double, open_score double"
    texts = blocks.select("block", "ids", "sizes", "lengths", "words", "tokens")
    met = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
    return met.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "open_score")
