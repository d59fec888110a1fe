"""Near-duplicate documents by BagMinHash signatures over five-word shingles.

A document is the multiset of its five-word shingles (lower case, split at
white space).  Every shingle has hashed Poisson processes over the levels of
its weight: one over (0, 1] and one over each doubling (1, 2], (2, 4], ... up
to its count.  A point of a process carries a time and a signature component;
a process over more than one level is split in two after its point, one half
keeping the point and the other drawing its next, so documents that share a
shingle share the points below the lesser count whatever their own counts.
Component i of the signature is the least time with that component; two
documents agree in a component with the probability of their weighted Jaccard
index.  Generation stops where times pass the largest component.

Signatures are cut into bands.  Texts that are equal are one row from the
start; those that share a band's key are one *bucket*, and no bucket is joined
with itself.  All buckets of a group get one *centre*, a text of its largest
buckets, and every member is compared with it by exact multiset overlap: a
star.  Where a star leaves members outside the centre's component, these, the
stragglers, are looked up among all members of the group, held as blocks of
bounded size: a member is known by how its bag differs from the centre's, an
inverted index over these differences (short lists, as copies differ each in
its own places) gives a straggler's exact overlap with the whole block, and
only links that join two components leave the task.  Connected components of
the links are the classes, so no link between different texts is lost but by
the bands' miss.

Rows: null and white-space texts have no shingles and are one class each of
equal texts (null counts as empty); fewer than five words make one shingle.
Rows with one id and several texts give a row each, a null id is an id and the
least, repeated rows stay repeated, other columns are left out whatever their
names, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm import exactdedup
from voxtide.llm.common import WORD_HASH, alone, arrow_schema, discard, mix, record_batch, shingle_hashes, stored

WORDS, SIMILAR = 5, 0.8
#: Pairs at 0.8 share one band of four with probability 1 - (1 - 0.41) ** 32, all but 5 in 10 ** 8.
BANDS, BAND_ROWS = 32, 4
#: Shingles that are turned into signatures at a time.
BATCH_SHINGLES = 60_000
#: Bytes of bags of one block of a group.
BLOCK_BYTES = 4_000_000


def bag(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts."""
    return np.unique(shingle_hashes(text.lower().split(), words), return_counts=True)


def _exponential(seed: np.ndarray, salt: int) -> np.ndarray:
    u = mix(seed + np.uint64(salt)) >> np.uint64(11)
    return -np.log((u.astype(np.float64) + 0.5) / 2.0**53)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * BAND_ROWS) -> np.ndarray:
    """One row of size least times per bag; inf throughout for an empty bag."""
    least = np.full((len(bags), size), np.inf)
    flat = least.ravel()
    many = [len(k) for k, _ in bags]
    if not sum(many):
        return least
    with np.errstate(over="ignore"):
        doc = np.repeat(np.arange(len(bags)), many)
        item = np.concatenate([k for k, _ in bags])
        count = np.concatenate([c for _, c in bags]).astype(np.int64)
        # one process for (0, 1], then one for each doubling that the count reaches into
        docs, seeds, low, span, counts = [doc], [mix(item)], [np.zeros(len(doc), np.int64)], [np.ones(len(doc), np.int64)], [count]
        level = 0
        while (reach := count > 1 << level).any():
            docs.append(doc[reach])
            seeds.append(mix(item[reach] + np.uint64(level + 1)))
            low.append(np.full(reach.sum(), 1 << level, np.int64))
            span.append(np.full(reach.sum(), 1 << level, np.int64))
            counts.append(count[reach])
            level += 1
        doc, seed, low, span, count = (np.concatenate(x) for x in (docs, seeds, low, span, counts))
        time = _exponential(seed, 1) / (span * float(size))
        while len(doc):
            # split until the point lies in one level; each split starts the other half's process
            new: list[tuple] = []
            wide = np.flatnonzero(span > 1)
            while len(wide):
                half = span[wide] // 2
                right = (mix(seed[wide] + np.uint64(2)) & np.uint64(1)).astype(bool)
                left_low, right_low = low[wide], low[wide] + half
                other_low = np.where(right, left_low, right_low)
                other_seed = mix(seed[wide] + np.where(right, np.uint64(3), np.uint64(4)))
                other_time = time[wide] + _exponential(other_seed, 1) / (half * float(size))
                use = other_low < count[wide]
                new.append(tuple(x[use] for x in (doc[wide], other_seed, other_low, half, count[wide], other_time)))
                low[wide] = np.where(right, right_low, left_low)
                seed[wide] = mix(seed[wide] + np.where(right, np.uint64(4), np.uint64(3)))
                span[wide] = half
                wide = wide[half > 1]
            inside = low < count
            doc, seed, low, span, count, time = (x[inside] for x in (doc, seed, low, span, count, time))
            at = doc * size + (mix(seed + np.uint64(5)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(flat, at, time)
            # the level's next point
            seed = mix(seed + np.uint64(6))
            time = time + _exponential(seed, 1) / size
            if new:
                doc, seed, low, span, count, time = (np.concatenate([x, *more]) for x, *more in zip((doc, seed, low, span, count, time), *new, strict=True))
            keep = time < least.max(1)[doc]
            doc, seed, low, span, count, time = (x[keep] for x in (doc, seed, low, span, count, time))
    return least


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag as bytes: hashes, and their counts unless all are 1."""
    return keys.astype("<u8").tobytes() + (b"" if (counts == 1).all() else counts.astype("<u4").tobytes() + b"c")


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) % 4 == 0:
        return np.frombuffer(data, "<u8"), np.ones(len(data) // 8, np.int64)
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)


def overlap(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each shingle of the bag (x, m) is also in (y, n)."""
    if not len(y):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return np.where(y[at] == x, np.minimum(m, n[at]), 0)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard index of two packed bags."""
    (x, m), (y, n) = unpack(a), unpack(b)
    same = int(overlap(x, m, y, n).sum())
    total = int(m.sum() + n.sum()) - same
    return same / total if total else 0.0


def items(data: bytes) -> np.ndarray:
    """A packed bag as a set: the n-th copy of a shingle is an item of its own."""
    keys, counts = unpack(data)
    if len(data) % 4 == 0:
        return keys
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return np.repeat(keys, counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Members of a group, each as its difference from the centre's items, and which of them share an item."""

    def __init__(self, centre: bytes, bags: list[bytes]):
        self.centre = items(centre)
        sets = [items(b) for b in bags]
        apart = [np.setxor1d(x, self.centre, assume_unique=True) for x in sets]
        self.sizes, self.far = np.array([len(x) for x in sets]), np.array([len(x) for x in apart])
        flat, owner = np.concatenate(apart), np.repeat(np.arange(len(bags)), self.far)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.keys, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))

    def alike(self, bag: bytes, similar: float) -> np.ndarray:
        """Numbers of the members whose weighted Jaccard index with the bag reaches similar."""
        own = items(bag)
        apart = np.setxor1d(own, self.centre, assume_unique=True)
        at = np.searchsorted(self.keys, apart)
        there = np.flatnonzero(at < len(self.keys))
        at = at[there][self.keys[at[there]] == apart[there]]
        many = self.end[at] - self.start[at]
        places = np.repeat(self.start[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        same = (len(own) + self.sizes - (len(apart) + self.far - 2 * shared)) // 2
        return np.flatnonzero(same / (len(own) + self.sizes - same) >= similar)


def band_keys(texts: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """node, keys (one 64-bit key a band) of texts (node, text); texts without shingles are left out."""

    def finish(nodes, bags):
        bits = signatures(bags, bands * rows).view(np.uint64).reshape(-1, bands, rows)
        keys = np.zeros(bits.shape[:2], np.uint64)
        for k in range(rows):
            keys = mix(keys ^ bits[:, :, k])
        flat = pa.array(keys.view(np.int64).ravel())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.FixedSizeListArray.from_arrays(flat, bands).cast(pa.list_(pa.int64()))], ["node", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("bagminhash", WORD_HASH)
        for batch in batches:
            nodes, bags, held = [], [], 0
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = bag(text.as_py())
                if len(keys):
                    nodes.append(own.as_py())
                    bags.append((keys, counts))
                    held += len(keys)
                if held >= BATCH_SHINGLES or len(bags) >= BATCH_SHINGLES // 10:
                    yield finish(nodes, bags)
                    nodes, bags, held = [], [], 0
            if nodes:
                yield finish(nodes, bags)

    return texts.select("node", "text").mapInArrow(run, "node binary, keys array<long>")


def packed_bags(texts: DataFrame) -> DataFrame:
    """node, bag of texts (node, text)."""

    @F.pandas_udf("binary")
    def of(column):
        alone("bagminhash", WORD_HASH)
        return column.map(lambda t: pack(*bag(t)))

    return texts.select("node", of("text").alias("bag"))


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """pairs (node, centre) with their exact similarity s; bags (node, bag) join each end, and AQE splits skewed ends."""
    schema = "node binary, centre binary, s double"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(x.as_py(), c.as_py()) for x, c in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], schema=kinds)

    left = pairs.join(bags, "node")
    both = left.join(bags.select(F.col("node").alias("centre"), F.col("bag").alias("centre_bag")), "centre")
    return both.select("node", "centre", "bag", "centre_bag").mapInArrow(run, schema)


def searched(rest: DataFrame, bags: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that join components: the stragglers of rest (node, comp, centre, straggler) against all of their centre's members.

    Members are dealt to blocks of BLOCK_BYTES or so and each block meets its
    group's stragglers one by one.  A task holds one block, and hands on at
    most one link for each component that a link joins to another.
    """
    held = stored(rest.join(bags, "node"), "rest")
    blocks = held.groupBy("centre").agg((F.floor(F.sum(F.length("bag")) / BLOCK_BYTES) + 1).cast("int").alias("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    columns = ["centre", "block", "kind", "node", "comp", "bag"]
    heads = blocks.join(bags.withColumnRenamed("node", "centre"), "centre").select("centre", every, F.lit(0).alias("kind"), F.col("centre").alias("node"), F.col("centre").alias("comp"), "bag")
    members = held.join(blocks, "centre").select("centre", own, F.lit(1).alias("kind"), "node", "comp", "bag")
    asking = held.where("straggler").join(blocks, "centre").select("centre", every, F.lit(2).alias("kind"), "node", "comp", "bag")
    dealt = heads.select(columns).unionAll(members.select(columns)).unionAll(asking.select(columns))
    schema = "a binary, b binary"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre, nodes, comps, bags, block, up = None, b"", [], [], [], None, {}

        def top(x):
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        for batch in batches:
            links = []
            for key, number, kind, node, comp, bag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, number) != now:
                    now, nodes, comps, bags, block, up = (key, number), [], [], [], None, {}
                if kind == 0:
                    centre = bag
                elif kind == 1:
                    nodes.append(node)
                    comps.append(comp)
                    bags.append(bag)
                elif nodes:
                    if block is None:
                        block, bags = Block(centre, bags), []
                    for i in block.alike(bag, similar):
                        one, other = top(comp), top(comps[i])
                        if one != other:
                            up[max(one, other)] = min(one, other)
                            links.append((node, nodes[i]))
            if links:
                yield record_batch(links, kinds)

    return dealt.repartition("centre", "block").sortWithinPartitions("centre", "block", "kind", "node").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node of each linked node's component.

    Each round hands on the least label of the neighbours and then follows
    the label's own label, into a stored table; stars need two or three rounds.
    """
    both = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(links.select("b", "a")).distinct(), "links")
    now = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("comp")), "labels")
    last = now
    while True:
        near = both.join(now.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("comp").alias("near")).withColumnRenamed("x", "node")
        step = now.join(near, "node").select("node", F.least("comp", "near").alias("mid"), F.col("comp").alias("old"))
        up = now.select(F.col("node").alias("mid"), F.col("comp").alias("up"))
        after = stored(step.join(up, "mid").select("node", F.least("mid", "up").alias("comp"), "old"), "labels")
        discard(last)
        now, last = after.select("node", "comp"), after
        if after.where("comp <> old").isEmpty():
            discard(both)
            return now


def _with_comp(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def to_centres(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, centre) of every member of a bucket (band, key, node), node and centre never equal.

    A node's best is the largest by (weight, node) in its buckets, and a
    bucket's centre the largest of its members' bests, so that the buckets of
    one group share theirs.
    """
    rank = F.struct("weight", "node")
    ranked = members.join(weights, "node")
    met = ranked.join(ranked.groupBy("band", "key").agg(F.max(rank).alias("c")), ["band", "key"])
    best = met.groupBy("node").agg(F.max("c").alias("best"))
    far = members.join(best, "node").groupBy("band", "key").agg(F.max("best").alias("c"))
    return members.join(far, ["band", "key"]).select("node", F.col("c.node").alias("centre")).where("node <> centre").distinct()


def linked(texts: DataFrame, keys: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """node, comp of every text linked to another; texts (node, text) may repeat nodes, keys is band_keys of them."""
    flat = keys.select("node", F.posexplode("keys").alias("band", "key"))
    shared = flat.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    found = flat.join(shared, ["band", "key"])
    weights = stored(found.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    members = stored(found.select("band", "key", "node"), "members")
    # texts with partners are told by a Bloom filter of bounded size, the same plan at every size: one that passes
    # by chance has a bag that nothing asks for
    named = stored(weights.select(F.xxhash64("node").alias("h")).distinct(), "named")
    likely = exactdedup.tested(texts.withColumn("h", F.xxhash64("node")), "h", *exactdedup.filter_of(named, "h"), "likely").where("likely")
    bags = stored(packed_bags(likely).dropDuplicates(["node"]), "bags")
    discard(named)
    star = stored(verified(to_centres(members, weights), bags), "verified")
    discard(members, weights)
    links = star.where(F.col("s") >= similar).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    comps = components(links)
    centre = _with_comp(star.select(F.col("centre").alias("node")).distinct(), comps).select(F.col("node").alias("centre"), F.col("comp").alias("centre_comp"))
    rest = _with_comp(star.select("node", "centre"), comps).join(centre, "centre").withColumn("straggler", F.col("comp") != F.col("centre_comp"))
    open_ = rest.where("straggler").select("centre").distinct()
    more = searched(rest.join(open_, "centre").select("node", "comp", "centre", "straggler"), bags, similar)
    return components(links.unionByName(more))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: id, class_id (least id of its class), same_text (least id with an equal text)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    keys = stored(band_keys(rows).dropDuplicates(["node"]), "bands")
    comps = linked(rows.select("node", "text"), keys, similar)
    own = stored(_with_comp(rows.select("id", "node"), comps), "classes")
    by_text = own.groupBy("node").agg(F.min("id").alias("same_text"))
    by_class = own.groupBy("comp").agg(F.min("id").alias("class_id"))
    return own.join(by_text, "node").join(by_class, "comp").select(F.col("id").alias(id_col), "class_id", "same_text")
