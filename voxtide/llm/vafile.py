"""Clustering around centroids over a VA-file.

Vectors of integers are compressed to a few bits a dimension: a dimension's
axis is cut at its quantiles over all vectors, and a cell is the stretch
between two cuts.  For each round the centroids make a lookup table: for every
dimension, cell and centroid the least and the greatest addend to the distance,
less what is common to all centroids (the distance to a point amid them).
Sums of the looked-up addends are an interval for each centroid.  Where the
intervals of several centroids overlap with the best, and only there, the full
vector is fetched from its bytes and the exact distances decide; elsewhere the
cells do.  All of it is exact integer arithmetic, so ties are ties.

A round is one scan without a shuffle of vectors: tasks hand on sums a cluster
(k rows of d sums a task), and k x d sums reach the driver.  The means of a
round need every vector by their definition; they are summed without distances.

Rows: vectors that are null, of another length, or with null or non-finite
components are left out; repeated rows count each; a null id is assigned but
never a first centroid (it has no hash); equal ids order by their vectors; fewer
vectors than k make fewer centroids, none gives no rows.  A component beyond
2**26 is an error, since squared distances would not fit a long.  Only the two
named columns are read, whatever others are there.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import alone, arrow_schema, stored

#: Bits of a cell, and the accuracy of the quantiles that cut the axes (one in so many rows).
BITS, ACCURACY = 6, 1000
#: Largest component.
LARGEST = 2**26
#: Vectors that a task handles at once.
BLOCK = 8192


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int | None, scale: int, extra: tuple[Column, ...] = ()) -> DataFrame:
    """id and x (array of longs, floor(scale * component)) of the vectors without a hole; dims None: of any length."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))), F.lit(False))
    fits = sound & (F.size(v) == dims) if dims is not None else sound
    return rows.where(fits).select(F.col(id_col).alias("id"), F.transform(v, lambda e: F.floor(e * scale).cast("long")).alias("x"), *extra)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of arrays of longs as an (n, dims) matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def packed(cells: np.ndarray, bits: int) -> np.ndarray:
    """(n, dims) cell numbers as rows of bytes, bits a cell."""
    each = (cells[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(each.reshape(len(cells), -1).astype(np.uint8), axis=1)


def unpacked(rows: np.ndarray, dims: int, bits: int) -> np.ndarray:
    each = np.unpackbits(rows, axis=1)[:, : dims * bits].reshape(len(rows), dims, bits)
    return each.astype(np.intp) @ (1 << np.arange(bits - 1, -1, -1))


@dataclass
class Cuts:
    """Where the axes are cut: cell c of a dimension holds low[c] to high[c]; unused cells are empty (low > high)."""

    low: np.ndarray
    high: np.ndarray
    bits: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.high[j], x[:, j]) for j in range(x.shape[1])], 1)


def cut_axes(vectors: DataFrame, dims: int, bits: int = BITS) -> Cuts | None:
    """Quantile cuts of every dimension over all vectors x; None without vectors."""
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = vectors.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.percentile_approx("value", share, ACCURACY).alias("cuts"), F.min("value").alias("least"), F.max("value").alias("most"))
    rows = {r["at"]: r for r in found.collect()}  # dims rows of 2**bits numbers
    if not rows:
        return None
    if max(max(abs(r["least"]), abs(r["most"])) for r in rows.values()) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}")
    low, high = np.ones((dims, 1 << bits), np.int64), np.full((dims, 1 << bits), np.iinfo(np.int64).max)
    for j in range(dims):
        ends = np.unique([c for c in rows[j]["cuts"] if c < rows[j]["most"]] + [rows[j]["most"]])
        high[j, : len(ends)] = ends
        low[j, : len(ends)] = [rows[j]["least"], *(ends[:-1] + 1)]
    return Cuts(low, high, bits)


def compress(vectors: DataFrame, cuts: Cuts, name: str = "va-file") -> DataFrame:
    """Stored id, cells (packed bytes) and full (bytes of longs) of every vector."""
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cells binary, full binary"
    arrow, dims = arrow_schema(schema), len(cuts.low)

    def rows(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("x"), dims)
            cells = packed(cuts.cells(x), cuts.bits)
            columns = [batch.column("id"), pa.array([r.tobytes() for r in cells], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return stored(vectors.select("id", "x").mapInArrow(rows, schema), name)


class Lookup:
    """Interval addends of every dimension and cell for a set of centroids."""

    def __init__(self, centroids: np.ndarray, cuts: Cuts):
        self.centroids, self.cuts = centroids, cuts
        amid = np.rint(centroids.mean(0)).astype(np.int64)
        lean = -2 * (centroids - amid).T[:, None, :]  # dims x 1 x k
        used = cuts.low <= cuts.high
        ends = [np.where(used, e, 0)[:, :, None] * lean for e in (cuts.low, np.where(cuts.high == np.iinfo(np.int64).max, 0, cuts.high))]
        self.addends = np.concatenate([np.minimum(*ends), np.maximum(*ends)], axis=2)  # dims x cells x 2k
        self.offsets = (centroids * centroids).sum(1) - (amid * amid).sum()

    def intervals(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance to every centroid, both less the distance to the point amid them."""
        total = np.zeros((len(cells), 2 * len(self.centroids)), np.int64)
        for j, addends in enumerate(self.addends):
            total += addends[cells[:, j]]
        k = len(self.centroids)
        return total[:, :k] + self.offsets, total[:, k:] + self.offsets

    def nearest(self, cells: np.ndarray, fetch) -> tuple[np.ndarray, int]:
        """The nearest centroid of every row, ties to the smaller number, and how many rows were fetched in full; fetch gives rows' vectors."""
        least, most = self.intervals(cells)
        open_ = least <= most.min(1, keepdims=True)
        found = open_.argmax(1)
        unsure = np.flatnonzero(open_.sum(1) > 1)
        if len(unsure):
            x = fetch(unsure)
            at, centroid = np.nonzero(open_[unsure])
            distance = np.full((len(unsure), len(self.centroids)), np.iinfo(np.int64).max)
            distance[at, centroid] = ((x[at] - self.centroids[centroid]) ** 2).sum(1)
            found[unsure] = distance.argmin(1)
        return found, len(unsure)


def _decoded(full: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a binary column, without a copy a row."""
    first, last = (full.offset, full.offset + len(full))
    ends = np.frombuffer(full.buffers()[1], np.int32)[first : last + 1]
    return np.frombuffer(full.buffers()[2], np.int64, offset=ends[0], count=(ends[-1] - ends[0]) // 8).reshape(len(full), dims)


def _blocks(batches, dims: int, bits: int):
    """(batch, cells, all vectors) of pieces of the stored table."""
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            part = batch.slice(start, BLOCK)
            raw = part.column("cells")
            width = -(-dims * bits // 8)
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            cells = np.frombuffer(raw.buffers()[2], np.uint8, offset=ends[0], count=ends[-1] - ends[0]).reshape(len(raw), width)
            yield part, unpacked(cells, dims, bits), _decoded(part.column("full"), dims)


def sums(table: DataFrame, lookup: Lookup) -> tuple[dict[int, tuple[int, np.ndarray]], int]:
    """Count and componentwise sum of every cluster that has vectors, and how many vectors were fetched for their exact distances."""
    dims, bits = lookup.centroids.shape[1], lookup.cuts.bits
    schema = "cluster int, count long, fetched long, sums array<long>"
    arrow = arrow_schema(schema)

    def partial(batches):
        alone("vafile")
        count, fetched, total = np.zeros(len(lookup.centroids), np.int64), 0, np.zeros(lookup.centroids.shape, np.int64)
        for _, cells, full in _blocks(batches, dims, bits):
            cluster, n = lookup.nearest(cells, full.__getitem__)
            order = np.argsort(cluster, kind="stable")
            present, starts = np.unique(cluster[order], return_index=True)
            total[present] += np.add.reduceat(full[order], starts, axis=0)
            count += np.bincount(cluster, minlength=len(count))
            fetched += n
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(count[has]), pa.array([fetched if k == 0 else 0 for k in range(len(has))], pa.int64()), pa.array([list(map(int, total[c])) for c in has], pa.list_(pa.int64()))], schema=arrow)

    each = table.mapInArrow(partial, schema).select("cluster", "count", "fetched", F.posexplode("sums").alias("at", "value"))
    first = F.col("at") == 0
    rows = each.groupBy("cluster", "at").agg(F.sum("value").alias("value"), F.sum(F.when(first, F.col("count"))).alias("count"), F.sum(F.when(first, F.col("fetched"))).alias("fetched")).collect()  # k x dims
    out = {c: (0, np.zeros(dims, np.int64)) for c in {r["cluster"] for r in rows}}
    for r in rows:
        count, total = out[r["cluster"]]
        total[r["at"]] = r["value"]
        out[r["cluster"]] = (r["count"] if r["at"] == 0 else count, total)
    return out, sum(r["fetched"] or 0 for r in rows)


def moved(centroids: np.ndarray, found: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
    """Centroids at the floored means of their vectors; empty ones stay."""
    out = centroids.copy()
    for cluster, (count, total) in found.items():
        out[cluster] = total // count
    return out


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of the least sha256 of salt and id, in this order."""
    named = vectors.where(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("h"), "x")
    return np.array([r["x"] for r in named.orderBy("h", "x").limit(k).collect()], np.int64)  # k rows, by Spark's top-k


def assigned(table: DataFrame, lookup: Lookup) -> DataFrame:
    """id, cluster and the exact squared distance of every vector."""
    dims, bits = lookup.centroids.shape[1], lookup.cuts.bits
    schema = f"id {table.schema['id'].dataType.simpleString()}, cluster int, distance long"
    arrow = arrow_schema(schema)

    def rows(batches):
        alone("vafile")
        for part, cells, full in _blocks(batches, dims, bits):
            cluster, _ = lookup.nearest(cells, full.__getitem__)
            distance = ((full - lookup.centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], schema=arrow)

    return table.mapInArrow(rows, schema)


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, salt: str = "1", bits: int = BITS) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, dims, scale)
    cuts = cut_axes(vectors, dims, bits)
    centroids = first_centroids(vectors, k, salt) if cuts else np.zeros((0, dims), np.int64)
    id_type = rows.schema[id_col].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table = compress(vectors, cuts)
    for _ in range(rounds):
        found, _ = sums(table, Lookup(centroids, cuts))
        centroids = moved(centroids, found)
    final = stored(assigned(table, Lookup(centroids, cuts)), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    told = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in inertia.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return final.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
