"""Chord lengths: runs of one phase along rays through a volume.

A ray is cut at every voxel plane that it crosses; each piece lies in one
voxel, found by its middle and looked up in its plane; runs of equal phase are
islands of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtide.functions.columns import AXES
from voxtide.sources.planes import unpacked

#: A direction component below this is parallel to the planes; pieces shorter than NONE are corners.
PARALLEL, NONE = 2.220446049250313e-16, 1e-10
RAY = "ray_id long, px double, py double, pz double, dx double, dy double, dz double"


def random_rays(spark: SparkSession, sizes: DataFrame, rays: int, seed: int) -> DataFrame:
    """sample and rays: points uniform in the box, directions uniform on the sphere, the same for a ray number and seed anywhere."""
    table = spark.range(rays).withColumnRenamed("id", "ray_id")
    # five uniform numbers per ray from its number and the seed
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("ray_id", F.lit(seed), F.lit(k)), 11)) / F.lit(float(2**53))
    table = table.select("ray_id", *(u(k).alias(f"u{k}") for k in range(5)))
    height, turn = 2 * F.col("u3") - 1, 2 * np.pi * F.col("u4")
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - height * height))
    rows = sizes.join(F.broadcast(table)) if rays <= 100_000 else sizes.crossJoin(table)
    return rows.select("sample", "ray_id", *((F.col(f"u{k}") * F.col(f"n{a}")).alias(f"p{a}") for k, a in enumerate(AXES)), (flat * F.cos(turn)).alias("dx"), (flat * F.sin(turn)).alias("dy"), height.alias("dz"))


def _crossings(p: Column, d: Column, n: Column, skew: Column) -> Column:
    """Where a ray meets the planes 0 .. n of one axis."""
    return F.when(skew, F.transform(F.sequence(F.lit(0), n), lambda k: (k - p) / d)).otherwise(F.array().cast("array<double>"))


def segments(rays: DataFrame, sizes: DataFrame) -> DataFrame:
    """sample, ray_id, t, length, x, y, z: the pieces of each ray inside its box, in order of t."""
    rows = rays.join(sizes, "sample")
    low, high, inside, cuts = [], [], F.lit(True), []
    for a in AXES:
        p, d, n = F.col(f"p{a}"), F.col(f"d{a}"), F.col(f"n{a}")
        skew = F.abs(d) >= PARALLEL
        safe = F.when(skew, d)
        one, other = (0 - p) / safe, (n - p) / safe
        low.append(F.coalesce(F.least(one, other), F.lit(float("-inf"))))
        high.append(F.coalesce(F.greatest(one, other), F.lit(float("inf"))))
        inside = inside & (skew | ((p >= 0) & (p <= n)))
        cuts.append(_crossings(p, safe, n, skew))
    rows = rows.withColumns({"t0": F.greatest(*low), "t1": F.least(*high)}).where(inside & (F.col("t1") > F.col("t0")))
    between = F.filter(F.concat(*cuts), lambda t: (t > F.col("t0")) & (t < F.col("t1")))
    rows = rows.withColumn("ts", F.array_sort(F.concat(F.array("t0", "t1"), between)))
    pieces = F.arrays_zip(F.slice("ts", F.lit(1), F.size("ts") - 1).alias("a"), F.slice("ts", F.lit(2), F.size("ts")).alias("b"))
    rows = rows.withColumn("s", F.explode(pieces)).where(F.col("s.b") - F.col("s.a") > NONE)
    middle = (F.col("s.a") + F.col("s.b")) / 2
    cell = lambda a: F.least(F.greatest(F.floor(F.col(f"p{a}") + middle * F.col(f"d{a}")).cast("int") + 1, F.lit(1)), F.col(f"n{a}")).alias(a)
    return rows.select("sample", "ray_id", F.col("s.a").alias("t"), (F.col("s.b") - F.col("s.a")).alias("length"), *map(cell, AXES))


def looked_up(pieces: DataFrame, planes: DataFrame) -> DataFrame:
    """sample, ray_id, t, length, phase: a plane meets the pieces that lie in it; no voxels are shuffled."""
    there = pieces.groupBy("sample", "x").agg(F.collect_list(F.struct("ray_id", "t", "length", "y", "z")).alias("pieces"))
    schema = "sample string, ray_id long, t double, length double, phase long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                sample, ny, nz, data = (batch.column(c)[k].as_py() for c in ("sample", "ny", "nz", "labels"))
                here = batch.column("pieces").slice(k, 1).flatten()
                at = {c: here.field(c) for c in ("ray_id", "t", "length", "y", "z")}
                cell = (at["y"].to_numpy() - 1) * nz + at["z"].to_numpy() - 1
                yield pa.RecordBatch.from_arrays([pa.array([sample] * len(cell), pa.string()), at["ray_id"], at["t"], at["length"], pa.array(unpacked(data, ny * nz)[cell].astype(np.int64))], names=["sample", "ray_id", "t", "length", "phase"])

    return planes.join(there, ["sample", "x"]).select("sample", "ny", "nz", "labels", "pieces").mapInArrow(run, schema)


def chords(pieces: DataFrame, planes: DataFrame) -> DataFrame:
    """sample, ray_id, phase, start, length of every run of one phase."""
    rows = looked_up(pieces, planes)
    ray = Window.partitionBy("sample", "ray_id").orderBy("t")
    changed = rows.withColumn("new", (~F.col("phase").eqNullSafe(F.lag("phase").over(ray))).cast("int"))
    island = changed.withColumn("island", F.sum("new").over(ray))
    return island.groupBy("sample", "ray_id", "island").agg(F.first("phase").alias("phase"), F.min("t").alias("start"), F.sum("length").alias("length")).drop("island")


def mean_chord_length(runs: DataFrame, wanted: DataFrame, min_chord: float = 4.0, voxel_size: float = 0.1) -> DataFrame:
    """sample, phase, value over wanted (sample, phase); min_chord is in voxels; NaN where no run is long enough."""
    mean = runs.where(F.col("length") >= min_chord).groupBy("sample", "phase").agg((F.avg("length") * voxel_size).alias("value"))
    return wanted.select("sample", "phase").join(mean, ["sample", "phase"], "left").select("sample", "phase", F.coalesce("value", F.lit(float("nan"))).alias("value"))


__all__ = ["RAY", "chords", "looked_up", "mean_chord_length", "random_rays", "segments"]
