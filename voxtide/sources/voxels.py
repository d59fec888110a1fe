"""Volumes as rows of voxels: (sample, x, y, z, phase), dense, background 0 included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.functions.columns import CELL

#: Orders that fill one volume, and its cells along an axis.
ORDERS_PER_SAMPLE, SIDE = 2500, 8


def from_lineitem(spark: SparkSession, sf_dir: str, sample: Column | None = None, side: int = SIDE) -> DataFrame:
    """Volumes of side ** 3 voxels whose phases come from sums over line items; their number grows with the table.

    The dense grid is made from the samples that occur, so the only large
    step is one aggregation with partial sums.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sample = F.floor(F.col("l_orderkey") / ORDERS_PER_SAMPLE).cast("long").cast("string") if sample is None else sample
    quantity = F.col("l_quantity").cast("long")
    at = [(F.col("l_orderkey") % side + 1).cast("int").alias("x"), (F.col("l_partkey") % side + 1).cast("int").alias("y"), (quantity % side + 1).cast("int").alias("z")]
    summed = items.groupBy(sample.alias("sample"), *at).agg((F.sum(F.col("l_linenumber") * 7 + quantity) % 20).alias("v"))
    steps = F.sequence(F.lit(1), F.lit(side))
    grid = summed.select("sample").distinct()
    for axis in "xyz":
        grid = grid.withColumn(axis, F.explode(steps))
    v = F.col("v")
    phase = F.when(v.isNull(), 0).when(v < 8, 1).when(v < 14, 2).when(v < 19, 3).otherwise(0)
    return grid.join(summed, CELL, "left").select(*CELL, phase.cast("int").alias("phase"))


def dims(voxels: DataFrame) -> DataFrame:
    """sample, nx, ny, nz and the number of voxels of every volume."""
    return voxels.groupBy("sample").agg(*(F.max(a).cast("int").alias(f"n{a}") for a in "xyz"), F.count("*").alias("n"))


def from_array(spark: SparkSession, sample: str, labels) -> DataFrame:
    """A volume from a 3-D array; for small ones, as in tests."""
    rows = [(sample, x + 1, y + 1, z + 1, int(labels[x, y, z])) for x in range(labels.shape[0]) for y in range(labels.shape[1]) for z in range(labels.shape[2])]
    return spark.createDataFrame(rows, "sample string, x int, y int, z int, phase int")
