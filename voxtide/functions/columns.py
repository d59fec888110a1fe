"""Column expressions shared by the voxel operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
CELL = ["sample", *AXES]


def along(direction: int) -> str:
    """The axis of a direction 1, 2 or 3."""
    if direction not in (1, 2, 3):
        raise ValueError("direction must be 1, 2 or 3")
    return AXES[direction - 1]


def axis_value(direction: Column, prefix: str = "") -> Column:
    return F.when(direction == 1, F.col(f"{prefix}x")).when(direction == 2, F.col(f"{prefix}y")).otherwise(F.col(f"{prefix}z"))


def size_along(direction: Column) -> Column:
    return F.when(direction == 1, F.col("nx")).when(direction == 2, F.col("ny")).otherwise(F.col("nz"))


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def mean_of_finite(value: Column) -> Column:
    """Mean without infinite and undefined values; infinite if none is left."""
    return F.coalesce(F.avg(F.when(finite(value), value)), F.lit(float("inf")))


def linear_index(nx: Column, ny: Column) -> Column:
    """Number of a cell, x fastest, from 1."""
    return F.col("x") + (F.col("y") - 1) * nx + (F.col("z") - 1) * nx * ny


def literal_rows(spark, name: str, values) -> DataFrame:
    return spark.createDataFrame([(int(v),) for v in values], f"{name} int")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
