"""Features that are counts: fractions, phases, triple-phase-boundary edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions.columns import AXES
from voxtide.sources.planes import SLAB_VOXELS, block, in_slabs, unpacked


def positive_phases(voxels: DataFrame) -> DataFrame:
    """sample, phase of every positive label that occurs."""
    return voxels.where("phase > 0").select("sample", "phase").distinct()


def phase_masks(voxels: DataFrame, phases) -> DataFrame:
    """sample, phase, x, y, z of every voxel of the phases asked for."""
    return voxels.where(F.col("phase").isin([int(p) for p in phases])).select("sample", "phase", *AXES)


def phase_counts(voxels: DataFrame, phases) -> DataFrame:
    """sample, phase, voxels, total: one row per sample and phase asked for, 0 where it does not occur."""
    sums = voxels.groupBy("sample").agg(F.count("*").alias("total"), *(F.count_if(F.col("phase") == int(p)).alias(f"n{p}") for p in phases))
    pairs = F.array(*(F.struct(F.lit(int(p)).alias("phase"), F.col(f"n{p}").alias("voxels")) for p in phases))
    return sums.select("sample", F.explode(pairs).alias("p"), "total").select("sample", "p.phase", "p.voxels", "total")


def volume_fraction(voxels: DataFrame, phases) -> DataFrame:
    """sample, phase, value: share of all voxels, background included in the whole."""
    return phase_counts(voxels, phases).select("sample", "phase", (F.col("voxels") / F.col("total")).alias("value"))


def plane_counts(planes: DataFrame, phases) -> DataFrame:
    """phase_counts of planes: a sum a plane where it lies, no voxels shuffled."""
    phases = [int(p) for p in phases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                sample, ny, nz, data = (batch.column(c)[k].as_py() for c in ("sample", "ny", "nz", "labels"))
                labels = unpacked(data, ny * nz)
                yield pa.RecordBatch.from_arrays([pa.array([sample] * len(phases)), pa.array(phases, pa.int32()), pa.array([int((labels == p).sum()) for p in phases], pa.int64()), pa.array([ny * nz] * len(phases), pa.int64())], names=["sample", "phase", "voxels", "total"])

    each = planes.select("sample", "ny", "nz", "labels").mapInArrow(run, "sample string, phase int, voxels long, total long")
    return each.groupBy("sample", "phase").agg(F.sum("voxels").alias("voxels"), F.sum("total").alias("total"))


#: Axis of an edge and the two axes across it, along which its four voxels lie.
AROUND = (("x", (1, 2)), ("y", (0, 2)), ("z", (0, 1)))


def _edges(found: np.ndarray, own: int) -> list[int]:
    """Voxel edges along each axis whose four voxels together have the bits 1, 2 and 4; those that begin in the first own planes."""
    out = []
    for _, across in AROUND:
        around = found
        for axis in across:
            n = around.shape[axis]
            around = around.take(range(n - 1), axis) | around.take(range(1, n), axis)
        out.append(int((around[:own] == 7).sum()))
    return out


def _edges_of_slabs(planes: DataFrame, bits, slab_voxels: int, names: list[int]) -> DataFrame:
    """sample, dir (one of names), axis, edges, total: bits(rows) gives for each name the voxels' bits; slabs overlap by a plane, so no edge is lost or counted twice."""

    def run(rows: pa.Table) -> pa.Table:
        found = []
        own = rows["x1"][0].as_py() - rows["x0"][0].as_py() + 1
        for name, marked in zip(names, bits(rows), strict=True):
            total = own * marked.shape[1] * marked.shape[2]
            found += [(rows["sample"][0].as_py(), name, axis, n, total) for (axis, _), n in zip(AROUND, _edges(marked, own), strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["sample", "dir", "axis", "edges", "total"])

    each = in_slabs(planes, slab_voxels, 0, 1).groupBy("sample", "slab").applyInArrow(run, "sample string, dir int, axis string, edges long, total long")
    return each.groupBy("sample", "dir", "axis").agg(F.sum("edges").alias("edges"), F.sum("total").alias("total"))


def _density(edges: DataFrame, key: list[str], voxel_size: float) -> DataFrame:
    if voxel_size <= 0:
        raise ValueError("voxel_size must be positive")
    sums = edges.groupBy(*key).agg(F.sum("edges").alias("edges"), F.max("total").alias("total"))
    return sums.select(*key, (F.col("edges") * voxel_size / (F.col("total") * voxel_size**3)).alias("value"))


def tpb_edges(planes: DataFrame, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """sample, axis, edges, total: voxel edges along each axis whose four voxels hold phases 1, 2 and 3; edges on the volume's boundary do not count."""

    def bits(rows: pa.Table) -> list[np.ndarray]:
        labels = block(rows)[1]
        return [sum(((labels == p).astype(np.uint8) << (p - 1) for p in (1, 2, 3)), np.zeros(labels.shape, np.uint8))]

    return _edges_of_slabs(planes, bits, slab_voxels, [0]).drop("dir")


def tpb_density(planes: DataFrame, voxel_size: float = 0.1, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """sample, value: edge length in a unit of volume."""
    return _density(tpb_edges(planes, slab_voxels), ["sample"], voxel_size)


def active_tpb_density(planes: DataFrame, directions, voxel_size: float = 0.1, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """sample, dir, value: as tpb_density, with phases 1 and 2 counted where they percolate; all directions in one pass.

    planes are connected planes, whose faces byte tells the directions along
    which a voxel's part percolates.
    """
    directions = [int(d) for d in directions]

    def bits(rows: pa.Table) -> list[np.ndarray]:
        labels, faces = block(rows)[1], block(rows, "faces")[1].view(np.uint8)
        third = (labels == 3).astype(np.uint8) << 2
        both = [(labels == p).astype(np.uint8) << (p - 1) for p in (1, 2)]
        return [third + (faces >> (2 * d - 2) & 3 == 3) * (both[0] + both[1]) for d in directions]

    return _density(_edges_of_slabs(planes, bits, slab_voxels, directions), ["sample", "dir"], voxel_size)
