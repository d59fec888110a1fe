"""Specific surface: mean gradient of the smoothed phase indicator.

A slab of planes comes with the halo that the filter and the gradient reach
into, so the whole computation of a slab is one task and planes are shuffled
once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.sources.planes import SLAB_VOXELS, block, in_slabs


def kernel(sigma: float, half_width: int | None = None) -> list[float]:
    """Normalised Gaussian weights at -half_width .. half_width (2 * ceil(sigma) unless given)."""
    half = 2 * math.ceil(sigma) if half_width is None else half_width
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def filtered(values: np.ndarray, weights: list[float]) -> np.ndarray:
    """Separable filter; the outermost value is repeated beyond the boundary."""
    half = len(weights) // 2
    for axis in range(3):
        n = values.shape[axis]
        wide = np.pad(values, [(half, half) if a == axis else (0, 0) for a in range(3)], mode="edge")
        out = np.zeros_like(values)
        for k, weight in enumerate(weights):
            out += weight * wide[tuple(slice(k, k + n) if a == axis else slice(None) for a in range(3))]
        values = out
    return values


def gradients(values: np.ndarray, voxel_size: float) -> list[np.ndarray]:
    """Central differences along each axis, one-sided at both ends; NaN along an axis of one value."""
    out = []
    for axis in range(3):
        n = values.shape[axis]
        at = np.arange(n)
        ahead, behind = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
        span = ((ahead - behind) * voxel_size).reshape([-1 if a == axis else 1 for a in range(3)])
        with np.errstate(invalid="ignore"):
            out.append((values.take(ahead, axis) - values.take(behind, axis)) / span)
    return out


def _slab(rows: pa.Table, weights: list[float], phase: int, voxel_size: float | None) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """(first plane, smoothed indicator, its gradients) of the slab's own planes.

    The halo's outer planes lack neighbours of their own, but no own plane's
    value depends on those; at the volume's ends the repetition is right.
    """
    x, labels = block(rows)
    own = slice(int(rows["x0"][0].as_py() - x[0]), int(rows["x1"][0].as_py() - x[0]) + 1)
    smooth = filtered((labels == phase).astype(np.float64), weights)
    slopes = [g[own] for g in gradients(smooth, voxel_size)] if voxel_size else []
    return int(x[0]) + own.start, smooth[own], slopes


def _per_voxel(planes: DataFrame, phases, sigma: float, half_width: int | None, voxel_size: float | None, slab_voxels: int, columns: list[str]) -> DataFrame:
    weights, phases = kernel(sigma, half_width), [int(p) for p in phases]
    reach = len(weights) // 2 + bool(voxel_size)

    def run(rows: pa.Table) -> pa.Table:
        parts = []
        for phase in phases:
            first, smooth, slopes = _slab(rows, weights, phase, voxel_size)
            x, y, z = (c.ravel() for c in np.indices(smooth.shape))
            cells = {"sample": pa.array([rows["sample"][0].as_py()] * len(x)), "phase": np.full(len(x), phase, np.int32), "x": (x + first).astype(np.int32), "y": (y + 1).astype(np.int32), "z": (z + 1).astype(np.int32)}
            parts.append(pa.table(cells | {c: v.ravel() for c, v in zip(columns, [smooth, *slopes], strict=True)}))
        return pa.concat_tables(parts)

    schema = "sample string, phase int, x int, y int, z int, " + ", ".join(f"{c} double" for c in columns)
    return in_slabs(planes, slab_voxels, reach, reach).groupBy("sample", "slab").applyInArrow(run, schema)


def smooth(planes: DataFrame, phases, sigma: float = 1.0, half_width: int | None = None, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """sample, phase, x, y, z, v: the filtered indicator of each phase in every voxel."""
    return _per_voxel(planes, phases, sigma, half_width, None, slab_voxels, ["v"])


def gradient(planes: DataFrame, phases, voxel_size: float, sigma: float = 1.0, half_width: int | None = None, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """smooth with gx, gy, gz."""
    return _per_voxel(planes, phases, sigma, half_width, voxel_size, slab_voxels, ["v", "gx", "gy", "gz"])


def surface_area(planes: DataFrame, phases, voxel_size: float = 0.1, sigma: float = 1.0, half_width: int | None = None, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """sample, phase, value: mean length of the gradient; planes are shuffled to slabs, then one sum a slab and phase."""
    weights, phases = kernel(sigma, half_width), [int(p) for p in phases]
    reach = len(weights) // 2 + 1

    def run(rows: pa.Table) -> pa.Table:
        found = []
        for phase in phases:
            _, smooth, slopes = _slab(rows, weights, phase, voxel_size)
            found.append((phase, float(np.sqrt(sum(g * g for g in slopes)).sum()), smooth.size))
        phase, total, n = zip(*found, strict=True)
        return pa.table({"sample": pa.array([rows["sample"][0].as_py()] * len(phase)), "phase": pa.array(phase, pa.int32()), "total": total, "n": pa.array(n, pa.int64())})

    sums = in_slabs(planes, slab_voxels, reach, reach).groupBy("sample", "slab").applyInArrow(run, "sample string, phase int, total double, n long")
    return sums.groupBy("sample", "phase").agg((F.sum("total") / F.sum("n")).alias("value"))
