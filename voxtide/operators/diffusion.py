"""Physical tortuosity: steady diffusion through the percolating voxels.

The system is a stencil: a voxel's diagonal is its number of neighbours in the
mask plus the boundary factor for each transport face that it lies on; inlet
voxels also have the factor on the right side.  Its rows are windows over the
dense grid; one application is a join with the neighbours.  The solve itself,
thousands of steps each of which needs all of the last, is conjugate gradients
with a Jacobi preconditioner on shifted arrays: a mask of a volume up to
TASK_CELLS is solved in a task of its own, a larger one in slabs along a line
of tasks that exchange border planes and sums.  A job makes at most STEPS of
them and stores where it is, so that lost executors cost no more than that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions.columns import AXES, axis_value, size_along
from voxtide.functions.line import Line
from voxtide.functions.tables import discard, stored
from voxtide.operators.connectivity import MASK, TASK_CELLS, by_mask, per_direction, slab_mask

#: Steps of a job, after which the iterates are stored.
STEPS = 2000
#: Cells of a piece that the solver sweeps at once; a plane at least.
PIECE = 32_768


class NotConverged(RuntimeError):
    """The solver stopped before the residual was small enough."""


def _stencil_moves():
    moves = [(a, s) for a in AXES for s in (-1, 1)]
    return F.array(*(F.struct(*(F.lit(s if a == b else 0).alias(f"m{b}") for b in AXES)) for a, s in moves))


def edges(through: DataFrame) -> DataFrame:
    """sample, phase, dir, x, y, z and the neighbour's ox, oy, oz, both in the mask."""
    key = [*MASK, *AXES]
    moved = through.select(*key).withColumn("m", F.explode(_stencil_moves())).select(*key, *((F.col(a) + F.col(f"m.m{a}")).alias(f"o{a}") for a in AXES))
    other = through.select(*MASK, *(F.col(a).alias(f"o{a}") for a in AXES))
    return moved.join(other, [*MASK, *(f"o{a}" for a in AXES)])


def system(through: DataFrame, sizes: DataFrame, boundary_factor: float = 2.0) -> DataFrame:
    """The rows of the linear system: diagonal, right side, start value, and whether the voxel is at the outlet."""
    near = edges(through).groupBy(*MASK, *AXES).agg(F.count("*").alias("near"))
    rows = through.join(near, [*MASK, *AXES], "left").join(sizes, "sample")
    at, last = axis_value(F.col("dir")), size_along(F.col("dir"))
    faces = (at == 1).cast("int") + (at == last).cast("int")
    return rows.select(
        *MASK, *AXES, (F.coalesce("near", F.lit(0)) + faces * boundary_factor).alias("diagonal"), ((at == 1).cast("int") * F.lit(boundary_factor)).alias("rhs"),
        (1 - (at - 0.5) / last).alias("x0"), (at == last).alias("outlet"),
    )


def apply_operator(rows: DataFrame, through: DataFrame, column: str) -> DataFrame:
    """diagonal * column less the neighbours' column, as applied."""
    value = rows.select(*MASK, *(F.col(a).alias(f"o{a}") for a in AXES), F.col(column).alias("other"))
    near = edges(through).join(value, [*MASK, *(f"o{a}" for a in AXES)]).groupBy(*MASK, *AXES).agg(F.sum("other").alias("others"))
    return rows.join(near, [*MASK, *AXES], "left").withColumn("applied", F.col("diagonal") * F.col(column) - F.coalesce("others", F.lit(0.0))).drop("others")


@dataclass
class State:
    """Where a solve stands: values and directions of the slab's cells (of its mask, plane by plane), and two scalars of the recursion."""

    values: np.ndarray
    directions: np.ndarray
    steps: int = 0
    rz: float = 0.0
    turn: float = 0.0
    residual: float = 0.0
    done: bool = False


def solve(mask: np.ndarray, axis: int, boundary_factor: float, rtol: float, max_iterations: int, atol: float = 0.0, line: Line = Line(), first: int = 1, planes: int | None = None, state: State | None = None, stop_after: int | None = None) -> State:
    """The concentration on the mask's cells by Jacobi-preconditioned conjugate gradients.

    mask is this task's slab across the first axis, from plane `first` of
    `planes`.  The grid has a border of empty cells, so a neighbour is a fixed
    number of cells away; in a line the border planes hold the neighbours'
    cells.  Vectors are swept in pieces that stay in a core's cache; a task's
    border planes are made first and sent off.
    """
    planes = planes or len(mask)
    last = first + len(mask) - 1
    cells = np.pad(mask, 1)
    grid, size = cells.shape, cells.size
    layer = grid[1] * grid[2]
    low, high = slice(layer, 2 * layer), slice(size - 2 * layer, size - layer)
    outside = (slice(0, layer), slice(size - layer, size))
    flat = cells.ravel()
    _send_borders(line, flat, low, high, outside)
    moves = (1, grid[2], layer)
    inlet, outlet = ([slice(None)] * 3 for _ in range(2))
    inlet[axis], outlet[axis] = slice(1, 2), slice(-2, -1)
    faces = [tuple(face) for face, here in ((inlet, axis or first == 1), (outlet, axis or last == planes)) if here]
    near = np.zeros(size, np.int8)
    for m in moves:
        near[m:] += flat[:-m]
        near[:-m] += flat[m:]
    diagonal = near.astype(float)
    for face in faces:
        diagonal.reshape(grid)[face] += boundary_factor
    inverse = np.divide(1.0, diagonal, out=np.zeros(size), where=flat & (diagonal > 0))
    # every array that a sweep reads costs memory bandwidth, which is what a step waits for: single precision
    # for the preconditioner, and for the diagonal where that is exact
    inverse = inverse.astype(np.float32)
    if (diagonal == (narrow := diagonal.astype(np.float32))).all():
        diagonal = narrow
    for border in outside:
        inverse[border] = 0
    r = np.zeros(size)
    if axis or first == 1:
        r.reshape(grid)[tuple(inlet)] = boundary_factor * cells[tuple(inlet)]
    for border in outside:
        r[border] = 0
    x = np.zeros(size)
    inside = x.reshape(grid)[1:-1, 1:-1, 1:-1]
    along = [1, 1, 1]
    along[axis] = -1
    at = np.arange(first, last + 1) if axis == 0 else np.arange(1, mask.shape[axis] + 1)
    inside[...] = mask * (1 - (at - 0.5) / (planes if axis == 0 else mask.shape[axis])).reshape(along)
    p, q = np.zeros(size), np.zeros(size)
    spare = np.empty(max(layer, min(size, PIECE)))
    borders = [low, high] if line.length > 1 and len(mask) > 1 else []
    inner = slice(low.stop, high.start) if borders else slice(low.start, high.stop)
    ends = [*range(inner.start, inner.stop, len(spare)), inner.stop]
    pieces = [*borders[:1], *(slice(i, j) for i, j in zip(ends, ends[1:], strict=False)), *borders[1:]]

    def apply(s: slice) -> float:
        """q = A p on a piece's cells; p q."""
        np.multiply(diagonal[s], p[s], out=q[s])
        for m in moves:
            q[s] -= p[s.start - m : s.stop - m]
            q[s] -= p[s.start + m : s.stop + m]
        q[s] *= flat[s]
        return float(p[s] @ q[s])

    def residual(s: slice, step: float) -> tuple[float, float]:
        """r less step times q on a piece; its products with its scaled self and with itself."""
        t = spare[: s.stop - s.start]
        r[s] -= np.multiply(q[s], step, out=t)
        np.multiply(inverse[s], r[s], out=t)
        return float(t @ r[s]), float(r[s] @ r[s])

    def towards(s: slice, step: float, turn: float) -> None:
        """The values a step further along the last direction, and the next direction, on a piece."""
        t = spare[: s.stop - s.start]
        x[s] += np.multiply(p[s], step, out=t)
        p[s] *= turn
        p[s] += np.multiply(inverse[s], r[s], out=t)

    steps, step, turn = 0, 0.0, 0.0
    (scale,) = line.sums(float(r @ r))
    scale = math.sqrt(scale)
    if state is not None:
        inside[mask] = state.values
    p[:] = x
    _send_borders(line, p, low, high, outside)
    for s in pieces:
        apply(s)
    rz, square = line.sums(*map(sum, zip(*(residual(s, 1.0) for s in pieces), strict=True)))
    for border in outside:
        p[border] = 0
    if state is not None:
        steps, rz, turn = state.steps, state.rz, state.turn
        p.reshape(grid)[1:-1, 1:-1, 1:-1][mask] = state.directions
    enough, until = max(atol, rtol * scale), steps + stop_after if stop_after else None
    while math.sqrt(square) > enough and (until is None or steps < until):
        if steps >= max_iterations:
            raise NotConverged(f"no convergence in {max_iterations} iterations: relative residual {math.sqrt(square) / scale:g}")
        for s in {0: pieces[0], len(pieces) - 1: pieces[-1]}.values():
            towards(s, step, turn)
        _send_borders(line, p, low, high, outside)
        curve = 0.0
        for k in range(len(pieces) + 1):  # a piece's product needs the next piece's direction
            if 0 < k < len(pieces) - 1:
                towards(pieces[k], step, turn)
            if k:
                curve += apply(pieces[k - 1])
        (curve,) = line.sums(curve)
        if not np.isfinite(curve) or curve <= 0:
            raise NotConverged("the operator is not positive definite")
        step, old, rz, square = rz / curve, rz, 0.0, 0.0
        for s in pieces:
            scaled, own = residual(s, step)
            rz, square = rz + scaled, square + own
        rz, square = line.sums(rz, square)
        turn = rz / old
        steps += 1
    for s in pieces:
        x[s] += np.multiply(p[s], step, out=spare[: s.stop - s.start])
    directions = p.reshape(grid)[1:-1, 1:-1, 1:-1]
    return State(inside[mask], directions[mask], steps, rz, turn, math.sqrt(square) / scale if scale else 0.0, math.sqrt(square) <= enough)


def _send_borders(line: Line, flat: np.ndarray, low: slice, high: slice, outside: tuple[slice, slice]) -> None:
    """The neighbours' border planes into the planes outside."""
    for at, theirs in zip(outside, line.exchange(flat[low], flat[high]), strict=True):
        if theirs is not None:
            flat[at] = theirs


#: A solve's rows: of a finished mask the result (x null), of another its planes with their values and directions.
SOLVED = "sample string, phase int, dir int, x int, nx int, ny int, nz int, cells long, bits binary, steps long, rz double, turn double, u binary, p binary, outlet double, residual double"


def _solver(boundary_factor: float, rtol: float, max_iterations: int, steps: int):
    names = [f.split()[0] for f in SOLVED.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[f.split()[1]] for f in SOLVED.split(", ")]

    def batch(row: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row.get(n)], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def kernel(line: Line, first: int, last: int, head: dict, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        mask, axis = slab_mask(first, last, head, rows), head["dir"] - 1
        state = None
        began = line.sums(sum(r.get("u") is not None for r in rows))[0] > 0
        if began:
            joined = lambda c: np.concatenate([np.frombuffer(r[c], np.float64) for r in rows]) if rows else np.zeros(0)
            steps_, holders = line.sums(float(rows[0]["steps"]) if rows else 0.0, float(bool(rows)))
            # a slab without cells only keeps step with the others
            rz, turn = (rows[0]["rz"], rows[0]["turn"]) if rows else (1.0, 0.0)
            state = State(joined("u"), joined("p"), round(steps_ / holders), rz, turn)
        found = solve(mask, axis, boundary_factor, rtol, max_iterations, 0.0, line, first, head["nx"], state, steps)
        key = {k: head[k] for k in (*MASK, "nx", "ny", "nz")}
        if found.done:
            at = np.unravel_index(np.flatnonzero(mask), mask.shape)[axis]
            end = (head["nx"] - first) if axis == 0 else mask.shape[axis] - 1
            (outlet,) = line.sums(float(found.values[at == end].sum()))
            if line.rank == 0:
                yield batch(key | {"steps": found.steps, "residual": found.residual, "outlet": outlet})
            return
        ends = np.cumsum([0, *(r["cells"] for r in rows)])
        for k, row in enumerate(rows):
            own = slice(ends[k], ends[k + 1])
            yield batch(key | {"x": row["x"], "cells": row["cells"], "bits": row["bits"], "steps": found.steps, "rz": found.rz, "turn": found.turn, "u": found.values[own].tobytes(), "p": found.directions[own].tobytes()})

    return kernel


def physical_tortuosity(counts: DataFrame, masks: DataFrame, directions, boundary_factor: float = 2.0, rtol: float = 1e-8, max_iterations: int = 10_000, diffusivity: float = 1.0, voxel_size: float = 0.1, task_cells: int = TASK_CELLS, slabs: int | None = None, steps: int = STEPS) -> DataFrame:
    """sample, phase, dir, value, iterations, residual: share of the phase times D0 over the effective diffusivity.

    counts has voxels and total of each sample and phase, masks the planes of
    percolating voxels; infinite where nothing percolates.
    """
    for name, value in (("boundary_factor", boundary_factor), ("rtol", rtol), ("max_iterations", max_iterations), ("diffusivity", diffusivity), ("voxel_size", voxel_size)):
        if value <= 0:
            raise ValueError(f"{name} must be positive")
    kernel = _solver(boundary_factor, rtol, max_iterations, steps)
    done, open_, before = None, masks, None
    while True:
        now = stored(by_mask(open_, kernel, SOLVED, task_cells, slabs), "solves")
        ready = now.where("x is null").select(*MASK, "nx", "ny", "nz", "steps", "residual", "outlet")
        done = ready if done is None else done.unionByName(ready)
        if before is not None:
            done = stored(done, "solved")
            discard(before)
        open_, before = now.where("x is not null"), now
        if open_.isEmpty():
            break
    length = F.element_at(F.array("nx", "ny", "nz"), F.col("dir"))
    area = F.col("nx").cast("double") * F.col("ny") * F.col("nz") / length * voxel_size**2
    flux = F.col("outlet") * (boundary_factor * diffusivity * voxel_size)
    solved = done.select(*MASK, (flux * length * voxel_size / area).alias("deff"), F.col("steps").alias("iterations"), "residual")
    rows = per_direction(counts, directions).join(solved, MASK, "left")
    share = F.col("voxels") / F.col("total")
    value = F.when((F.col("voxels") > 0) & (F.col("deff") > 0), share * diffusivity / F.col("deff")).otherwise(F.lit(float("inf")))
    return rows.select(*MASK, value.alias("value"), F.coalesce("iterations", F.lit(0)).cast("long").alias("iterations"), F.coalesce("residual", F.lit(0.0)).alias("residual"))
