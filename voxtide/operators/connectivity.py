"""Percolation and geodesic distances through face neighbours, on planes.

Connected parts are found slab by slab, on runs of equal labels along z: runs
of neighbouring lines that overlap are linked and the links' components found
in the task.  Parts that touch across slabs are linked by a join of the border
planes, and the links' components, a graph of parts and not of voxels, are
found by rounds of stored tables.  Each part learns which of the volume's six
faces it touches, so one labelling serves every direction: a part percolates
along an axis if it touches both of its faces.

Distances are found by block relaxation: each slab searches its own part, level
by level, from the distances at its borders; slabs exchange border planes until
nothing changes, so rounds follow the number of slab crossings of the shortest
ways, not their length.  A mask of up to TASK_CELLS is one slab in one task, and
many masks run side by side; a larger one has a slab in each task of a line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxtide.functions.columns import literal_rows
from voxtide.functions.line import Line, along_lines
from voxtide.functions.tables import stored
from voxtide.sources.planes import SLAB_VOXELS, block, in_slabs, unpacked

KEY = ["sample", "phase"]
MASK = [*KEY, "dir"]
#: Voxels of a volume up to which a solve or a search is one task.
TASK_CELLS = 4_200_000
CONNECTED = "sample string, x int, nx int, ny int, nz int, labels binary, faces binary"
MASKS = "sample string, phase int, dir int, x int, nx int, ny int, nz int, cells long, bits binary"
DISTANCES = "sample string, phase int, dir int, x int, nx int, ny int, nz int, bits binary, steps binary"
FAR = np.iinfo(np.int32).max


def roots(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Least member of each of n things' part, by hooking the linked pairs and pointer jumping."""
    root = np.arange(n)
    while len(one):
        a, b = root[one], root[other]
        open_ = a != b
        if not open_.any():
            break
        one, other, a, b = one[open_], other[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def runs(labels: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first cell, length, part's first run) of every run of one label along the last axis, and of which wanted ones are linked.

    Cells are counted in C order; runs of labels that are not wanted are linked with none.
    """
    starts_here = np.ones(labels.shape, bool)
    starts_here[..., 1:] = labels[..., 1:] != labels[..., :-1]
    starts = np.flatnonzero(starts_here)
    number = (np.cumsum(starts_here.ravel(), dtype=np.int32) - 1).reshape(labels.shape)
    pairs = []
    for axis in (0, 1):
        a, b = [slice(None)] * 3, [slice(None)] * 3
        a[axis], b[axis] = slice(None, -1), slice(1, None)
        a, b = tuple(a), tuple(b)
        # an overlap begins where either run does
        overlap = (labels[a] == labels[b]) & wanted[a] & (starts_here[a] | starts_here[b])
        pairs.append((number[a][overlap], number[b][overlap]))
    root = roots(len(starts), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    return starts, np.diff(np.r_[starts, labels.size]), root


def _slab_parts(phases: tuple[int, ...], arrow: pa.Schema):
    """A slab's planes with its runs and their parts (number of the part's first cell in the volume), and rows of the parts that touch a face of the volume or the slab."""

    def run(rows: pa.Table) -> pa.Table:
        x, labels = block(rows)
        sample, slab, x0, x1, nx, ny, nz = (rows[c][0].as_py() for c in ("sample", "slab", "x0", "x1", "nx", "ny", "nz"))
        wanted = np.isin(labels, phases)
        starts, lengths, root = runs(labels, wanted)
        kept = wanted.ravel()[starts]
        starts, lengths, root = starts[kept], lengths[kept], starts[root[kept]]
        part = root + (x0 - 1) * ny * nz
        at = starts // (ny * nz)
        y, z = starts // nz % ny + 1, starts % nz + 1
        touched = sum((np.asarray(hit).astype(np.int64) << k for k, hit in enumerate((at + x0 == 1, at + x0 == nx, y == 1, y == ny, z == 1, z + lengths - 1 == nz))), np.zeros(len(starts), np.int64))
        open_ = (touched > 0) | (at == 0) | (at + x0 == x1)
        order = np.argsort(part[open_], kind="stable")
        parts, first = np.unique(part[open_][order], return_index=True)
        faces = np.bitwise_or.reduceat(touched[open_][order], first) if len(first) else first
        ends = np.searchsorted(at, np.arange(len(x) + 1))
        cells = starts - at * ny * nz
        n, columns = len(x), {name: [] for name in arrow.names}
        for k in range(n):
            own = slice(ends[k], ends[k + 1])
            row = {"x": int(x[k]), "labels": np.ascontiguousarray(labels[k]).tobytes(), "starts": cells[own].astype(np.int32).tobytes(), "lengths": lengths[own].astype(np.int32).tobytes(), "parts": part[own].astype(np.int64).tobytes()}
            for name in arrow.names:
                columns[name].append(row.get(name))
        columns |= {c: [v] * n for c, v in (("sample", sample), ("slab", slab), ("x0", x0), ("x1", x1), ("nx", nx), ("ny", ny), ("nz", nz))}
        none = lambda m, name: pa.nulls(m, arrow.field(name).type)
        planes = pa.table({name: pa.array(columns[name], arrow.field(name).type) for name in arrow.names})
        m = len(parts)
        own = {"sample": pa.array([sample] * m, pa.string()), "slab": pa.array([slab] * m, pa.int32()), "part": pa.array(parts.astype(np.int64)), "faces": pa.array(faces.astype(np.int32))}
        return pa.concat_tables([planes, pa.table({name: own.get(name, none(m, name)) for name in arrow.names}).cast(arrow)])

    return run


def _plane_parts(starts: bytes, lengths: bytes, parts: bytes, cells: int) -> np.ndarray:
    """The part of every cell of a plane, -1 elsewhere."""
    out = np.full(cells, -1, np.int64)
    at, n = np.frombuffer(starts, np.int32), np.frombuffer(lengths, np.int32)
    inside = np.repeat(at - np.r_[0, np.cumsum(n)[:-1]] if len(n) else at, n) + np.arange(n.sum())
    out[inside] = np.repeat(np.frombuffer(parts, np.int64), n)
    return out


def _border_links(planes: DataFrame) -> DataFrame:
    """sample, a, b: parts of neighbouring slabs with a common face; both border planes of a slab meet those of the next."""
    side = lambda end, prefix: planes.where(F.col("x") == F.col(end)).select("sample", F.col("slab"), *(F.col(c).alias(f"{prefix}{c}") for c in ("labels", "starts", "lengths", "parts")), *(["ny", "nz"] if prefix == "a_" else []))
    lower = side("x1", "a_")
    upper = side("x0", "b_").withColumn("slab", F.col("slab") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                cells = row["ny"] * row["nz"]
                a, b = (_plane_parts(row[f"{s}starts"], row[f"{s}lengths"], row[f"{s}parts"], cells) for s in ("a_", "b_"))
                same = (a >= 0) & (b >= 0) & (unpacked(row["a_labels"], cells) == unpacked(row["b_labels"], cells))
                pairs = np.unique(np.stack([a[same], b[same]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([row["sample"]] * len(pairs), pa.string()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["sample", "a", "b"])

    return lower.join(upper, ["sample", "slab"]).drop("slab").mapInArrow(run, "sample string, a long, b long")


def _tops(links: DataFrame) -> DataFrame | None:
    """sample, part, top: the least part that each linked part is connected with, by rounds of stored tables; None without links."""
    links = stored(links, "links")
    if links.isEmpty():
        return None
    both = links.unionByName(links.select("sample", F.col("b").alias("a"), F.col("a").alias("b")))
    now = stored(both.groupBy("sample", "a").agg(F.min("b").alias("b")).select("sample", F.col("a").alias("part"), F.least("a", "b").alias("top")), "tops")
    while True:
        near = both.join(now.withColumnRenamed("part", "b"), ["sample", "b"]).groupBy("sample", F.col("a").alias("part")).agg(F.min("top").alias("near"))
        step = now.join(near, ["sample", "part"]).select("sample", "part", F.least("top", "near").alias("mid"), F.col("top").alias("old"))
        up = now.select("sample", F.col("part").alias("mid"), F.col("top").alias("up"))
        after = stored(step.join(up, ["sample", "mid"]).select("sample", "part", F.least("mid", "up").alias("top"), "old"), "tops")
        now = after.select("sample", "part", "top")
        if after.where("top <> old").isEmpty():
            return now


def connected(planes: DataFrame, phases, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """planes with faces, a byte a voxel: bits 2 d - 2 and 2 d - 1 are set where its part touches the first and last face across direction d; 0 for other phases."""
    phases = tuple(int(p) for p in phases)
    schema = "sample string, slab int, x int, x0 int, x1 int, nx int, ny int, nz int, labels binary, starts binary, lengths binary, parts binary, part long, faces int"
    labelled = stored(in_slabs(planes, slab_voxels).groupBy("sample", "slab").applyInArrow(_slab_parts(phases, to_arrow_schema(StructType.fromDDL(schema))), schema), "slab-parts")
    own = labelled.where("part is null")
    parts = labelled.where("part is not null").select("sample", "slab", "part", "faces")
    tops = _tops(_border_links(own))
    if tops is not None:
        parts = parts.join(tops, ["sample", "part"], "left").withColumn("top", F.coalesce("top", "part"))
        whole = parts.groupBy("sample", "top").agg(F.bit_or("faces").alias("all"))
        parts = parts.join(whole, ["sample", "top"]).select("sample", "slab", "part", F.col("all").alias("faces"))
    parts = parts.where("faces > 0").select(*(F.col(c).alias(c) for c in ("sample", "slab", "part", "faces")))  # columns of their own beside the planes'

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found["part"].to_numpy(), kind="stable")
        part, faces = found["part"].to_numpy()[order], found["faces"].to_numpy()[order].astype(np.uint8)
        out = []
        for row in rows.to_pylist():
            cells = row["ny"] * row["nz"]
            own = _plane_parts(row["starts"], row["lengths"], row["parts"], cells)
            at = np.minimum(np.searchsorted(part, own), max(len(part) - 1, 0))
            hit = part[at] == own if len(part) else np.zeros(cells, bool)
            out.append(np.where(hit, faces[at] if len(part) else 0, 0).astype(np.uint8).tobytes())
        return rows.select(["sample", "x", "nx", "ny", "nz", "labels"]).append_column("faces", pa.array(out, pa.binary()))

    carried = own.select("sample", "slab", "x", "nx", "ny", "nz", "labels", "starts", "lengths", "parts")
    return carried.groupBy("sample", "slab").cogroup(parts.groupBy("sample", "slab")).applyInArrow(run, CONNECTED)


def mask_planes(planes: DataFrame, phases, directions) -> DataFrame:
    """sample, phase, dir, x, nx, ny, nz, cells and bits (a bit a voxel, z fastest) of the percolating voxels of connected planes; planes without any have no row."""
    wanted = [(int(p), int(d)) for p in phases for d in directions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                cells = row["ny"] * row["nz"]
                labels, faces = unpacked(row["labels"], cells), np.frombuffer(row["faces"], np.uint8)
                out = []
                for phase, direction in wanted:
                    inside = (labels == phase) & (faces >> (2 * direction - 2) & 3 == 3)
                    if n := int(inside.sum()):
                        out.append((row["sample"], phase, direction, row["x"], row["nx"], row["ny"], row["nz"], n, np.packbits(inside).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names=names)

    names = ["sample", "phase", "dir", "x", "nx", "ny", "nz", "cells", "bits"]
    kinds = [pa.string(), *[pa.int32()] * 6, pa.int64(), pa.binary()]
    return planes.mapInArrow(run, MASKS)


def bits(row: dict) -> np.ndarray:
    """A mask plane's cells as booleans."""
    return np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=row["ny"] * row["nz"]).astype(bool)


def mask_voxels(masks: DataFrame, values: str | None = None) -> DataFrame:
    """sample, phase, dir, x, y, z of every voxel of mask planes, and d, the values' number of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                at = np.flatnonzero(bits(row))
                n, nz = len(at), row["nz"]
                columns = [pa.array([row["sample"]] * n, pa.string()), *(np.full(n, row[c], np.int32) for c in ("phase", "dir", "x")), (at // nz + 1).astype(np.int32), (at % nz + 1).astype(np.int32)]
                if values:
                    columns.append(np.frombuffer(row[values], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = [*MASK, "x", "y", "z", *(["d"] if values else [])]
    schema = "sample string, phase int, dir int, x int, y int, z int" + (", d int" if values else "")
    return masks.select(*MASK, "x", "ny", "nz", "bits", *([values] if values else [])).mapInArrow(run, schema)


def percolating(planes: DataFrame, phases, directions, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """Stored mask planes of the voxels whose part touches both faces across dir."""
    return stored(mask_planes(connected(planes, phases, slab_voxels), phases, directions), "percolating")


def reachable(planes: DataFrame, phases, direction: int, far: bool, slab_voxels: int = SLAB_VOXELS) -> DataFrame:
    """sample, phase, x, y, z of the voxels connected to the first (or, far, the last) face across a direction."""
    bit = 1 << (2 * int(direction) - 2 + int(far))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                nz = row["nz"]
                labels = unpacked(row["labels"], row["ny"] * nz)
                at = np.flatnonzero(np.frombuffer(row["faces"], np.uint8) & bit)
                columns = [pa.array([row["sample"]] * len(at), pa.string()), labels[at].astype(np.int32), np.full(len(at), row["x"], np.int32), (at // nz + 1).astype(np.int32), (at % nz + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sample", "phase", "x", "y", "z"])

    return connected(planes, phases, slab_voxels).mapInArrow(run, "sample string, phase int, x int, y int, z int")


def per_direction(counts: DataFrame, directions) -> DataFrame:
    """counts (sample, phase, ...), once for each direction."""
    return counts.join(F.broadcast(literal_rows(counts.sparkSession, "dir", directions)))  # at most three rows


def percolating_fraction(counts: DataFrame, masks: DataFrame, directions) -> DataFrame:
    """sample, phase, dir, value: percolating voxels over the phase's voxels, 0 for a phase without voxels."""
    found = masks.groupBy(*MASK).agg(F.sum("cells").alias("n"))
    rows = per_direction(counts, directions).join(found, MASK, "left")
    return rows.select(*MASK, F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("voxels").cast("double")), F.lit(0.0)).alias("value"))


def slab_mask(first: int, last: int, head: dict, rows: list[dict]) -> np.ndarray:
    """The mask's planes first to last."""
    mask = np.zeros((last - first + 1, head["ny"], head["nz"]), bool)
    for row in rows:
        mask[row["x"] - first] = bits(row).reshape(mask.shape[1:])
    return mask


def by_mask(masks: DataFrame, kernel: Callable, schema: str, task_cells: int = TASK_CELLS, slabs: int | None = None) -> DataFrame:
    """kernel(line, first, last, head, rows) of every mask: those of volumes up to task_cells in a task of their own, larger ones along lines of tasks."""

    def alone(rows: pa.Table) -> pa.Table:
        each = sorted(rows.to_pylist(), key=lambda r: r["x"])
        return pa.Table.from_batches(kernel(Line(), 1, each[0]["nx"], each[0], each))

    large = F.col("nx").cast("long") * F.col("ny") * F.col("nz") > task_cells
    single = masks.where(~large).groupBy(*MASK).applyInArrow(alone, schema)
    if masks.where(large).isEmpty():
        return single
    # a table of its own: a barrier stage cannot be one side of a union
    return single.unionByName(stored(along_lines(masks.where(large), MASK, kernel, schema, slabs), "along-lines"))


def search(free: np.ndarray, dist: np.ndarray, seeds: np.ndarray, moves: np.ndarray, spare: np.ndarray) -> None:
    """Lower dist (flat, by free cells) from the seeds on, whose distances are set, level by level; spare is as long as dist."""
    seeds = seeds[np.argsort(dist[seeds], kind="stable")]
    level, next_ = dist[seeds], 0
    front, step = seeds[:0], 0
    while len(front) or next_ < len(seeds):
        if not len(front):
            step = int(level[next_])
        end = int(np.searchsorted(level, step, side="right"))
        if end > next_:
            fresh = seeds[next_:end]
            front = np.concatenate([front, fresh[dist[fresh] == step]])
            next_ = end
        near = (front[:, None] + moves).ravel()
        near = near[free[near] & (dist[near] > step + 1)]
        dist[near] = step + 1
        step += 1
        turn = np.arange(len(near), dtype=np.int32)
        spare[near] = turn  # of a cell's several ways here the last one stays
        front = near[spare[near] == turn]


def distances(mask: np.ndarray, axis: int, line: Line = Line(), last: bool = True) -> np.ndarray:
    """Steps from the last face across axis through face neighbours, -1 where it cannot be reached.

    mask is this task's slab across the first axis; last tells whether it holds the volume's last planes.
    """
    free = np.pad(mask, 1)  # an empty border: a neighbour is a fixed number of cells away
    dist = np.full(free.shape, FAR, np.int32)
    outlet = np.zeros_like(free)
    if axis or last:
        outlet.swapaxes(0, axis)[-2] = True
    moves = np.array([s * m for m in (1, free.shape[2], free.shape[1] * free.shape[2]) for s in (-1, 1)])
    dist[free & outlet] = 0
    seeds = np.flatnonzero(free & outlet)
    layer = free.shape[1] * free.shape[2]
    borders = (slice(layer, 2 * layer), slice(free.size - 2 * layer, free.size - layer))
    flat, open_, spare = dist.ravel(), free.ravel(), np.empty(free.size, np.int32)
    while True:
        search(open_, flat, seeds, moves, spare)
        found = []
        for own, theirs in zip(borders, line.exchange(flat[borders[0]], flat[borders[1]]), strict=True):
            if theirs is not None:
                nearer = np.flatnonzero(open_[own] & (theirs < flat[own] - 1))
                flat[own][nearer] = theirs[nearer] + 1
                found.append(nearer + own.start)
        seeds = np.concatenate(found) if found else seeds[:0]
        if not line.sums(len(seeds))[0]:
            return np.where(dist == FAR, -1, dist)[1:-1, 1:-1, 1:-1]


def _distance_kernel(line: Line, first: int, last: int, head: dict, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    mask = slab_mask(first, last, head, rows)
    far = distances(mask, head["dir"] - 1, line, last == head["nx"])
    for row in rows:
        k = row["x"] - first
        out = [row[c] for c in ("sample", "phase", "dir", "x", "nx", "ny", "nz", "bits")] + [far[k][mask[k]].astype(np.int32).tobytes()]
        kinds = [pa.string(), *[pa.int32()] * 6, pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names=["sample", "phase", "dir", "x", "nx", "ny", "nz", "bits", "steps"])


def geodesic_distance(masks: DataFrame, task_cells: int = TASK_CELLS, slabs: int | None = None) -> DataFrame:
    """Mask planes with steps, the number of steps of each of their voxels from the outlet face.

    Every way from inlet to outlet lies in the percolating voxels, so they are enough for tortuosity.
    """
    return by_mask(masks, _distance_kernel, DISTANCES, task_cells, slabs)


def geometric_tortuosity(counts: DataFrame, distance: DataFrame, directions) -> DataFrame:
    """sample, phase, dir, value: mean inlet distance over the straight one, infinite where nothing percolates."""
    schema = "sample string, phase int, dir int, length int, n long, total long"

    def inlet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                at, d = np.flatnonzero(bits(row)), np.frombuffer(row["steps"], np.int32).astype(np.int64)
                first = {1: np.full(len(at), row["x"] == 1), 2: at < row["nz"], 3: at % row["nz"] == 0}[row["dir"]] & (d >= 0)
                length = row[("nx", "ny", "nz")[row["dir"] - 1]]
                yield pa.RecordBatch.from_arrays([pa.array([row["sample"]], pa.string()), *(pa.array([v], pa.int32()) for v in (row["phase"], row["dir"], length)), pa.array([int(first.sum())]), pa.array([int(d[first].sum())])], names=[*MASK, "length", "n", "total"])

    sums = distance.mapInArrow(inlet, schema).groupBy(*MASK).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("length").alias("length"))
    mean = sums.select(*MASK, (F.try_divide(F.col("total").cast("double"), F.col("n").cast("double")) / F.greatest(F.col("length") - 1, F.lit(1))).alias("mean"))
    return per_direction(counts, directions).join(mean, MASK, "left").select(*MASK, F.coalesce("mean", F.lit(float("inf"))).alias("value"))
