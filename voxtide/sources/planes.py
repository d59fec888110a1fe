"""Volumes as planes: (sample, x, nx, ny, nz, labels), one row a plane across x.

labels has the plane's voxels, z fastest, as little-endian integers of 1, 2, 4
or 8 bytes, the fewest that hold them; the width follows from the length.  A
volume in this form is shuffled as some hundred rows, and operators that need
neighbours get slabs of planes with a halo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions.tables import stored

SIZE = ("nx", "ny", "nz")
PLANES = "sample string, x int, nx int, ny int, nz int, labels binary"
#: Voxels of a slab that one task holds at most, halo not counted (a plane may be larger).
SLAB_VOXELS = 1_000_000


def packed(labels: np.ndarray) -> bytes:
    """A plane's labels in the narrowest integers."""
    low, high = (int(labels.min()), int(labels.max())) if labels.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return labels.astype(kind).tobytes()


def unpacked(data: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // cells}")


def block(rows: pa.Table, column: str = "labels") -> tuple[np.ndarray, np.ndarray]:
    """(x, labels as an array of planes) of rows of one volume, in order of x."""
    order = np.argsort(rows["x"].to_numpy(), kind="stable")
    x = rows["x"].to_numpy()[order]
    ny, nz = (rows[c][0].as_py() for c in ("ny", "nz"))
    data = rows[column]
    return x, np.stack([unpacked(data[int(k)].as_py(), ny * nz).reshape(ny, nz) for k in order])


def pack(voxels: DataFrame) -> DataFrame:
    """Voxels (sample, x, y, z, phase) as a stored table of planes; the one exchange of voxels.

    Raises ValueError if a volume has holes, repeated voxels or coordinates below 1.
    """

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            ends = np.r_[0, np.cumsum(np.diff(cells.offsets.to_numpy()))]
            ys, zs, labels = (cells.flatten().field(c).to_numpy().astype(np.int64) for c in ("y", "z", "phase"))
            out, sizes_ = [], []
            for k, x in enumerate(batch.column("x").to_pylist()):
                own = slice(ends[k], ends[k + 1])
                y, z = ys[own], zs[own]
                ny, nz = int(y.max()), int(z.max())
                sizes_.append((ny, nz))
                at = (y - 1) * nz + z - 1
                # as many as there are places, none outside and none twice: dense
                dense = len(y) == ny * nz and x >= 1 and y.min() >= 1 and z.min() >= 1 and bool((np.bincount(at, minlength=ny * nz) == 1).all())
                if dense:
                    plane = np.empty(ny * nz, np.int64)
                    plane[at] = labels[own]
                out.append(packed(plane) if dense else None)
            ny, nz = zip(*sizes_, strict=True) if sizes_ else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("sample"), batch.column("x"), pa.array(ny, pa.int32()), pa.array(nz, pa.int32()), pa.array(out, pa.binary())], names=["sample", "x", "ny", "nz", "labels"])

    rows = voxels.select(F.col("sample").cast("string").alias("sample"), *(F.col(a).cast("int").alias(a) for a in "xyz"), F.col("phase").cast("long").alias("phase"))
    gathered = rows.groupBy("sample", "x").agg(F.collect_list(F.struct("y", "z", "phase")).alias("cells"))
    return whole_volumes(stored(gathered.mapInArrow(assembled, "sample string, x int, ny int, nz int, labels binary"), "planes"))


def whole_volumes(planes: DataFrame) -> DataFrame:
    """Stored planes (sample, x, ny, nz, labels), one a sample and x, with the volume's nx; ValueError where planes are missing, null or differ in size."""
    sums = planes.groupBy("sample").agg(F.max("x").alias("nx"), F.min("x").alias("low"), F.count("labels").alias("n"), *(f("n" + a).alias(g + a) for a in "yz" for f, g in ((F.min, "low_"), (F.max, "high_"))))
    good = (F.col("low") == 1) & (F.col("n") == F.col("nx")) & (F.col("low_y") == F.col("high_y")) & (F.col("low_z") == F.col("high_z"))
    bad = sums.where(~good).first()
    if bad is not None:
        raise ValueError(f"volume {bad['sample']} is not dense")
    return planes.join(sums.select("sample", "nx"), "sample").select("sample", "x", *SIZE, "labels")


def check_axes(planes: DataFrame) -> None:
    """Raise ValueError if a volume has an axis of one voxel."""
    bad = planes.where(F.least(*SIZE) < 2).first()
    if bad is not None:
        raise ValueError(f"volume {bad['sample']} is not dense or has an axis of one voxel")


def sizes(planes: DataFrame) -> DataFrame:
    """sample, nx, ny, nz of every volume."""
    return planes.groupBy("sample").agg(*(F.first(c).alias(c) for c in SIZE))


def voxels(planes: DataFrame, column: str = "labels", to: str = "phase", bits: bool = False) -> DataFrame:
    """sample, x, y, z and the column's value of every voxel (bits: of those that are not 0)."""
    schema = f"sample string, x int, y int, z int, {to} int"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                sample, x, ny, nz, data = (batch.column(c)[k].as_py() for c in ("sample", "x", "ny", "nz", column))
                values = unpacked(data, ny * nz)
                at = np.flatnonzero(values) if bits else np.arange(ny * nz)
                columns = [pa.array([sample] * len(at), pa.string()), np.full(len(at), x, np.int32), (at // nz + 1).astype(np.int32), (at % nz + 1).astype(np.int32), values[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sample", "x", "y", "z", to])

    return planes.select("sample", "x", "ny", "nz", column).mapInArrow(rows, schema)


def in_slabs(planes: DataFrame, slab_voxels: int = SLAB_VOXELS, before: int = 0, after: int = 0) -> DataFrame:
    """planes with slab and, as x0 and x1, the slab's own first and last plane; a plane comes once for each slab that it belongs to or is in the halo of.

    A slab is as deep as its halo at least, so halos no more than double what is sent.
    """
    depth = F.greatest(F.lit(max(1, before + after)), F.floor(F.lit(slab_voxels) / (F.col("ny").cast("long") * F.col("nz")))).cast("int")
    last = F.floor((F.col("nx") - 1) / depth)
    first_slab = F.greatest(F.floor((F.col("x") - 1 - after) / depth), F.lit(0))
    slabs = F.sequence(first_slab, F.least(F.floor((F.col("x") - 1 + before) / depth), last))
    rows = planes.withColumn("slab", F.explode(slabs) if before or after else F.floor((F.col("x") - 1) / depth))
    start = F.col("slab") * depth + 1
    return rows.withColumns({"slab": F.col("slab").cast("int"), "x0": start.cast("int"), "x1": F.least(start + depth - 1, F.col("nx")).cast("int")})
