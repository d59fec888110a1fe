"""Volumes in MAT files (level 5): one file is one sample.

``format("mat")`` is a Python data source, for batches and streams.  A file's
array is read by blocks of layers across z, as it lies in the file: a file that
is not compressed is cut into partitions of layers, a compressed one is
inflated by blocks in one task, so memory stays bounded at any size.  Files are
opened by pyarrow's file systems (local or mounted folders, s3, gs, hdfs where
its library is installed); ``read_planes`` falls back to Spark's own reader of
whole files for other paths.  Files of level 7.3 (HDF5) raise an error that
says so.  A stream takes files in order of their time and path, so files must
come into the folder whole (renamed into it).
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from voxtide.functions.tables import stored
from voxtide.sources.planes import packed, unpacked, whole_volumes

#: Fixed values of the format: element type to numpy type, array class to numpy type.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MATRIX, COMPRESSED = 14, 15
#: Bytes of a block of layers (a layer at least), and of the layers of a partition.
BLOCK, PARTITION = 8 << 20, 64 << 20
STRIPS = "sample string, x int, z int, ny int, depth int, labels binary"
VOXELS = "sample string, x int, y int, z int, phase long"
#: Path schemes that pyarrow opens.
OPENED = ("", "file", "s3", "gs", "gcs", "hdfs")


class _Inflated:
    """Reads what a compressed element holds, a piece at a time."""

    def __init__(self, raw: BinaryIO, size: int):
        self._raw, self._left, self._inflate, self._ready = raw, size, zlib.decompressobj(), b""

    def read(self, n: int) -> bytes:
        out = bytearray(self._ready[:n])
        self._ready = self._ready[n:]
        while len(out) < n:
            if self._inflate.unconsumed_tail:
                piece = self._inflate.unconsumed_tail
            elif self._left:
                piece = self._raw.read(min(self._left, 1 << 20))
                self._left -= len(piece)
                if not piece:
                    break
            else:
                break
            out += self._inflate.decompress(piece, n - len(out))
        return bytes(out)


@dataclass
class Array:
    """A 3-D array in a file: its shape, how its numbers are stored, where they begin (None if compressed), and a stream that stands there."""

    shape: tuple[int, int, int]
    kind: np.dtype
    offset: int | None
    stream: object

    def labels(self, data: bytes, key: str) -> np.ndarray:
        values = np.frombuffer(data, self.kind)
        if values.dtype.kind == "f" and (not np.all(np.isfinite(values)) or np.any(values != np.round(values))):
            raise ValueError(f"{key} must hold integers")
        return values.astype(np.int64)

    def blocks(self, key: str, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(first layer, labels as nx x ny x layers) of the layers first to last - 1, in order; the stream stands at first."""
        nx, ny, nz = self.shape
        layer = nx * ny * self.kind.itemsize
        step, last = max(1, BLOCK // max(layer, 1)), nz if last is None else last
        for z in range(first, last, step):
            n = min(step, last - z)
            data = self.stream.read(n * layer)
            if len(data) < n * layer:
                raise ValueError(f"{key} ends early")
            yield z, self.labels(data, key).reshape((nx, ny, n), order="F")


def find_array(raw: BinaryIO, key: str = "C") -> Array:
    """The 3-D numeric array named key of an open file; ValueError if there is none."""
    head = raw.read(128)
    if head[:8] == b"\x89HDF\r\n\x1a\n" or b"MATLAB 7.3" in head:
        raise ValueError("MAT files of level 7.3 (HDF5) cannot be read: save as level 5")
    order = "<" if head[126:128] == b"IM" else ">"

    def element(stream) -> tuple[int, int, bytes | None]:
        """(type, size, body of a small element) at the stream; a small element's size and type share a word."""
        tag = stream.read(8)
        if len(tag) < 8:
            raise ValueError("the file ends early")
        kind, size = struct.unpack(f"{order}II", tag)
        return (kind & 0xFFFF, kind >> 16, tag[4 : 4 + (kind >> 16)]) if kind >> 16 else (kind, size, None)

    def body(stream) -> bytes:
        _, size, small = element(stream)
        return small if small is not None else stream.read(size + -size % 8)[:size]

    at = 128
    while True:
        raw.seek(at)
        tag = raw.read(8)
        if len(tag) < 8:
            raise ValueError(f"there is no array {key}")
        kind, size = struct.unpack(f"{order}II", tag)
        stream, inner = raw, kind
        if kind == COMPRESSED:
            stream = _Inflated(raw, size)
            inner = element(stream)[0]
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)
        if inner != MATRIX:
            continue
        flags, shape, name = (body(stream) for _ in range(3))
        if name.rstrip(b"\0").decode() != key:
            continue
        shape = tuple(np.frombuffer(shape, f"{order}i4").tolist())
        if len(shape) != 3:
            raise ValueError(f"{key} must have three dimensions, not {len(shape)}")
        if (struct.unpack_from(f"{order}I", flags)[0] & 0xFF) not in CLASSES:
            raise ValueError(f"{key} must be a numeric array")
        stored_as, _, small = element(stream)
        kind = np.dtype(order + TYPES[stored_as])
        if small is not None:
            return Array(shape, kind, None, io.BytesIO(small))
        return Array(shape, kind, None if stream is not raw else raw.tell(), stream)


def read_array(data: bytes, key: str = "C") -> np.ndarray:
    """The 3-D integer array named key of a file's bytes; integral floats are accepted; ValueError otherwise."""
    found = find_array(io.BytesIO(data), key)
    return np.concatenate([block for _, block in found.blocks(key)], axis=2)


def write_array(labels: np.ndarray, key: str = "C", compress: bool = True) -> bytes:
    """A level 5 file with one int8, int16, int32, int64 or double array."""
    kinds = {"int8": (8, 1), "int16": (10, 3), "int32": (12, 5), "int64": (14, 12), "float64": (6, 9)}
    array_class, kind = kinds[labels.dtype.name]

    def element(code: int, body: bytes) -> bytes:
        return struct.pack("<II", code, len(body)) + body + b"\0" * (-len(body) % 8)

    body = element(6, struct.pack("<II", array_class, 0)) + element(5, np.array(labels.shape, "<i4").tobytes())
    body += element(1, key.encode()) + element(kind, labels.astype(labels.dtype.newbyteorder("<")).tobytes(order="F"))
    whole = element(MATRIX, body)
    if compress:
        packed_ = zlib.compress(whole)
        whole = struct.pack("<II", COMPRESSED, len(packed_)) + packed_
    out = io.BytesIO()
    out.write(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + whole)
    return out.getvalue()


def list_files(spark: SparkSession, folder: str, max_files: int | None = None) -> list[str]:
    """Paths of the folder's .mat files (in either case), sorted; ValueError if there are none."""
    if max_files is not None and max_files <= 0:
        raise ValueError("max_files must be positive")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][aA][tT]").load(folder).select("path")
    ordered = files.orderBy("path")
    paths = [r.path for r in (ordered.limit(max_files) if max_files else ordered).collect()]
    if not paths:
        raise ValueError(f"there are no .mat files in {folder}")
    return paths


def sample_name(path: str) -> str:
    return re.search(r"([^/]+?)(\.[^./]*)?$", path)[1]


def scheme(path: str) -> str:
    return path.split(":", 1)[0] if re.match(r"[A-Za-z][\w+.-]*:/", path) else ""


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; file:/a and file:///a are local."""
    kind = scheme(path)
    if kind in ("", "file"):
        return pafs.LocalFileSystem(), "/" + path.split(":", 1)[1].lstrip("/") if kind else path
    return pafs.FileSystem.from_uri(path)


def found_files(path: str) -> list[tuple[int, str]]:
    """(time in ns, path) of the .mat files of a folder, or of one file; paths keep their scheme."""
    system, inner = file_system(path)
    about = system.get_file_info(inner)
    each = system.get_file_info(pafs.FileSelector(inner, recursive=False)) if about.type == pafs.FileType.Directory else [about]
    prefix = f"{scheme(path)}://" if scheme(path) not in ("", "file") else ""
    return sorted((f.mtime_ns or 0, prefix + f.path) for f in each if f.type == pafs.FileType.File and f.path.lower().endswith(".mat"))


@dataclass
class Layers(InputPartition):
    """Layers first to last - 1 of a file's array; last None: all, from a compressed file."""

    path: str
    first: int = 0
    last: int | None = None


class _Reading:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.key, self.rows = options.get("key", "C"), options.get("rows", "voxels")
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        if not self.paths:
            raise ValueError("a path is needed")
        if self.rows not in ("voxels", "strips"):
            raise ValueError("rows must be voxels or strips")

    def cut(self, paths: list[str]) -> list[Layers]:
        out = []
        for path in paths:
            with _opened(path) as raw:
                found = _named(path, lambda raw=raw: find_array(raw, self.key))
            nx, ny, nz = found.shape
            step = max(1, PARTITION // max(1, nx * ny * found.kind.itemsize))
            out += [Layers(path)] if found.offset is None else [Layers(path, z, min(z + step, nz)) for z in range(0, nz, step)]
        return out

    def read(self, part: Layers) -> Iterator[pa.RecordBatch]:
        sample = sample_name(part.path)
        with _opened(part.path) as raw:
            found = _named(part.path, lambda: find_array(raw, self.key))
            nx, ny, nz = found.shape
            if found.offset is not None:
                raw.seek(found.offset + part.first * nx * ny * found.kind.itemsize)
            blocks = found.blocks(self.key, part.first, part.last)
            while (got := _named(part.path, lambda: next(blocks, None))) is not None:
                z, labels = got
                yield from (_strips if self.rows == "strips" else _voxels)(sample, z, labels)


def _opened(path: str):
    system, inner = file_system(path)
    return system.open_input_file(inner)


def _named(path: str, do):
    try:
        return do()
    except ValueError as error:
        raise ValueError(f"{path}: {error}") from error


def _strips(sample: str, z: int, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    nx, ny, depth = labels.shape
    own = lambda v: np.full(nx, v, np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([sample] * nx), np.arange(1, nx + 1, dtype=np.int32), own(z + 1), own(ny), own(depth), pa.array([packed(p) for p in labels], pa.binary())], names=["sample", "x", "z", "ny", "depth", "labels"])


def _voxels(sample: str, z: int, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    nx, ny, depth = labels.shape
    x, y = (c.ravel().astype(np.int32) + 1 for c in np.indices((nx, ny)))
    for k in range(depth):
        yield pa.RecordBatch.from_arrays([pa.array([sample] * (nx * ny)), x, y, np.full(nx * ny, z + k + 1, np.int32), labels[:, :, k].ravel()], names=["sample", "x", "y", "z", "phase"])


class MatReader(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        files = [f for path in self.paths for _, f in found_files(path)]
        if not files:
            raise ValueError(f"there are no .mat files in {self.paths[0]}")
        return self.cut(sorted(files))


class MatStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the time and path of the last file taken."""

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:
        files = [f for path in self.paths for f in found_files(path)]
        time, path = max(files, default=(0, ""))
        return {"time": str(time), "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((int(o["time"]), o["path"]) for o in (start, end))
        return self.cut(sorted(p for path in self.paths for t, p in found_files(path) if low < (t, p) <= high))


class MatDataSource(DataSource):
    """Options: key (the array's name, C), rows (voxels, or strips: the parts of planes across x that lie in a block of layers)."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return STRIPS if self.options.get("rows") == "strips" else VOXELS

    def reader(self, schema) -> DataSourceReader:
        return MatReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MatStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatDataSource)


def planes_of_strips(strips: DataFrame) -> DataFrame:
    """Stored planes of volumes whose strips are all there; ValueError otherwise."""

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, nz = [], []
            for ny, parts in zip(batch.column("ny").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                parts = sorted(parts, key=lambda p: p["z"])
                starts = np.cumsum([1, *(p["depth"] for p in parts)])
                whole = [p["z"] for p in parts] == starts[:-1].tolist()
                nz.append(int(starts[-1]) - 1)
                out.append(packed(np.concatenate([unpacked(p["labels"], ny * p["depth"]).reshape(ny, -1).astype(np.int64) for p in parts], axis=1)) if whole else None)
            yield pa.RecordBatch.from_arrays([batch.column("sample"), batch.column("x"), batch.column("ny"), pa.array(nz, pa.int32()), pa.array(out, pa.binary())], names=["sample", "x", "ny", "nz", "labels"])

    gathered = strips.groupBy("sample", "x", "ny").agg(F.collect_list(F.struct("z", "depth", "labels")).alias("parts"))
    return whole_volumes(stored(gathered.mapInArrow(assembled, "sample string, x int, ny int, nz int, labels binary"), "planes"))


def read_strips(spark: SparkSession, paths: list[str], key: str = "C") -> DataFrame:
    """Strips of the files, by the data source, or, where pyarrow opens no such path, from whole files (2 GB at most) that Spark reads."""
    if all(scheme(p) in OPENED for p in paths):
        register(spark)
        return spark.read.format("mat").option("rows", "strips").option("key", key).option("paths", "\n".join(paths)).load()
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                found = _named(path, lambda content=content: find_array(io.BytesIO(content.as_py()), key))
                for z, labels in found.blocks(key):
                    yield from _strips(sample_name(path), z, labels)

    return files.mapInArrow(run, STRIPS)


def read_planes(spark: SparkSession, paths: list[str], key: str = "C") -> DataFrame:
    """Stored planes of every file."""
    return planes_of_strips(read_strips(spark, paths, key))
