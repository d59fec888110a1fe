"""What the corpus operators share: stored tables, word hashes, streamed rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxtide.functions.tables import discard, stored

__all__ = ["Remembered", "alone", "arrow_schema", "crc_fold", "discard", "fold", "labelled_ids", "mix", "record_batch", "shingle_hashes", "shuffle_partitions", "stored", "unused", "word_hashes"]

#: Remembered words of one Python worker.
MAX_WORDS = 300_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_ids(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(id, label) of the documents with a label, each id once, with its largest label; only ids are shuffled, no texts."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    return known.join(docs.select(id_col), id_col, "left_semi")


def crc_fold(number: int, folds: int) -> int:
    return zlib.crc32(str(number).encode()) % folds


class Remembered(dict):
    """A dict that makes missing values itself and begins anew when full."""

    def __init__(self, make: Callable, limit: int = MAX_WORDS):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self._make(key)
        if len(key) <= 64:
            self[key] = value
        return value


#: The operator that a Python worker serves, and what it remembers.
_OWNER: list = [None, []]


def alone(operator: str, *caches) -> None:
    """Tell that this Python worker serves the operator now: what others remember in it is let go.

    Workers are used again from stage to stage; without this their memory
    would hold the caches of every stage that ran before.
    """
    if _OWNER[0] != operator:
        for cache in _OWNER[1]:
            cache.clear()
        _OWNER[:] = [operator, list(caches)]


def unused(taken, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of taken has it."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """The Arrow form of a Spark schema, so that columns of nulls alone still have their type; for the driver (parsing needs its session)."""
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as one typed batch."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: 64-bit hashes of words.
WORD_HASH = Remembered(lambda word: xxhash.xxh64_intdigest(word))


def word_hashes(words: list) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list, size: int) -> np.ndarray:
    """64-bit hash of every run of size words; fewer words make one run, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return mix(out)
