"""Exact dedup by two-pass Bloom filtering.

Texts are equal when their UTF-8 is; of equal texts the row with the largest id
stays.  The texts are read once, for a narrow table of ids and digests.

First pass: 64-bit hashes are counted by a partial aggregation, and those hit
twice or more set bits in a Bloom filter.  The filter is a few 4 KB bitmaps,
built and merged by Spark's bitmap functions; a hash has all its bits in one
bitmap.  Its size follows the number of repeated hashes and never passes
MAX_BITMAPS (128 MB), the proven bound of its broadcast; a corpus beyond that
gets a fuller filter, so more rows shuffle, and the results stay the same.
Second pass: rows that the filter lets go are single and pass straight through;
only the others are shuffled, by digest.  Groups larger than a HEAVY-th of
those rows, at most HEAVY by their definition, meet their rows by broadcast,
the rest by a shuffle, so no task holds a hot group.

All of it is DataFrame functions.  Rows: a null text is an empty one; a null id
is the least; of rows with equal text and id one stays, whichever was stored
first in the order of the table's parts; an empty table gives no rows.  Columns
of docs pass through whatever their names; keep_id, group_size, kept and
text_sha256 are added, and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import stored, unused

#: Bits of a bitmap of Spark's bitmap functions, bits set for a hash, bits of the filter for each repeated hash.
BITMAP, PROBES, BITS_PER_HASH = 32_768, 3, 16
#: Most bitmaps of 4 KB in the filter.
MAX_BITMAPS = 32_768
#: A group with more than one in so many of the rows that shuffle is heavy.
HEAVY = 1000
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _places(hashed: Column) -> list[Column]:
    """Positions 0 to BITMAP - 1 of a hash in its bitmap, from a second hash."""
    second = F.xxhash64(F.lit(1), hashed)
    return [F.pmod(F.shiftrightunsigned(second, 15 * k), F.lit(BITMAP)) for k in range(PROBES)]


def _bitmap(hashed: Column, bitmaps: int) -> Column:
    return F.pmod(hashed, F.lit(bitmaps))


def filter_of(hashes: DataFrame, hash_col: str, max_bitmaps: int = MAX_BITMAPS) -> tuple[DataFrame, int]:
    """(number, bits) of the bitmaps of a stored table of distinct hashes, and into how many the hashes are dealt."""
    bitmaps = max(1, min(max_bitmaps, -(-hashes.count() * BITS_PER_HASH // BITMAP)))
    each = hashes.select(_bitmap(F.col(hash_col), bitmaps).alias("number"), F.explode(F.array(*_places(F.col(hash_col)))).alias("place"))
    return each.groupBy("number").agg(F.bitmap_construct_agg("place").alias("bits")), bitmaps


def repeated_filter(hashes: DataFrame, hash_col: str, max_bitmaps: int = MAX_BITMAPS) -> tuple[DataFrame, int]:
    """filter_of the hashes that occur twice or more."""
    twice = stored(hashes.groupBy(F.col(hash_col).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    return filter_of(twice, "h", max_bitmaps)


def _has(bits: Column, place: Column) -> Column:
    """Whether the bit of a place is set; the functions number bits of a byte from its lowest."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def _and(columns: list[Column]) -> Column:
    found = columns[0]
    for c in columns[1:]:
        found = found & c
    return found


def tested(rows: DataFrame, hash_col: str, bits: DataFrame, bitmaps: int, name: str) -> DataFrame:
    """rows with the boolean name: false only where the hash is surely not in the filter."""
    number, bit_col = unused([*rows.columns, name], "bitmap_number", "bitmap_bits")
    found = rows.join(F.broadcast(bits.select(F.col("number").alias(number), F.col("bits").alias(bit_col))), _bitmap(F.col(hash_col), bitmaps) == F.col(number), "left")
    hit = F.coalesce(_and([_has(F.col(bit_col), p) for p in _places(F.col(hash_col))]), F.lit(False))
    return found.withColumn(name, hit).drop(number, bit_col)


def with_suspicion(rows: DataFrame, hash_col: str, suspect: str, max_bitmaps: int = MAX_BITMAPS) -> DataFrame:
    """rows with the boolean suspect: false only where the hash surely occurs once."""
    return tested(rows, hash_col, *repeated_filter(rows.select(hash_col), hash_col, max_bitmaps), suspect)


def mark(digests: DataFrame, id_col: str = "doc_id", digest_col: str = "text_sha256", max_bitmaps: int = MAX_BITMAPS) -> DataFrame:
    """digests with keep_id, group_size and kept; every column travels, so hand over narrow rows."""
    columns = [c for c in digests.columns if c not in ("keep_id", "group_size", "kept")]
    hashed, suspect, row, key, keep_row, heavy = unused([*columns, *ADDED], "hashed", "suspect", "row", "group_key", "keep_row", "heavy")
    all_rows = stored(digests.select(*columns, F.xxhash64(digest_col).alias(hashed)), "digests")
    flagged = with_suspicion(all_rows, hashed, suspect, max_bitmaps)
    single = flagged.where(~F.col(suspect)).select(*columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # numbered as written, so that both uses below see the same numbers
    rows = stored(flagged.where(F.col(suspect)).select(*columns, F.monotonically_increasing_id().alias(row)), "suspects")
    last = F.max(F.struct(F.col(id_col).alias("keep_id"), (-F.col(row)).alias("at")))
    groups = stored(rows.groupBy(F.col(digest_col).alias(key)).agg(F.count("*").alias("group_size"), last.alias("last")).select(key, "group_size", "last.keep_id", (-F.col("last.at")).alias(keep_row)), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_heavy = F.col("group_size") > total / HEAVY
    same = F.col(digest_col) == F.col(key)
    joined = [rows.join(F.broadcast(groups.where(is_heavy)), same), rows.join(groups.where(~is_heavy).hint("merge"), same)]
    grouped = [j.select(*columns, "keep_id", "group_size", (F.col(row) == F.col(keep_row)).alias("kept")) for j in joined]
    return single.unionByName(grouped[0]).unionByName(grouped[1])


def mark_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bitmaps: int = MAX_BITMAPS) -> DataFrame:
    """docs with all columns, and keep_id, group_size, kept and text_sha256; texts of single rows are not shuffled."""
    return mark(docs.drop(*ADDED).withColumn("text_sha256", digest(F.col(text_col))), id_col, max_bitmaps=max_bitmaps)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with the columns of docs."""
    added = unused(docs.columns, "digest")[0]
    marked = mark(docs.withColumn(added, digest(F.col(text_col))), id_col, added)
    return marked.where("kept").select(*docs.columns)
