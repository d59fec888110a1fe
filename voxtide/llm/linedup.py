"""Removal of lines that spread over many sites.

A line is boilerplate when it stands on MIN_SITES distinct sites or more,
whatever else its pages hold: every line of a footer goes, however many lines
it has.  The first occurrence (least id, then text hash, then place) of a
boilerplate line stays, so that no passage is lost: a page that was copied
whole to many sites stays whole once.

Texts are read three times: to count lines, to set apart the occurrences of
those lines that are frequent enough to spread so far (through a Bloom filter
of bounded size, so lines that are not are never shuffled), and to write the
result.  Distinct sites are HyperLogLog sketches per line hash, merged by
aggregation; lines whose estimate comes near the threshold are counted exactly.
Lines that make up more than a HEAVY-th of these occurrences, at most HEAVY by
their definition, meet their occurrences by broadcast, all others by a shuffle,
so no task holds a common line's occurrences.

All of it is DataFrame functions.  Rows: a null text stays null and has no
lines, blank lines are never boilerplate, a null site is not counted, rows
that repeat whole are one document, an id that comes with two texts is two
documents, a null id is an id and the least; long texts are split whole.
Columns of docs pass through whatever their names; n_lines and n_removed are
added, and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm import exactdedup
from voxtide.llm.common import stored, unused

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers; estimates within this share of the threshold are counted exactly (five standard errors).
LOG_REGISTERS, NEAR = 12, 0.09
#: A line with more than one in so many of the frequent lines' occurrences is heavy.
HEAVY = 1000
LINE, DOC = ["h1", "h2"], ["id", "row_key"]


def _row_key(text_col: str) -> Column:
    """Tells apart texts under one id."""
    return F.xxhash64(text_col)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Every line that is not blank: id, row_key, site, place, line hashes h1 and h2."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _row_key(text_col).alias("row_key"), F.col(site_col).alias("site"), F.split(text_col, "\n", -1).alias("split"))
    each = texts.select("id", "row_key", "site", F.posexplode("split").alias("place", "line")).where(F.trim("line") != "")
    return each.select("id", "row_key", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def of_lines(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows of the chosen lines (h1, h2, heavy and others), with chosen's columns: heavy ones by broadcast, the rest by a shuffle."""
    heavy = F.broadcast(chosen.where("heavy").drop("heavy"))
    light = chosen.where("not heavy").drop("heavy")
    return rows.join(heavy, LINE).unionByName(rows.join(light.hint("merge"), LINE))


def spread(rows: DataFrame, chosen: DataFrame, min_sites: int) -> DataFrame:
    """chosen (h1, h2, heavy) lines that rows (h1, h2, site) have on at least min_sites sites."""
    sketched = rows.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("sites"))
    sketched = stored(chosen.join(sketched, LINE).where(F.col("sites") >= min_sites * (1 - NEAR)), "line-sites")
    close = F.abs(F.col("sites") - min_sites) <= NEAR * min_sites
    pairs = of_lines(rows.select(*LINE, "site"), sketched.where(close).select(*LINE, "heavy")).where(F.col("site").isNotNull())
    exact = pairs.groupBy(*LINE, "site").agg(F.lit(1).alias("one")).groupBy(*LINE).agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return sketched.where(~close).select(*LINE, "heavy").unionByName(sketched.where(close).join(exact, LINE, "left_semi").select(*LINE, "heavy"))


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """id, row_key and gone (sorted places of the lines that go) of the documents that lose any."""
    rows = lines(docs, id_col, text_col, site_col)
    often = stored(rows.groupBy(*LINE).agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "place")).alias("first")).where(F.col("n") >= min_sites), "often")
    hits = stored(exactdedup.tested(rows, "h1", *exactdedup.filter_of(often, "h1"), "frequent").where("frequent").drop("frequent"), "frequent-lines")
    total = often.agg(F.sum("n")).first()[0] or 0
    bad = spread(hits, often.select(*LINE, (F.col("n") > total / HEAVY).alias("heavy")), min_sites)
    bad = stored(bad.join(often.select(*LINE, "first"), LINE), "boilerplate")
    gone = of_lines(hits, bad).where(F.struct(*DOC, "place") != F.col("first"))
    return gone.groupBy(*DOC).agg(F.sort_array(F.collect_set("place")).alias("gone"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines and n_removed; one shuffle moves the texts."""
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key, gone_id, gone_key, gone, split = unused(docs.columns, "row_key", "gone_id", "gone_key", "gone", "split_lines")
    marked = boilerplate(docs, id_col, text_col, site_col, min_sites).select(F.col("id").alias(gone_id), F.col("row_key").alias(gone_key), F.col("gone").alias(gone))
    keyed = docs.withColumn(key, _row_key(text_col))
    joined = keyed.join(marked, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left").withColumn(split, F.split(text_col, "\n", -1))
    size = F.size(split)
    starts = F.concat(F.array(F.lit(1)), F.transform(gone, lambda p: p + 2))
    ends = F.concat(F.col(gone), F.array(size))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("from"), ends.alias("to")), lambda s: F.slice(split, s["from"], s["to"] - s["from"] + 1)))
    cleaned = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text_col else F.col(c) for c in kept_columns]
    return joined.select(*columns, F.coalesce(size, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
