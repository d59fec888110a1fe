"""Hard negatives by threshold joins.

Anchors meet all rows in a grid: rows and anchors are dealt by hash to chunks of
a bounded size, and a task holds one chunk of each.  In it the rows are an
inverted index over pieces of the dimensions, those of most energy over all
rows first.  A row's trailing pieces are omitted from the index when the norm of
what they hold, times the anchors' norms there, cannot reach any anchor's
threshold.  Partial scores are accumulated list by list; a pair goes as soon as
its partial score and the product of the remaining norms stay below the
anchor's threshold; what is left gets its exact integer score.

Thresholds begin where, by mean and spread of the scores over all rows, a few
more rows than wanted lie above, and are lowered for the anchors whose windows
are not full: first for the positives of an anchor, then for the windows of
negatives, down to a window's end, where it is whole by definition.  A chunk
hands on the best few of each anchor or window, so neither a hot label nor
thousands of copies fill a task, and nothing that belongs to a result is lost.

Rows: those with a null label, a null vector, or a null or non-finite component
take no part; an empty vector takes part (its scores are 0); vectors of
different lengths compare as if zeros followed; rows that repeat are rows, also
as anchors; a row of null id is never an anchor and comes last in ties; rows of
equal score and id come in the order of the table's parts.  Vectors whose
scores could pass 2**53 are an error.  No rows or no anchors give no result.
Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtide.llm.common import alone, arrow_schema, shuffle_partitions, stored
from voxtide.llm.vafile import whole_vectors

#: Dimensions of a piece; rows that a task scores at once.
PIECE, ROWS = 8, 2048
#: Least and most vectors of a chunk.
CHUNK = (1024, 32_768)
#: Share of pairs below which the rest are scored one by one.
FEW = 0.125
#: Rows that a first threshold is meant to let through, and by how much the share grows with each lowering.
WANTED, STEPS = {"positives": 200, "negatives": 40}, (1, 64)


@dataclass
class Scores:
    """How the rows are spread: order of the dimensions, their means and variances, number of rows."""

    order: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    n: int

    def vectors(self, column: pa.Array) -> np.ndarray:
        """Rows of an Arrow column of arrays, zeros after their end, dimensions in order; their products are exact in floats."""
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(column), len(self.order)))
        at = np.repeat(np.arange(len(column)), lengths)
        out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        return out[:, self.order]

    def threshold(self, q: np.ndarray, share: float, below: float = math.inf) -> float:
        """A score that about the share of all rows reaches without passing below."""
        mean, spread = float(q @ self.mean), math.sqrt(float((q * q) @ self.variance)) or 1.0
        above = 0.5 * math.erfc((below - mean) / spread / math.sqrt(2)) if below < math.inf else 0.0
        share += above
        return -math.inf if share >= 1 else mean + spread * NormalDist().inv_cdf(1 - share)


class Index:
    """Inverted index of a block of vectors over pieces of their dimensions."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.starts = list(range(0, x.shape[1], PIECE))
        self.rest = self.norms(x)

    def norms(self, x: np.ndarray) -> np.ndarray:
        """Norm of what follows from each piece on, and 0 at the end; a little more than exact."""
        squares = [np.square(x[:, s : s + PIECE]).sum(1) for s in self.starts]
        tails = np.cumsum(np.stack([*squares, np.zeros(len(x))], 1)[:, ::-1], 1)[:, ::-1]
        return np.sqrt(tails) * (1 + 1e-9)

    def reaching(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of all pairs with a score of at least the anchor's threshold."""
        n, pieces, q_rest = len(self.x), len(self.starts), self.norms(q)
        if n == 0 or len(q) == 0:
            return (np.zeros(0, np.int64),) * 3
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = np.where(least[:, None] > 0, least[:, None] / q_rest, -np.inf).min(0)
        unreachable = self.rest < cut  # the last column is norm 0: true for positive thresholds
        ends = np.where(unreachable.any(1), unreachable.argmax(1), pieces)
        order = np.argsort(-ends, kind="stable")
        ends, x, rest = ends[order], self.x[order], self.rest[order]
        scores = np.zeros((n, len(q)))
        pairs = None
        for piece, start in enumerate(self.starts):
            listed = int(np.searchsorted(-ends, -piece))  # rows that have this piece in the index
            if listed == 0:
                break
            scores[:listed] += x[:listed, start : start + PIECE] @ q[:, start : start + PIECE].T
            if piece % 2 == 1 or piece + 1 == pieces:
                at = np.minimum(piece + 1, ends)
                alive = scores + rest[np.arange(n), at][:, None] * q_rest[:, at].T >= least
                if alive.mean() < FEW:
                    pairs = np.nonzero(alive)
                    break
        if pairs is None:
            if (ends == pieces).all():  # every list was read: the sums are the scores
                pairs = np.nonzero(scores >= least)
                return order[pairs[0]], pairs[1], scores[pairs].astype(np.int64)
            pairs = np.nonzero(scores + (rest[np.arange(n), ends][:, None] * q_rest[:, ends].T) >= least)
        exact = np.empty(len(pairs[0]))
        for start in range(0, len(exact), 65_536):
            part = slice(start, start + 65_536)
            exact[part] = (x[pairs[0][part]] * q[pairs[1][part]]).sum(1)
        hit = exact >= least[pairs[1]]
        return order[pairs[0][hit]], pairs[1][hit], exact[hit].astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, place: np.ndarray, limit: int) -> np.ndarray:
    """Numbers of the first rows of every group: higher scores first, then lower places."""
    order = np.lexsort((place, -score, group))
    sorted_ = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < limit]


class Best:
    """The first few (row, score) of every anchor so far, and the threshold that follows."""

    def __init__(self, anchors: int, limit: int):
        self.limit, self.anchors = limit, anchors
        self.anchor, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, anchor, row, score, place) -> None:
        anchor, row, score = np.r_[self.anchor, anchor], np.r_[self.row, row], np.r_[self.score, score]
        kept = best(anchor, score, place[row], self.limit)
        self.anchor, self.row, self.score = anchor[kept], row[kept], score[kept]

    def raised(self, least: np.ndarray) -> np.ndarray:
        """Where an anchor has its few, a row must reach the last of them."""
        full = np.bincount(self.anchor, minlength=self.anchors) >= self.limit
        last = np.full(self.anchors, np.inf)
        np.minimum.at(last, self.anchor, self.score)
        return np.where(full, np.maximum(least, last), least)


def _places(ids: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """Order of the rows by id, nulls last, then by number."""
    table = pa.table({"id": ids, "row": rows})
    order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def spread(vectors: DataFrame) -> Scores:
    """Mean, variance and energy of every dimension over all rows: d numbers, summed where the rows lie."""
    n = vectors.count()
    each = vectors.select(F.posexplode("x").alias("at", "value")).select("at", F.col("value").cast("double").alias("value"))
    rows = each.groupBy("at").agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.max(F.abs("value")).alias("largest")).orderBy("at").collect()
    sums, squares = (np.array([r[k] for r in rows], np.float64) for k in ("sum", "squares"))
    largest = int(max([0, *(r["largest"] for r in rows)]))
    if largest * largest * len(rows) >= 2**53:
        raise ValueError("scores could pass 2**53")
    order = np.argsort(-squares, kind="stable")
    mean = sums / max(n, 1)
    return Scores(order, mean[order], np.maximum(squares / max(n, 1) - mean**2, 0)[order], n)


def _chunk(n: int, spark) -> int:
    return min(CHUNK[1], max(CHUNK[0], -(-n // (4 * shuffle_partitions(spark)))))


def grid(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, task, schema: str) -> DataFrame:
    """task(anchors, rows) of every chunk of rows with every chunk of anchors; a chunk is bounded on both sides."""
    size = _chunk(n, rows.sparkSession)
    down, across = -(-n // size), -(-n_anchors // size)
    hashed = F.pmod(F.xxhash64("row"), F.lit(down)).cast("int")
    dealt = rows.select("*", hashed.alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))
    hashed = F.pmod(F.xxhash64("row"), F.lit(across)).cast("int")
    queries = anchors.select("*", hashed.alias("across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))
    key = ("down", "across")
    return queries.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(task, schema)


def _positives_task(scores: Scores, share: float, wanted: int, arrow: pa.Schema):
    def task(queries: pa.Table, rows: pa.Table) -> pa.Table:
        alone("negatives")
        q, x = (scores.vectors(t["x"].combine_chunks()) for t in (queries, rows))
        own, others, labels, of = (t[c].to_numpy() for t, c in ((queries, "row"), (rows, "row"), (queries, "label"), (rows, "label")))
        place = _places(rows["id"], others)
        least = np.array([scores.threshold(v, share) for v in q])
        found = Best(len(q), wanted)
        for label in np.unique(labels):
            mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(of == label)
            for start in range(0, len(theirs), ROWS):
                part = theirs[start : start + ROWS]
                r, a, s = Index(x[part]).reaching(q[mine], found.raised(least)[mine])
                r, a = part[r], mine[a]
                other = own[a] != others[r]
                found.add(a[other], r[other], s[other], place)
        return pa.table({"row": own[found.anchor], "other": others[found.row], "id": rows["id"].take(pa.array(found.row)), "score": found.score}).cast(arrow)

    return task


def find_positives(vectors: DataFrame, anchors: DataFrame, scores: Scores, wanted: int) -> DataFrame:
    """row (of the anchor), place from 1, id and score of the first other rows of every anchor's label."""
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"row long, other long, id {id_type}, score long"
    arrow = arrow_schema(schema)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    open_, done = anchors, []
    for share in (*(min(0.5, WANTED["positives"] * s / max(1, scores.n)) for s in STEPS), 1.0):
        n_anchors = open_.count()
        if n_anchors == 0:
            break

        first = grid(vectors, open_, scores.n, n_anchors, _positives_task(scores, share, wanted, arrow), schema).withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
        first = stored(first, "positives")
        if share < 1:
            full = first.where(F.col("place") == wanted).select("row")
            done.append(first.join(full, "row", "left_semi"))
            open_ = stored(open_.join(full, "row", "left_anti"), "open-anchors")
        else:
            done.append(first)
    out = done[0] if done else stored(vectors.limit(0).select("row", F.col("row").alias("other"), "id", F.lit(0).cast("long").alias("score"), F.lit(1).alias("place")), "positives")
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row", "place", "id", "score")


def _negatives_task(scores: Scores, share: float, wanted: int, arrow: pa.Schema):
    def task(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        alone("negatives")
        q, x = (scores.vectors(t["x"].combine_chunks()) for t in (queries, rows))
        own, others, labels, of = (t[c].to_numpy() for t, c in ((queries, "row"), (rows, "row"), (queries, "label"), (rows, "label")))
        place = _places(rows["id"], others)
        each = [{w["place"]: (w["low"], w["high"]) for w in ws} for ws in queries["windows"].to_pylist()]
        numbers = sorted({k for ws in each for k in ws})
        low, high, least, found = {}, {}, {}, {k: Best(len(q), wanted) for k in numbers}
        for k in numbers:
            low[k], high[k] = (np.array([ws.get(k, (np.inf, -np.inf))[end] for ws in each], np.float64) for end in (0, 1))
            guess = [scores.threshold(v, share, h) if math.isfinite(h) else 0 for v, h in zip(q, high[k], strict=True)]
            least[k] = np.maximum(low[k], np.ceil(np.minimum(guess, high[k])))
        for start in range(0, len(x) if numbers else 0, ROWS):
            part = slice(start, start + ROWS)
            now = {k: found[k].raised(least[k]) for k in numbers}
            r, a, s = Index(x[part]).reaching(q, np.min([now[k] for k in numbers], 0))
            r = r + start
            differ = labels[a] != of[r]
            r, a, s = r[differ], a[differ], s[differ]
            for k in numbers:
                inside = (s >= now[k][a]) & (s <= high[k][a])
                found[k].add(a[inside], r[inside], s[inside], place)
        parts = []
        for k in numbers:
            f = found[k]
            parts.append(pa.table({"row": own[f.anchor], "window": np.full(len(f.row), k, np.int32), "other": others[f.row], "id": rows["id"].take(pa.array(f.row)), "score": f.score, "whole": (least[k] <= low[k])[f.anchor]}).cast(arrow))
            # a window that has come to its end is whole, however few it holds; the first chunk of rows says so
            ended = np.flatnonzero((least[k] <= low[k]) & np.isfinite(low[k]) & (key[0].as_py() == 0))
            parts.append(pa.table({"row": own[ended], "window": np.full(len(ended), k, np.int32), "other": pa.nulls(len(ended), pa.int64()), "id": pa.nulls(len(ended), arrow.field("id").type), "score": pa.nulls(len(ended), pa.int64()), "whole": np.ones(len(ended), bool)}).cast(arrow))
        return pa.concat_tables(parts) if parts else arrow.empty_table()

    return task


def find_negatives(vectors: DataFrame, windows: DataFrame, scores: Scores, wanted: int) -> DataFrame:
    """row (of the anchor), window, rank from 1, id and score of the first rows of other labels in every window.

    windows: row, label, x and windows, an array of (place, low, high), both ends included.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"row long, window int, other long, id {id_type}, score long, whole boolean"
    arrow = arrow_schema(schema)
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    open_, done = windows, []
    for share in (*(min(0.5, WANTED["negatives"] * s / max(1, scores.n)) for s in STEPS), 1.0):
        n_anchors = open_.count()
        if n_anchors == 0:
            break

        all_found = stored(grid(vectors, open_, scores.n, n_anchors, _negatives_task(scores, share, wanted, arrow), schema), "window-parts")
        first = stored(all_found.where(F.col("other").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted), "negatives")
        if share < 1:
            full = first.where(F.col("rank") == wanted).select("row", "window").unionByName(all_found.where("whole").select("row", "window")).distinct()
            full = stored(full, "full-windows")
            done.append(first.join(full, ["row", "window"], "left_semi"))
            listed = full.groupBy("row").agg(F.collect_set("window").alias("full"))
            rest = F.filter("windows", lambda w: ~F.array_contains(F.coalesce("full", F.array().cast("array<int>")), w["place"]))
            open_ = stored(open_.join(listed, "row", "left").withColumn("windows", rest).where(F.size("windows") > 0).drop("full"), "open-windows")
        else:
            done.append(first)
    empty = vectors.limit(0).select("row", F.lit(1).alias("window"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    out = empty
    for more in done:
        out = out.unionByName(more.select("row", "window", "rank", "id", "score"))
    return out


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor's hard negatives.

    anchor tells the anchors among rows; low and high are per cent of a
    positive's score between which a negative's lies.
    """
    label = F.col("label") if label is None else label
    chosen = whole_vectors(rows.where(label.isNotNull()), id_col, vector_col, None, scale, (label.alias("label"), (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("anchor")))
    vectors = stored(chosen.withColumn("row", F.monotonically_increasing_id()), "vectors")
    scores = spread(vectors)
    anchors = vectors.where("anchor").select("row", "id", "label", "x")
    table = vectors.select("row", "id", "label", "x")
    first = stored(find_positives(table, anchors, scores, positives), "first-positives")
    exact = F.col("score").cast("decimal(20,0)")
    ends = first.select("row", "place", F.ceil(exact * low / 100).cast("long").alias("low"), F.floor(exact * high / 100).cast("long").alias("high"))
    listed = ends.where("low <= high").groupBy("row").agg(F.collect_list(F.struct("place", "low", "high")).alias("windows"))
    windows = stored(anchors.select("row", "label", "x").join(listed, "row"), "windows")
    found = find_negatives(table, windows, scores, negatives)
    out = first.select("row", F.col("place").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score"), ["row", "window"])
    return out.join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
