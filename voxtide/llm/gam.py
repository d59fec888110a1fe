"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins.  The model is one lookup table per
feature and one per chosen pair of features; a text's log-odds are the sum of
the entries that its bins select.  The tables are learnt by cyclic boosting:
features take turns, each turn fits a tree of at most three leaves over one
feature's bins to the logistic gradient and adds a small step of it.  Then the
pairs whose quadrants would best explain what is left take turns likewise.

Fitting uses a sample of labelled rows of bounded, documented size; scoring
adds bins with numpy.  Rows: a null text counts as empty and is scored like
any other; without labelled rows of both kinds the score is their share (0.5
without any); rows that repeat are scored each, an empty table gives no rows.
Of equal hashed ids the least comes first into the sample, an id that repeats
counts once, null ids and labels are not used.  Columns of docs pass through
whatever their names; score is added, or replaces a column so named.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import alone, labelled_ids

#: At most so many labelled rows are used to fit.
MAX_LABELLED = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, PENALTY = 24, 120, 60, 6, 0.15, 4.0

FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "marked_words", "pipes", "exclaimed",
    "distinct_words", "top_word", "repeated_next", "repeated_lines", "line_words", "sentence_words", "other_letters",
)
_UPPER, _DIGITS, _MARKS, _ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\=+_", b".!?"
_MARKED = re.compile(rb"[#$%&*@^~]{2,}").findall


def text_features(text: str) -> list[float]:
    """The features of a whole text, each bounded and defined for empty texts."""
    data = text.encode("utf-8", "surrogatepass")
    words, n = data.split(), max(1, len(data))
    few = max(1, len(words))
    gone = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = max(counts.values(), default=0)
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(len(words)), (n - len(words)) / few if words else 0.0, gone(_UPPER) / n, gone(_DIGITS) / n, gone(_MARKS) / n,
        len(_MARKED(data)) / few, data.count(b"|") / few, data.count(b"!!") / few, len(counts) / few**0.85, top / few, again / few,
        1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), len(words) / (1 + gone(_ENDS)),
        (len(data) - len(text)) / n,
    ]


@dataclass
class Gam:
    """Bin bounds of each feature, a table each, and (i, j, table) for the pairs."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), int)

    def odds(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        for i, table in enumerate(self.tables):
            out += table[b[:, i]]
        for i, j, table in self.pairs:
            out += table[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step of each bin: the best tree of at most three leaves on sums of gradient g and curvature h."""
    edges = [0, len(g)]
    for _ in range(2):
        best = None
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            k = int(gains.argmax())
            if best is None or gains[k] > best[0]:
                best = (gains[k], a + k + 1)
        if best is None or best[0] <= 0:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + PENALTY)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step): the best cut of both features at once, on tables of sums."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = np.zeros((len(g) - 1, g.shape[1] - 1))
    for a, b in (("low", "low"), ("low", "high"), ("high", "low"), ("high", "high")):
        part = []
        for c in (cg, ch):
            ll, row, col, everything = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
            part.append({"lowlow": ll, "lowhigh": row - ll, "highlow": col - ll, "highhigh": everything - row - col + ll}[a + b])
        total += _gain(*part)
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    step = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + PENALTY)
    return float(total[i, j] - _gain(cg[-1, -1], ch[-1, -1])), step


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting on feature rows x and labels y of 0 and 1."""
    if not len(y) or y.min() == y.max():
        return Gam(float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -3, 3)))
    model = Gam(float(np.log(y.mean() / (1 - y.mean()))))
    model.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    b = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(n) for n in sizes]
    odds = np.full(len(y), model.base)
    slope = lambda: (p := 1 / (1 + np.exp(-odds))) is not None and (y - p, p * (1 - p))
    for _ in range(ROUNDS):
        for i, n in enumerate(sizes):
            g, h = slope()
            step = RATE * _tree(np.bincount(b[:, i], g, n), np.bincount(b[:, i], h, n))
            model.tables[i] += step
            odds += step[b[:, i]]
    cell = lambda i, j, v: np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    g, h = slope()
    able = [(i, j) for i, j in combinations(range(len(sizes)), 2) if sizes[i] > 1 and sizes[j] > 1]
    chosen = sorted(able, key=lambda p: -_quadrants(cell(*p, g), cell(*p, h))[0])[:PAIRS]
    tables = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = slope()
            step = RATE * _quadrants(cell(i, j, g), cell(i, j, h))[1]
            tables[i, j] += step
            odds += step[b[:, i], b[:, j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and f0, f1, ... of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches):
        alone("gam")
        for batch in batches:
            rows = np.array([text_features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} double" for n in names))


def sample(labelled: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most limit rows, the same at each run: those of least hashed id."""
    return labelled.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def train(docs: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED, labels: DataFrame | None = None) -> Gam:
    """Fit on at most limit documents (id, text) with a label, from labels (id, label) or, without it, from docs itself.

    The sample is chosen by ids alone and broadcast (limit rows), so texts stay where they are read; only features come to the driver.
    An id that repeats counts once, with its least features.
    """
    chosen = sample(labelled_ids(docs, docs if labels is None else labels, label_col, id_col), id_col, limit)
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    names = [f"f{i}" for i in range(len(FEATURES))]
    rows = with_features(texts.withColumn(id_col, F.struct(id_col, label_col)).select(id_col, text_col), id_col, text_col)
    rows = rows.groupBy(id_col).agg(F.min(F.struct(*names)).alias("f"))
    rows = rows.select(f"{id_col}.*", "f.*").orderBy(id_col).toPandas()
    return fit(rows[names].to_numpy(float), rows[label_col].to_numpy(float))


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns and score, 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        alone("gam")
        rows = np.array([text_features(t or "") for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(held.value.score(rows))

    return docs.withColumn("score", of(F.coalesce(F.col(text_col), F.lit(""))))
