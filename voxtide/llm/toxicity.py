"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy.

A word is the bag of its character n-grams (with ends marked) and itself; each
is hashed to one of a fixed number of embedding rows.  The embeddings of the
words in a window are averaged and go into a softmax over two classes, and a
text is as toxic as its windows: their odds are pooled by a soft maximum, so
that a few words in a long text count.  Embeddings and softmax learn together
by gradient descent on the texts' labels.  Misspellings share most n-grams
with the word that they hide, and so its vectors.

The average is over windows and not over the whole text, as an average over
all words lets a few words of a long text vanish (README has the figures).

Fitting uses a sample of labelled rows, bounded in rows and in characters; of
equal hashed ids the least id comes first, an id that repeats counts once, with its least text and
largest label, null ids and labels are not used.  Rows: a null text counts as
empty and scores by the bias alone; texts are scored whole; rows that repeat
are scored each, equal texts alike; an empty table gives no rows, and no or
one kind of label gives every text the labels' share.  Columns of docs pass
through whatever their names; score is added, or replaces a column so named.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import Remembered, alone, discard, labelled_ids, stored

#: How much more a toxic text counts in fitting.
TOXIC_WEIGHT = 2.5
#: At most so many toxic rows are used to fit, and three times as many others.
MAX_LABELLED = 1_000
#: At most so many characters are used to fit, whole texts in order of hashed id; texts of over a sixteenth of it take no part in fitting.
MAX_CHARACTERS = 24_000_000
ROWS, WIDTH, WINDOW, EPOCHS, RATE, DECAY, SHARP = 1 << 16, 12, 2, 80, 0.5, 3e-3, 5.0
_WORDS = re.compile(r"[^\W_]+").findall


def grams(word: str) -> np.ndarray:
    """Embedding rows of a word: itself and its runs of 3 to 5 characters."""
    marked = f"<{word}>"
    parts = chain([marked], (marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)))
    return np.array(sorted({zlib.crc32(p.encode("utf-8", "surrogatepass")) % ROWS for p in parts}), np.int64)


@dataclass
class Model:
    vectors: np.ndarray  # ROWS x WIDTH
    softmax: np.ndarray  # WIDTH x 2
    bias: float
    sharp: float

    def scorer(self):
        """A function of a text to its score; words' odds are remembered."""
        by_row = self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])
        odds = Remembered(lambda word: float(by_row[grams(word)].mean()))

        def of(text: str) -> float:
            words = _WORDS(text.lower())
            z = self.bias
            if words:
                each = np.fromiter(map(odds.__getitem__, words), float, len(words))
                z += pool(windows(each), self.sharp)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return of


def windows(each: np.ndarray) -> np.ndarray:
    """Mean of every run of WINDOW words; of all if there are fewer."""
    if len(each) <= WINDOW:
        return np.array([each.sum() / WINDOW])
    sums = np.concatenate([[0.0], each.cumsum()])
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


def pool(values: np.ndarray, sharp: float) -> float:
    top = values.max()
    return float(top + np.log(np.exp(sharp * (values - top)).sum()) / sharp)


class Layout:
    """Training texts laid end to end as numbers of words, and each word's n-grams."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        runs = [np.array([number.setdefault(w, len(number)) for w in _WORDS(t.lower())] or [number.setdefault("", len(number))], np.int64) for t in texts]
        lists = [grams(w) for w in number]
        self.gram, self.size = np.concatenate(lists), np.array([len(x) for x in lists])
        self.first = np.concatenate([[0], self.size.cumsum()[:-1]])
        self.weight = np.repeat(1 / self.size, self.size)
        # each text is followed by WINDOW - 1 blanks so that no window spans two
        self.blank = len(number)
        self.flat = np.concatenate([np.concatenate([r, np.full(WINDOW - 1, self.blank)]) for r in runs])
        spans = np.array([len(r) + WINDOW - 1 for r in runs])
        self.starts = np.concatenate([[0], spans.cumsum()[:-1]])
        self.owner = np.repeat(np.arange(len(runs)), spans)


def slopes(model: Model, at: Layout, labels: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Weighted mean log-likelihood of the labels, and its slopes by the bias and by the odds of each embedding row."""
    row = model.vectors @ (model.softmax[:, 1] - model.softmax[:, 0])
    word = np.append(np.add.reduceat(row[at.gram] * at.weight, at.first), 0.0)
    each = word[at.flat]
    sums = np.concatenate([[0.0], each.cumsum(), np.full(WINDOW - 1, each.sum())])
    value = (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW
    top = np.maximum.reduceat(value, at.starts)
    soft = np.exp(model.sharp * (value - top[at.owner]))
    total = np.add.reduceat(soft, at.starts)
    z = model.bias + top + np.log(total) / model.sharp
    much = np.where(labels > 0, TOXIC_WEIGHT, 1.0)
    miss = (labels - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / len(labels) * much
    pull = (miss / total)[at.owner] * soft / WINDOW
    sums = np.concatenate([np.zeros(WINDOW), pull.cumsum()])
    on = sums[WINDOW:] - sums[:-WINDOW]  # of each place, from the windows that hold it
    by_word = np.bincount(at.flat, on, at.blank + 1)[: at.blank]
    by_row = np.bincount(at.gram, np.repeat(by_word / at.size, at.size), ROWS)
    likelihood = float((much * (labels * z - np.logaddexp(0, z))).sum() / len(labels))
    return likelihood, float(miss.sum()), by_row


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Gradient descent on the logistic loss of pooled window odds."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.05, (ROWS, WIDTH)), rng.normal(0, 0.3, (WIDTH, 2)), 0.0, SHARP)
    share = labels.mean() if len(labels) else 0.5
    model.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(labels) or labels.min() == labels.max():
        model.softmax[:] = 0
        return model
    at = Layout(texts)
    for epoch in range(EPOCHS):
        u = model.softmax[:, 1] - model.softmax[:, 0]
        _, by_bias, by_row = slopes(model, at, labels)
        model.bias += 4.0 * by_bias
        # steps of set length, as the gradient is tiny until the first words stand out
        pace = RATE * (1 - 0.9 * epoch / EPOCHS)
        along = (model.vectors * by_row[:, None]).sum(0)
        model.vectors *= 1 - DECAY
        model.vectors += pace * (by_row / np.abs(by_row).max())[:, None] * (u / np.linalg.norm(u))[None, :]
        along *= 0.1 * pace / np.linalg.norm(along)
        model.softmax += np.stack([-along, along], 1)
    return model


def train(docs: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED, labels: DataFrame | None = None) -> Model:
    """Fit on at most limit toxic and 3 * limit other documents (id, text), those of least hashed id, with a label from labels (id, label) or, without it, from docs itself.

    The sample is chosen by ids alone and broadcast, so texts stay where they are read; its own texts are stored, and the driver takes
    MAX_CHARACTERS of them at most.  An id that repeats counts once, with its least text.
    """
    spark, kind = docs.sparkSession, docs.select(id_col).schema
    order = [F.xxhash64(id_col), F.col(id_col)]
    ids = labelled_ids(docs, docs if labels is None else labels, label_col, id_col)
    chosen = ids.where(F.col(label_col) == 1).orderBy(*order).limit(limit).unionAll(ids.where(F.col(label_col) == 0).orderBy(*order).limit(3 * limit))
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).join(F.broadcast(chosen), id_col)
    kept = stored(texts.groupBy(id_col, label_col).agg(F.min(text_col).alias(text_col)), "labelled")
    sizes = kept.select(F.xxhash64(id_col), id_col, F.length(text_col)).collect()  # 4 * limit narrow rows
    used, room = [], MAX_CHARACTERS
    for _, own, size in sorted((tuple(r) for r in sizes if r[2] <= MAX_CHARACTERS // 16)):
        room -= size
        if room < 0:
            break
        used.append((own,))
    rows = kept.join(F.broadcast(spark.createDataFrame(used, kind)), id_col).select(id_col, label_col, text_col).orderBy(id_col).collect()
    discard(kept)
    return fit([r[2] for r in rows], np.array([float(r[1]) for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' columns and score, 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict = {}

    @F.pandas_udf("double")
    def of(texts):
        if "of" not in kept:
            alone("toxicity")
            kept["of"] = held.value.scorer()
        return texts.map(kept["of"]).astype(float)

    return docs.withColumn("score", of(F.coalesce(F.col(text_col), F.lit(""))))
