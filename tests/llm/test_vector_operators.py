"""Clustering, exact dedup and hard negatives against brute force, and their edge cases."""

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.llm import exactdedup, negatives, queries, vafile

SMALL = "/root/testdata/sf0.01"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# clustering


def brute_clusters(rows, dims=64, scale=64, k=16, rounds=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if sound(v) and len(v) == dims]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centroids = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else old for n, old in enumerate(centroids)]
    found = [(i, *reversed(nearest(x))) for i, x in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def test_op11(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert sorted(map(tuple, queries.op11_va_centroids(spark, SMALL).collect()), key=str) == brute_clusters(map(tuple, rows))


def test_clusters_of_ties_and_edge_rows(spark):
    """Few distinct values, many ties, vectors twice, an axis of one value; nulls, short ones, infinities."""
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.integers(-2, 3, 3)] + [0.5]) for i in range(300)]
    odd = [(None, good[0][1]), (7, good[7][1]), (900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.5]), (903, [math.inf, 0.0, 0.0, 0.5]), (904, [math.nan] * 4), (905, [])]
    rows = [*good, *odd]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, inertia string")
    for k, bits in ((5, 1), (16, 2), (400, 6)):
        assert sorted(map(tuple, vafile.cluster(df, dims=4, scale=4, k=k, bits=bits).collect()), key=str) == brute_clusters(rows, 4, 4, k)
    assert vafile.cluster(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="beyond"):
        vafile.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dims=1)


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(0)
    x = rng.integers(-40, 40, (500, 7))
    ends = np.sort(rng.choice(np.arange(-39, 39), 7, False))
    high = np.tile(np.r_[ends, 39], (7, 1))
    cuts = vafile.Cuts(np.concatenate([np.full((7, 1), -40), high[:, :-1] + 1], 1), high, 3)
    cells = vafile.unpacked(vafile.packed(cuts.cells(x), 3), 7, 3)
    assert (cells == cuts.cells(x)).all()
    lookup = vafile.Lookup(rng.integers(-40, 40, (9, 7)), cuts)
    least, most = lookup.intervals(cells)
    exact = ((x[:, None] - lookup.centroids) ** 2).sum(2)
    amid = np.rint(lookup.centroids.mean(0)).astype(int)
    differences = exact - ((x - amid) ** 2).sum(1)[:, None]
    assert (least <= differences).all() and (differences <= most).all()
    found, fetched = lookup.nearest(cells, x.__getitem__)
    assert (found == exact.argmin(1)).all() and 0 < fetched < len(x)


# exact dedup


def brute_copies(rows):
    """(doc_id, keep_id, group_size, digest) of every row, and how many rows of a text stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    order = lambda i: (i is not None, i)
    return sorted(((i, max(groups[t or ""], key=order), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def held(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_copies(rows)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_op12(spark):
    held(queries.op12_exact_dedup(spark, SMALL), [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize("bitmaps", [1, exactdedup.MAX_BITMAPS])
def test_copies_of_hot_groups_and_edge_rows(spark, bitmaps):
    """A third of the rows is one text; nulls equal empty texts, repeated rows and ids keep one; a full filter changes nothing."""
    long = "word " * 50_000
    rows = [(i, "hot") for i in range(400)] + [(i, f"text {i // 2 if i % 3 == 0 else i}") for i in range(400, 1200)]
    rows += [(1, None), (2, ""), (None, None), (5, "twice"), (5, "twice"), (None, "no id"), (None, "no id"), (6, long), (7, long), (8, long + "."), (9, "é"), (9, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    clash = df.withColumns({c: F.lit("x") for c in ("kept", "row", "hashed", "group_key", "bitmap_bits", "suspect")})
    marked = exactdedup.mark_documents(clash, max_bitmaps=bitmaps)
    held(marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), rows)
    assert {"row", "hashed", "suspect", "text"} <= set(marked.columns) and marked.where("row = 'x'").count() == len(rows)
    once = exactdedup.drop_copies(clash)
    assert once.columns == clash.columns and once.count() == len({t or "" for _, t in rows})
    assert exactdedup.mark_documents(df.limit(0)).collect() == []


def test_single_rows_pass_the_filter_straight(spark):
    """Nothing repeated is let go, and of 20,000 single hashes hardly one is held back."""
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h")).unionAll(spark.range(300).select(F.xxhash64("id").alias("h")))
    tested = exactdedup.with_suspicion(rows, "h", "suspect").groupBy("h").agg(F.count("*").alias("n"), F.min("suspect").alias("suspect"))
    counts = {(r.n, r.suspect): r.c for r in tested.groupBy("n", "suspect").agg(F.count("*").alias("c")).collect()}
    assert counts[2, True] == 300 and (2, False) not in counts and counts.get((1, True), 0) < 200


def test_no_python_and_no_shuffle_of_texts(spark):
    marked = exactdedup.mark_documents(spark.read.parquet(f"{SMALL}/documents.parquet"))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))


# hard negatives


def brute_negatives(rows, positives=5, wanted=10):
    """rows: (id, vector, label); an id is an anchor if divisible by 100."""
    kept = [(n, i, [math.floor(256 * x) for x in v], label) for n, (i, v, label) in enumerate(rows) if label is not None and sound(v)]
    out = []
    for n, i, q, label in kept:
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, x, strict=False)), j is None, j or 0, m, other, j) for m, j, x, other in kept if m != n))
        same = [(s[-1], -s[0]) for s in scored if s[4] == label][:positives]
        for p, ps in same:
            found = [(s[-1], -s[0]) for s in scored if s[4] != label and 30 * ps <= -100 * s[0] <= 90 * ps][:wanted]
            out += [(i, p, rank + 1, j, ps, ns) for rank, (j, ns) in enumerate(found)]
    return sorted(out, key=str)


def mined(df, **more):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect()), key=str)


def test_op13(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, SMALL).collect()), key=str) == brute_negatives(rows)


@pytest.mark.parametrize("wanted", [{"positives": 200, "negatives": 40}, {"positives": 1, "negatives": 1}])
def test_negatives_of_copies_and_edge_rows(spark, monkeypatch, wanted):
    """A hot label, copies of an anchor under other labels, rare labels, equal scores, zeros; several chunks and lowered thresholds."""
    monkeypatch.setattr(negatives, "CHUNK", (64, 100))
    monkeypatch.setattr(negatives, "ROWS", 32)
    monkeypatch.setattr(negatives, "WANTED", wanted)
    rng = np.random.default_rng(5)
    unit = lambda v: [float(x) for x in v / np.linalg.norm(v)]
    rows = [(i, unit(rng.normal(size=20)), int(k) if k < 5 else 0) for i, k in enumerate(rng.integers(0, 10, 500))]
    rows += [(1000 + i, rows[100][1], int(i % 4)) for i in range(120)] + [(2000 + i, unit(np.round(rng.normal(size=20))), i % 3) for i in range(200)]
    rows += [(3000, rows[5][1], 77), (3001, rows[6][1], None), (3002, None, 1), (3003, [0.1, None], 1), (3004, [math.inf] * 20, 1), (3100, [0.0] * 20, 1), (3200, [], 1), (3300, [0.5, -0.25], 2), (None, rows[7][1], 2), (200, rows[200][1], rows[200][2])]
    df = spark.createDataFrame([(i, v, label, 5) for i, v, label in rows], "vec_id long, embedding array<double>, label int, row int")
    assert mined(df) == brute_negatives(rows)


def test_negatives_of_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert mined(df) == mined(df.limit(0)) == []
    with pytest.raises(ValueError, match="pass"):
        mined(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int"))


def test_pairs_below_the_threshold_go_early():
    """The index finds what scoring all pairs finds, for thresholds of every kind, and omits what cannot reach them."""
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(300, 30)) * np.linspace(60, 1, 30))
    q = x[rng.choice(300, 40, False)] * 1.0
    scores = x @ q.T
    index = negatives.Index(x)
    for share, sign in itertools.product((50, 90, 99.9), (1, -1)):
        least = np.percentile(sign * scores, share, axis=0) * sign
        row, anchor, score = index.reaching(q, least)
        want = {(r, a, scores[r, a]) for r, a in zip(*np.nonzero(scores >= least), strict=True)}
        assert set(zip(row, anchor, score, strict=True)) == want
    assert len(index.reaching(q, np.full(40, -np.inf))[0]) == 300 * 40
