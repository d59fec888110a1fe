"""Operators on single texts against brute force, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtide.llm import bagminhash, bpe, chat, decontam, gam, linedup, merkle, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = "aword bword\n" * 20_000 + "x" * 50_000
EDGE = [
    (1, None, "en", "s1", 0, "a"), (2, "", "en", None, 0, "a"), (3, "one", None, "s1", 3, None), (3, "one", None, "s1", 3, None),
    (3, "two\nlines", "en", "s2", 9, "b"), (None, "no id", "en", "s2", 5, "b"), (9, LONG, "en", "s3", len(LONG), "c"),
    (10, "é\U0001f600 <|im_end|> token = \"abcdef123456\" \x00 end", "xx", "s1", 1, "d"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as file:
        return bpe.parse_ranks(file.read())


@pytest.fixture(scope="module")
def vocab(spark):
    return bpe.vocabulary(spark, public_tokenizers.path(queries.VOCABULARY))


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1


def test_transducer_equals_merging(ranks):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(st.binary(min_size=1, max_size=12) | st.text("aeinrstho ' ", min_size=1, max_size=20).map(str.encode))
    def check(piece):
        assert codec.transducer.encode(piece) == bpe.merge_bytes(ranks, piece)

    check()


def test_transducer_forgets_and_stays_right(ranks):
    small = bpe.Transducer(ranks, max_steps=50)
    for word in (b"internationalisation", b"Donaudampfschiff", b"anticonstitutionnellement") * 3:
        assert small.encode(word) == bpe.merge_bytes(ranks, word)


def test_codec_equals_library(ranks, known):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, max_pieces=100)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        packed = codec.encode_packed(text)
        assert np.frombuffer(packed, "<u4").tolist() == known.encode_ordinary(text)
        assert codec.decode_text(packed) == text

    check()


@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_utf8_stream_is_decode(data, cuts):
    stream, at, out = bpe.Utf8Stream(), 0, []
    for cut in sorted(cuts):
        out.append(stream.feed(data[at:cut]))
        at = max(at, cut)
    out += [stream.feed(data[at:]), stream.end()]
    assert "".join(out) == data.decode("utf-8", "replace")


def test_op1(spark, known):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(known.encode_ordinary(d.text or ""), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest() and r.round_trip


def test_encode_edge_rows(edge, vocab):
    coded = bpe.encode_documents(edge, vocab, public_tokenizers.PATTERN)
    back = bpe.decode_documents(coded, vocab, public_tokenizers.PATTERN)
    assert sorted(map(repr, rows(back))) == sorted(repr((r[0], r[1] or "")) for r in EDGE)
    assert bpe.encode_digests(edge.limit(0), vocab, public_tokenizers.PATTERN).count() == 0


# 3


def test_merkle_roots_and_edits():
    text = "first words here stand\n\nsecond paragraph has other words in it\nthird one"
    assert merkle.fingerprint(text) == merkle.fingerprint(text) != merkle.fingerprint(text + " ")
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1.0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1.0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint(text)) == 0.0
    changed = text.replace("other", "OTHER")
    (start, end), *more = merkle.edits(merkle.fingerprint(text), merkle.fingerprint(changed))
    assert not more and start <= text.index("other") < end and end - start < len(text)
    assert all("".join(merkle.leaves(p)) == p for p in LONG.split("\n")[-2:])


def likeness_by_hand(one, other):
    """Recursively: what both lists of branches have counts whole, the rest's children are compared."""
    size = lambda node: node[1] if isinstance(node[1], int) else sum(map(size, node[1]))

    def common(a, b):
        left, right, same = [], list(b), 0
        for node in a:
            k = next((k for k, x in enumerate(right) if x[0] == node[0]), None)
            if k is None:
                left.append(node)
            else:
                same += size(right.pop(k))
        if left and right and not isinstance(left[0][1], int):
            same += common([c for n in left for c in n[1]], [c for n in right for c in n[1]])
        return same

    if one == other:
        return 1.0
    a, b = merkle.tree(one), merkle.tree(other)
    total = sum(map(size, a)) + sum(map(size, b))
    return 2 * common(a, b) / total if total else 0.0


def test_op3(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op3_merkle(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (own, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        changed = merkle.edited_text(text, following)
        r = got[own]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == merkle.fingerprint(text) and r.edited_fingerprint == merkle.fingerprint(changed)
        assert r.near_edited == pytest.approx(likeness_by_hand(text, changed)) and r.near_next == pytest.approx(likeness_by_hand(text, following))
        kept = len(text) - len(text) // 2
        assert (r.n_edits == 0) == (text == changed) or text[:kept] == changed  # an edit that only cuts lacks leaves or none
        if r.first_edit is not None:
            assert r.first_edit <= next((k for k in range(len(text)) if text[k : k + 1] != changed[k : k + 1]), len(text))


def test_merkle_edge_rows(spark, edge):
    got = merkle.compare_with_next(edge).collect()
    assert len(got) == len(EDGE)
    assert merkle.compare_with_next(edge.limit(0)).count() == 0
    one = merkle.compare_with_next(edge.where("doc_id = 1")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(0, 1.0)]
    prints = merkle.fingerprint_documents(edge)
    assert {(r.doc_id, r.class_id) for r in merkle.equal_classes(prints).collect()} >= {(1, 1), (2, 1)}
    assert merkle.branches(edge.where("doc_id < 5")).where("level = 'paragraph'").count() == 6
    assert merkle.branches(edge).columns[0] == "doc_id" and merkle.branches(edge).where("doc_id is null").count() > 0


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_ids_of_every_kind(spark, vocab, kind):
    own = lambda k: None if k is None else str(k) if kind == "string" else k
    docs = spark.createDataFrame([(own(k), f"text {k} of it") for k in (5, None, 12, 3)], f"doc_id {kind}, text string")
    order = [None, own(3), own(5), own(12)] if kind != "string" else [None, "12", "3", "5"]
    texts = {own(k): f"text {k} of it" for k in (5, None, 12, 3)}
    got = {r.doc_id: r for r in merkle.compare_with_next(docs).collect()}
    assert set(got) == set(order)
    for i, k in enumerate(order):
        assert got[k].edited_sha256 == hashlib.sha256(merkle.edited_text(texts[k], texts[order[(i + 1) % 4]]).encode()).hexdigest()
    turns = docs.selectExpr("doc_id as conv_id", "1 as turn", "'user' as role", "text")
    assert {r.conv_id: r.n_turns for r in chat.read_back(turns, vocab, public_tokenizers.PATTERN).collect()} == dict.fromkeys(order, 1)
    assert {r.doc_id for r in linedup.remove_boilerplate(docs.withColumn("source", docs.text)).collect()} == set(order)


# 4 and 8


def test_toxicity_learns_and_generalises():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abehilnorst"), 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        row = list(rng.choice(words, 30))
        labels.append(float(i % 4 == 0))
        if i % 4 == 0:
            row[int(rng.integers(30))] = ["grumpfish", "zorkface"][i % 8 // 4]
        texts.append(" ".join(row))
    of = toxicity.fit(texts[:300], np.array(labels[:300])).scorer()
    found = np.array([of(t) for t in texts[300:]]) >= 0.5
    assert (found == (np.array(labels[300:]) == 1)).mean() > 0.95
    plain = " ".join(rng.choice(words, 29))
    assert of(plain + " grumpfish") > 0.5 > of(plain + " abeh")
    assert of(plain + " grumpfissh") > 3 * of(plain + " abehlorst")  # shares n-grams, never seen
    assert 0 <= of("") <= 1 and 0 <= of(LONG) <= 1


def test_op4_and_op8(spark):
    for query, folds, held, label, limit in ((queries.op4_toxicity, 5, 0, "toxic", 0.5), (queries.op8_quality, 4, 2, "quality", 0.7)):
        got = query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left").collect()
        assert len(got) == 1000
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
        right = [r.predicted == r[label] for r in got if r.held_out and r[label] is not None]
        assert np.mean(right) > 0.85


def test_op4_catches_toxic_texts(spark):
    large = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    toxic, clean = [r.predicted for r in got if r.toxic], [r.predicted for r in got if not r.toxic]
    assert sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.01 * len(clean)


def test_models_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert {r.score for r in gam.score(edge, gam.train(none, "quality")).collect()} == {0.5}
    assert len(toxicity.score(edge, toxicity.train(none, "quality")).collect()) == len(EDGE)
    assert all(np.isfinite(gam.text_features(t or "")).all() for _, t, *_ in EDGE)


def test_slopes_equal_differences_and_scores_equal_loops():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab c"), 40)) for _ in range(12)] + ["", "one"]
    labels = np.array([1.0, 0.0] * 7)
    model = toxicity.fit(texts, labels)
    u, at = model.softmax[:, 1] - model.softmax[:, 0], toxicity.Layout(texts)
    _, by_bias, by_row = toxicity.slopes(model, at, labels)

    def likelihood(bias=0.0, row=0, by=0.0):
        vectors = model.vectors.copy()
        vectors[row] += by * u / (u @ u)  # moves this row's odds by ``by``
        return toxicity.slopes(toxicity.Model(vectors, model.softmax, model.bias + bias, model.sharp), at, labels)[0]

    h = 1e-5
    assert (likelihood(bias=h) - likelihood(bias=-h)) / (2 * h) == pytest.approx(by_bias, abs=1e-7)
    for row in np.argsort(-np.abs(by_row))[:40]:
        assert (likelihood(row=row, by=h) - likelihood(row=row, by=-h)) / (2 * h) == pytest.approx(by_row[row], abs=1e-7)

    def by_hand(text):
        words = re.findall(r"[^\W_]+", text.lower())
        odds = []
        for word in words:
            marked = f"<{word}>"
            parts = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
            rows = {zlib.crc32(p.encode()) % toxicity.ROWS for p in parts}
            odds.append(sum(float(model.vectors[r] @ u) for r in rows) / len(rows))
        pairs = [(a + b) / 2 for a, b in zip(odds, odds[1:])] or [x / 2 for x in odds]
        z = model.bias + (np.log(sum(np.exp(model.sharp * v) for v in pairs)) / model.sharp if pairs else 0.0)
        return 1 / (1 + np.exp(-z))

    of = model.scorer()
    assert [of(t) for t in [*texts, "abc cab unseen"]] == pytest.approx([by_hand(t) for t in [*texts, "abc cab unseen"]], abs=1e-9)


def test_toxicity_sample_is_bounded_in_characters(spark, monkeypatch):
    rows = [(i, "bad word" if i % 2 else "good word", i % 2) for i in range(40)] + [(100, "x" * 1_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels)))
    toxicity.train(docs, "toxic")
    monkeypatch.setattr(toxicity, "MAX_CHARACTERS", 160)
    toxicity.train(docs, "toxic")
    assert len(seen[0][0]) == 41 and seen[0][1].sum() == 21
    assert 16 <= len(seen[1][0]) <= 20 and set(seen[1][0]) <= {"bad word", "good word"} and sum(map(len, seen[1][0])) <= 160


def boosted_by_hand(x, y):
    """The cyclic boosting of the tables, row by row: every step is the best tree of at most three leaves by trying all cuts."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, gam.BINS + 1)[1:-1])) for c in x.T]
    bins = [[sum(v >= c for c in cut) for v in col] for cut, col in zip(cuts, x.T)]
    tables = [[0.0] * (len(c) + 1) for c in cuts]
    odds = [float(np.log(y.mean() / (1 - y.mean())))] * len(y)

    def leaf(rows):
        g = sum(y[r] - 1 / (1 + np.exp(-odds[r])) for r in rows)
        h = sum((p := 1 / (1 + np.exp(-odds[r]))) * (1 - p) for r in rows)
        return g * g / (h + gam.PENALTY), g / (h + gam.PENALTY)

    for _ in range(gam.ROUNDS):
        for i, table in enumerate(tables):
            inside = lambda a, b: [r for r in range(len(y)) if a <= bins[i][r] < b]
            edges = [0, len(table)]
            for _ in range(2):
                tried = [
                    (leaf(inside(a, k))[0] + leaf(inside(k, b))[0] - leaf(inside(a, b))[0], -k)
                    for a, b in zip(edges, edges[1:]) for k in range(a + 1, b)
                ]
                if not tried or max(tried)[0] <= 0:
                    break
                edges = sorted([*edges, -max(tried)[1]])
            steps = [(a, b, gam.RATE * leaf(inside(a, b))[1]) for a, b in zip(edges, edges[1:])]
            for a, b, step in steps:
                for k in range(a, b):
                    table[k] += step
                for r in inside(a, b):
                    odds[r] += step
    return tables


def test_boosting_equals_trying_all_cuts(monkeypatch):
    monkeypatch.setattr(gam, "BINS", 5)
    monkeypatch.setattr(gam, "ROUNDS", 4)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(0, 0.3, 60) > 0).astype(float)
    model = gam.fit(x, y)
    for own, other in zip(model.tables, boosted_by_hand(x, y), strict=True):
        assert own == pytest.approx(other, abs=1e-9)
    # a score is the sum of looked-up values
    bins = model.bins(x)
    for r in range(5):
        z = model.base + sum(t[bins[r, i]] for i, t in enumerate(model.tables)) + sum(t[bins[r, i], bins[r, j]] for i, j, t in model.pairs)
        assert model.score(x)[r] == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_reads_long_words_whole():
    long = "x" * 40
    assert {zlib.crc32(part) % toxicity.ROWS for part in (b"xgrum", b"grumb", b"mble>", b"le>")} <= set(toxicity.grams(long + "grumble"))
    model = toxicity.fit(["grumble here", "nothing here", "grumble there", "nothing there"] * 5, np.array([1.0, 0.0] * 10))
    of = model.scorer()
    assert of(f"{long}grumble") > of(f"{long}nothing")
    assert np.isfinite(of("x" * 1_000_000))


# 6


def spans_by_hand(text):
    rules = [
        ("assign", r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, rule, good) in enumerate(rules) for m in re.finditer(rule, text) if good(m)]
    return [f"{name}:{start}:{end}" for start, _, name, end in sorted(found)]


def test_op6(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_secrets(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = spans_by_hand(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == base and len(spans) - len(base) == r.n_random


def test_secrets_added_and_edge_rows(spark, edge):
    hexes = ["".join("0123456789abcdef"[(i * 7 + j * j) % 16] for j in range(40)) for i in range(20)]
    train = [(i, f"Token: \"{h}\" and a plain_identifier with otherwords inside") for i, h in enumerate(hexes)]
    train += [(100 + i, "some ordinary identifier names like maximum_partition or configuration settings") for i in range(20)]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    tests = [(1, "key Zx9Qk2Lw7Rt4Vb8Nm3Hc6Yd1 é"), (2, "the internationalisation_of_configuration"), (3, "token: pass token\" = abcdef1"), (4, None), (5, "secret=abc"), (6, "\U0001f600 api_key: 'AKIA" + "B" * 16 + "'")]
    found = secrets.digests(secrets.scan(spark.createDataFrame(tests, "doc_id long, text string"), secrets.train(docs)))
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].spans == "random:4:28" and got[2].spans == "" == got[4].spans
    for own, text in tests:
        base = spans_by_hand(text or "")
        assert got[own].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert len(secrets.digests(secrets.scan(edge, [0.0] * 16384)).collect()) == len(EDGE)
    assert set(secrets.train(edge.limit(0))) == {0.0}


def test_random_spans_by_hand(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(9000 + i, f"see {t} there") for i, t in enumerate(["Zx9Qk2Lw7Rt4Vb8Nm3Hc6Yd1", "4668350087416800", "plain-words-joined-by-marks", "q8Zt0vKx7LmW2pRb", "UPPER_CASE_CONSTANT_NAME"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ratio = secrets.train(frame)
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.scan(frame, ratio)).collect()}
    for own, text in docs:
        base = [tuple(map(int, x.split(":")[1:])) for x in spans_by_hand(text)]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
            score = sum(ratio[ord(a) * 128 + ord(b)] for a, b in zip(m[0], m[0][1:]))
            if score >= max(secrets.RATIO, secrets.RATIO_PER_CHAR * len(m[0])) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b in base):
                want.append(f"random:{m.start()}:{m.end()}")
        assert [x for x in got[own].split(",") if x.startswith("random")] == want
    assert got[9000] == "random:4:28" and got[9003] == "random:4:20" and got[9001] == got[9002] == got[9004] == ""


def test_names_that_clash(spark, edge):
    docs = edge.selectExpr("*", "'a' as tokens", "'b' as base_spans", "'c' as row", "'d' as node", "1.5D as score", "'e' as band")
    out = secrets.scan(docs, [0.0] * 16384)
    assert out.columns == [*docs.columns, "base", "added"] and {(r.tokens, r.base_spans) for r in out.collect()} == {("a", "b")}
    items = spark.createDataFrame([(1, "aword bword aword bword aword bword")], "item_id long, text string")
    assert decontam.clean(docs, items).columns == docs.columns and {r["row"] for r in decontam.clean(docs, items).collect()} == {"c"}
    assert sorted(r.doc_id or 0 for r in bagminhash.near_classes(docs).collect()) == sorted(r[0] or 0 for r in EDGE)
    model = gam.train(spark.createDataFrame([], "doc_id long, quality int, text string"), "quality")
    assert set(gam.score(docs, model).columns) == set(docs.columns) and {r.score for r in gam.score(docs, model).collect()} == {0.5}


def test_secrets_sample_is_fixed_and_counts_documents(spark):
    # one id with many texts at the cut, and copies of whole rows: the order and number of rows do not change the sample
    data = [(7, f"token = {hashlib.sha256(str(i).encode()).hexdigest()}") for i in range(40)] + [(8, f"ordinary {w}_identifier") for w in ("first", "second", "third", "fourth", "fifth", "sixth")]
    whole = lambda rows, **more: secrets.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more)
    part = whole(data, limit=3)
    assert part == whole(data[::-1], limit=3) == whole(data + data[:9] * 4 + data[-2:], limit=3)
    assert part != whole(data) and whole(data) == whole(data + data[:9] * 4 + data[-2:])
    chosen = secrets.sample(spark.createDataFrame(data + data[:9], "doc_id long, text string"), limit=5)
    assert chosen.columns == ["key", "some", "copies"] and sorted(r.some for r in chosen.collect()) == [False] * 5 + [True] * 5


# 7


def test_line_dedup(spark, edge):
    data = [(i, f"own line {i}\nfooter of all\nlast {i}", f"s{i % 12}") for i in range(24)]
    data += [(100 + i, "copied head\ncopied body\ncopied tail", f"s{i}") for i in range(12)]
    data += [(200, None, "s1"), (201, "", "s1"), (202, "footer of all\nfooter of all\n\n", None)]
    got = {r.doc_id: r for r in linedup.remove_boilerplate(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[0].text == "own line 0\nfooter of all\nlast 0" and got[5].text == "own line 5\nlast 5" and got[5].n_removed == 1
    assert got[100].text == "copied head\ncopied body\ncopied tail" and got[103].text == "" and got[103].n_removed == 3  # a copied page stays once
    assert got[200].text is None and got[200].n_lines == 0 and got[201].text == "" and got[202].text == "\n"
    out = linedup.remove_boilerplate(edge)
    assert out.columns == [*edge.columns, "n_lines", "n_removed"]
    assert sorted(map(repr, rows(out.select("doc_id", "text")))) == sorted(repr(r[:2]) for r in EDGE)
    assert linedup.remove_boilerplate(edge.limit(0)).count() == 0


def test_line_dedup_of_blocks_beside_copies(spark):
    # a footer of three lines on 40 pages of 40 sites, also on 300 copies of one page; clashing names; a null id
    data = [(i, f"head {i}\nfirst\nmiddle\nlast\ntail {i}", f"s{i}") for i in range(1, 41)] + [(None, "head of none\nfirst\nmiddle\nlast", "s3")]
    data += [(100 + i, "\n".join([f"copied {k}" for k in range(12)] + ["first", "middle", "last"]), f"s{i % 40}") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "doc_id as row_key", "'x' as gone", "'y' as site", "'z' as h1")
    out = linedup.remove_boilerplate(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].text == f"head {i}\ntail {i}" and got[i].n_removed == 3 and got[i].row_key == i for i in range(1, 41))
    assert got[None].text == "head of none\nfirst\nmiddle\nlast"  # a null id is the least: the first occurrence
    assert got[100].text == "\n".join(f"copied {k}" for k in range(12)) and got[150].text == "" and got[150].gone == "x"


@pytest.mark.parametrize("own", [0, 1, 3])
def test_footers_go_whatever_their_pages_hold(spark, own):
    """Footers of 1 to 8 lines on 30 pages of 30 sites, with as many lines of their own as are given, go from all pages but the first."""
    data = [(100 * f + i, "\n".join([f"own {f} {i} {k}" for k in range(own)] + [f"footer {f} {k}" for k in range(f)]), f"s{i}") for f in range(1, 9) for i in range(30)]
    out = linedup.remove_boilerplate(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert sum(r.n_removed for r in out) == 29 * sum(range(1, 9))
    assert all(r.n_removed == (r.doc_id // 100 if r.doc_id % 100 else 0) and r.n_lines - r.n_removed == own or not r.doc_id % 100 for r in out)


# 10


@given(st.text(st.sampled_from("<|\\im_end>a\n%"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_op10(spark, vocab):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    turns += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op10_chat(spark, SF).collect()}
    by = {}
    for conv, turn, role, text in sorted(turns, key=lambda r: (r[0], r[1])):
        by.setdefault(conv, []).append((role, text or ""))
    assert set(got) == set(by)
    for conv, parts in by.items():
        r, lost = got[conv], "".join(t for role, t in parts if role == "assistant")
        assert r.n_turns == len(parts) and r.loss_chars == len(lost) and r.loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in parts).encode()).hexdigest()
    odd = spark.createDataFrame([(None, None, None, None), (7, 1, "assistant", None), (7, 1, "a\nb", LONG), (7, 0, "assistant", "<\\|")], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in chat.read_back(odd, vocab, public_tokenizers.PATTERN).collect()) == [(0, 1, 0), (7, 3, 3)]
    assert chat.read_back(odd.limit(0), vocab, public_tokenizers.PATTERN).count() == 0
    masks = {(r.turn, r.role): (len(r.ids) // 4, sum(r["mask"])) for r in chat.format_turns(odd.where("conv_id = 7"), vocab, public_tokenizers.PATTERN).collect()}
    assert masks[0, "assistant"][1] > 0 == masks[1, "assistant"][1]
