"""Secret scans: fixed patterns, and character Markov models for what they miss.

The base finds assignments, access keys and long hexadecimal runs.  The method
adds tokens that look random: two first-order Markov models over characters,
one of random strings and one of ordinary identifiers, give each long token a
log-likelihood ratio, and a token above the threshold is a span of kind
``random`` if it holds a letter and touches no base span.  The models are trained on labelled
samples taken from the documents: what the base matched is random, letter
words are identifiers; the sample's size is bounded and only 128 x 128 counts
come to the driver.  As base matches are mostly hexadecimal, uniform random
strings over every usual alphabet are samples too, by their expected counts.
A pair that no identifier has backs off to its second character's share.

All of it is DataFrame functions.  Spans count code points.  Rows: a null text
counts as empty and has no spans; texts are scanned whole; rows repeat as they
are, and one id with two texts is two documents; a null id is an id; an empty
table gives no rows and trains to ratios of 0.  ``scan`` passes columns through
whatever their names and adds base and added, replacing columns so named.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import stored, unused

#: The base patterns, in the order in which kinds are listed.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"access": 20, "hex": 24}
LEAST_VALUE = 6
#: Tokens that the models judge.
TOKEN, LEAST_TOKEN = r"[A-Za-z0-9+/_=-]+", 16
#: At most so many documents give labelled samples; log-likelihood ratio from which a token is a secret, and that a character must give on average.
SAMPLE_DOCS, RATIO, RATIO_PER_CHAR = 20_000, 12.0, 0.5
#: Alphabets of random strings; characters of tokens; weight of an ordinary character's share beside its pairs; pairs of an alphabet at least; share of other forms of ordinary words.
_LOWER, _UPPER, _DIGITS, _MARKS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-"
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _DIGITS + _LOWER, _DIGITS + _UPPER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + "+/", _DIGITS + _LOWER + _UPPER + "-_")
CHARACTERS, SHARE, LEAST_PAIRS, ORDINARY_FORMS = len(_DIGITS + _LOWER + _UPPER + "+/_=-."), 20.0, 1000.0, 0.05
#: Of a run of one class, only runs of the least length can match: the same matches, found without the short ones.
_FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "random": r"[A-Za-z0-9+/_=-]{16,}"}

SPAN = "struct<start:int,end:int,kind:string,text:string>"


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as an array of (start, end, kind, text): lengths of what lies between and of the matches, summed up."""
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b"))
    none = F.array().cast(f"array<{SPAN}>")
    start = lambda acc, x: acc["at"] + F.length(x["b"])
    end = lambda acc, x: start(acc, x) + F.length(x["m"])
    add = lambda acc, x: F.struct(
        end(acc, x).alias("at"),
        F.concat(acc["out"], F.array(F.struct(start(acc, x).alias("start"), end(acc, x).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text")))).alias("out"),
    )
    summed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), summed).otherwise(none)


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, by start and then kind as listed."""
    assign = F.filter(_spans(text, "assign", PATTERNS["assign"]), lambda s: F.length(F.regexp_extract(s["text"], PATTERNS["assign"], 2)) >= LEAST_VALUE)
    return F.concat(assign, _spans(text, "access", _FAST["access"]), _spans(text, "hex", _FAST["hex"]))


def _ordered(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, [*PATTERNS, "random"])), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(_ordered(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _codes(token: Column) -> Column:
    """Number of each pair of neighbouring characters, from 0 to 128 * 128 - 1."""
    chars = F.transform(F.split(token, ""), lambda c: F.ascii(c) % 128)
    size = F.size(chars)
    return F.zip_with(F.slice(chars, F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice(chars, F.lit(2), size), lambda a, b: a * 128 + b)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_DOCS) -> DataFrame:
    """key (hash of id and text), some (has base spans) and copies (rows that repeat it whole) of the limit least keys of either kind.

    Only keys move: counts of their first 16 bits tell where the limit falls, so that few more than the limit are put in order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = text.rlike(PATTERNS["assign"]) | text.rlike(_FAST["access"]) | text.rlike(_FAST["hex"])
    rows = docs.select(_key(id_col, text_col), some.alias("some"))
    keys = stored(rows.groupBy("key", "some").agg(F.count("*").alias("copies")), "secret-keys")
    at: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for row in keys.groupBy("some", F.shiftright("key", 48).alias("part")).count().collect():
        at[row["some"]][row["part"]] = row["count"]
    chosen = []
    for kind, parts in at.items():
        last, seen = -(1 << 15), 0
        for part in sorted(parts):
            if seen >= limit:
                break
            last, seen = part, seen + parts[part]
        chosen.append(keys.where((F.col("some") == kind) & (F.shiftright("key", 48) <= last)).orderBy("key").limit(limit))
    return chosen[0].unionAll(chosen[1])


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio of every pair of characters, from at most limit documents with base spans and as many without.

    The sample's keys are broadcast and pairs are counted where the texts are read.  A document is an id with a text; rows that repeat it whole count once.
    Without ordinary samples every ratio is 0 and the method adds nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_key(id_col, text_col), text.alias("text")).join(F.broadcast(sample(docs, id_col, text_col, limit)), "key")
    value = lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["text"], PATTERNS["assign"], 2)).otherwise(s["text"])
    random = F.transform(base_spans(F.col("text")), value)
    ordinary = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z_]{5,})(?![A-Za-z0-9])"), F.lit(1))
    labelled = rows.select("copies", F.col("some").cast("int").alias("random"), F.explode(F.when(F.col("some"), random).otherwise(ordinary)).alias("token"))
    pairs = labelled.select("random", "copies", F.explode(_codes(F.col("token"))).alias("code")).groupBy("random", "code", "copies").count()
    # every copy of a document gives the same pairs, so the division leaves no rest
    counted = pairs.groupBy("random", "code").agg(F.sum(F.expr("count div copies")).alias("count")).collect()
    counts = [[0.0] * (128 * 128) for _ in range(2)]
    for row in counted:
        counts[row["random"]][row["code"]] = float(row["count"])
    return ratios(*counts)


def ratios(ordinary: list[float], random: list[float]) -> list[float]:
    """Log-likelihood ratio of every pair, from the pairs' counts in both samples; 0 without ordinary ones.

    A share of the ordinary words also counts as written in capitals and as joined by marks.
    Each alphabet weighs as much as the whole sample of random strings, LEAST_PAIRS pairs at least.
    """
    whole = max(LEAST_PAIRS, sum(random))
    if not sum(ordinary):
        return [0.0] * (128 * 128)
    words = [n * (1 - ORDINARY_FORMS) for n in ordinary]
    for a in _LOWER:
        for b in _LOWER:
            n = ordinary[ord(a) * 128 + ord(b)] * ORDINARY_FORMS
            words[ord(a.upper()) * 128 + ord(b.upper())] += n
            for mark in _MARKS:
                for one, other in ((a, b), (a.upper(), b.upper())):
                    words[ord(one) * 128 + ord(mark)] += n / len(_MARKS)
                    words[ord(mark) * 128 + ord(other)] += n / len(_MARKS)
    mixed = list(random)
    for alphabet in ALPHABETS:
        for a in alphabet:
            for b in alphabet:
                mixed[ord(a) * 128 + ord(b)] += whole / len(alphabet) ** 2
    second = [sum(words[b :: 128]) + 0.5 for b in range(128)]
    of = sum(second) - 0.5 * (128 - CHARACTERS)
    out = []
    for a in range(128):
        one, other = words[a * 128 : a * 128 + 128], mixed[a * 128 : a * 128 + 128]
        left, right = sum(one) + SHARE, sum(other) + 0.01 * CHARACTERS
        out += [math.log((m + 0.01) / right) - math.log((n + SHARE * second[b] / of) / left) for b, (n, m) in enumerate(zip(one, other, strict=True))]
    return out


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """docs' columns and base, added (arrays of spans); the ratios enter the plan as one constant array."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    base, tokens = unused(docs.columns, "base_spans", "tokens")
    found = docs.withColumn(base, base_spans(text)).withColumn(tokens, _spans(text, "random", _FAST["random"]))
    free = lambda t: t["text"].rlike("[A-Za-z]") & ~F.exists(F.col(base), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    ratio = lambda t: F.aggregate(_codes(t["text"]), F.lit(0.0), lambda acc, c: acc + F.get(table, c))
    random = lambda t: free(t) & (ratio(t) >= F.greatest(F.lit(RATIO), F.lit(RATIO_PER_CHAR) * F.length(t["text"])))
    kept = [c for c in docs.columns if c not in ("base", "added")]
    return found.select(*kept, F.col(base).alias("base"), F.filter(tokens, random).alias("added"))


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, counts of each base kind, base_sha256, spans, n_random."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        id_col, *map(number, PATTERNS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_random"),
    )
