"""Document fingerprints: a Merkle tree over sections, paragraphs and word runs.

A text is cut into paragraphs at line ends, paragraphs into *leaves* (runs of
words that end where a word's own hash says so, hence at the same places in
any text that holds them), and paragraphs are gathered into sections that end at blank
lines or where a paragraph's hash says so.  Every node's hash covers its
children's, so equal roots mean equal texts.  A fingerprint is the root
followed by the tree: each section's hash and number of paragraphs, each
paragraph's hash and number of leaves, each leaf's hash and length.

Two trees are compared from the top: branches that both have are alike as a
whole and are not entered, the others' children are compared next.  What is
left are the leaves that one tree lacks; they locate the edits, and the share
of characters outside them is the likeness.

Rows: a null text counts as empty; two empty texts are alike (1.0), an empty
and another text are not (0.0).  Long texts give long trees, never prefixes.
Rows that repeat an id are ordered by text, a null id comes first; ids that
are no integers are ordered as strings.  Other columns are left out whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from voxtide.llm.common import Remembered, alone, arrow_schema, record_batch, shuffle_partitions

#: One word in so many ends a leaf; one paragraph in so many ends a section.
WORDS_PER_LEAF, PARAGRAPHS_PER_SECTION = 6, 4
#: A leaf ends at so many characters at the latest, for texts without spaces.
LONGEST_LEAF = 240
#: Documents that one task fingerprints at least.
ROWS_PER_TASK = 4000

_WORDS = re.compile(r"\S{1,64}\s*|\s+").findall
_ENDS = Remembered(lambda word: zlib.crc32(word.strip().encode("utf-8", "surrogatepass")) % WORDS_PER_LEAF == 0)


def _hash(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def leaves(paragraph: str) -> list[str]:
    """The word runs of one paragraph; joined they give it back."""
    words = _WORDS(paragraph)
    out, start, size = [], 0, 0
    for i, end in enumerate(map(_ENDS.__getitem__, words)):
        size += len(words[i])
        if end or size >= LONGEST_LEAF - 64:
            out.append("".join(words[start : i + 1]))
            start, size = i + 1, 0
    if start < len(words):
        out.append("".join(words[start:]))
    return out


def tree(text: str) -> list[tuple[bytes, list[tuple[bytes, list[tuple[bytes, int]]]]]]:
    """Sections of (hash, paragraphs of (hash, leaves of (hash, characters)))."""
    sections, section = [], []
    for paragraph in text.split("\n"):
        parts = [(_hash(x.encode("utf-8", "surrogatepass")), len(x)) for x in leaves(paragraph)]
        own = _hash(b"p" + b"".join(h for h, _ in parts))
        section.append((own, parts))
        if not paragraph.strip() or own[0] % PARAGRAPHS_PER_SECTION == 0:
            sections.append((_hash(b"s" + b"".join(h for h, _ in section)), section))
            section = []
    if section:
        sections.append((_hash(b"s" + b"".join(h for h, _ in section)), section))
    return sections


def fingerprint(text: str) -> str:
    """Root in hex, a colon, and the tree in base64: numbers of sections and paragraphs, then (eight bytes of hash, number) of every section, paragraph and leaf."""
    sections = tree(text)
    root = _hash(b"d" + b"".join(h for h, _ in sections), 16)
    paragraphs = [x for _, own in sections for x in own]
    rows = [(h, len(own)) for h, own in [*sections, *paragraphs]] + [x for _, own in paragraphs for x in own]
    packed = np.array([len(sections), len(paragraphs)], "<u4").tobytes() + b"".join(h + n.to_bytes(4, "little") for h, n in rows)
    return f"{root.hex()}:{base64.b64encode(packed).decode()}"


class Tree:
    """A fingerprint read back: its root, per level hashes, characters and the node above; where each leaf begins."""

    def __init__(self, text: str):
        self.root = text[:32]
        data = base64.b64decode(text[33:])
        n, m = np.frombuffer(data, "<u4", 2).tolist()
        nodes = np.frombuffer(data, [("hash", "<u8"), ("number", "<u4")], offset=8)
        hashes, numbers = np.ascontiguousarray(nodes["hash"]), nodes["number"].astype(np.int64)
        self.hashes = [hashes[:n], hashes[n : n + m], hashes[n + m :]]
        leaf = numbers[n + m :]
        of_section, of_paragraph = np.repeat(np.arange(n), numbers[:n]), np.repeat(np.arange(m), numbers[n : n + m])
        in_paragraph = np.bincount(of_paragraph, leaf, m)
        self.above = [np.zeros(n, np.int64), of_section, of_paragraph]
        self.chars = [np.bincount(of_section, in_paragraph, n), in_paragraph, leaf]
        # a line end stands between paragraphs
        self.begin = np.cumsum(leaf) - leaf + of_paragraph


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a have a partner in b, each of b serving one."""
    order, other = np.argsort(a, kind="stable"), np.sort(b)
    ordered = a[order]
    rank = np.arange(len(a)) - np.searchsorted(ordered, ordered)
    have = np.searchsorted(other, ordered, "right") - np.searchsorted(other, ordered)
    out = np.empty(len(a), bool)
    out[order] = rank < have
    return out


def descend(one: Tree, other: Tree) -> tuple[float, np.ndarray, np.ndarray]:
    """(characters that both have, leaves of one that other lacks, leaves of other that one lacks): branches that both have are not entered."""
    open_ = [np.ones(1, bool), np.ones(1, bool)]
    same = 0.0
    for level in range(3):
        here = [np.flatnonzero(o[t.above[level]]) for t, o in zip((one, other), open_, strict=True)]
        keys = [t.hashes[level][h] for t, h in zip((one, other), here, strict=True)]
        met = _met(*keys), _met(*keys[::-1])
        same += float(one.chars[level][here[0][met[0]]].sum())
        open_ = []
        for t, h, m in zip((one, other), here, met, strict=True):
            left = np.zeros(len(t.hashes[level]), bool)
            left[h[~m]] = True
            open_.append(left)
    return same, np.flatnonzero(open_[0]), np.flatnonzero(open_[1])


def alike(one: Tree, other: Tree) -> tuple[float, np.ndarray]:
    """Share of both texts' characters in branches that both have, 0 to 1 (1.0 if the roots are equal), and the leaves of one that other lacks."""
    if one.root == other.root:
        return 1.0, np.zeros(0, np.int64)
    same, lacking, _ = descend(one, other)
    total = float(one.chars[2].sum() + other.chars[2].sum())
    return 2 * same / total if total else 0.0, lacking


def ranges(tree_: Tree, lacking: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of leaves, neighbours joined."""
    out: list[tuple[int, int]] = []
    for start, size in zip(tree_.begin[lacking].tolist(), tree_.chars[2][lacking].tolist(), strict=True):
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], start + size)
        else:
            out.append((start, start + size))
    return out


def likeness(one: str, other: str) -> float:
    """Share of both texts' characters in branches that both fingerprints have, 0 to 1; 1.0 if the roots are equal."""
    return alike(Tree(one), Tree(other))[0]


def edits(one: str, other: str) -> list[tuple[int, int]]:
    """Character ranges of the text of fingerprint ``one`` in leaves that ``other`` lacks, neighbours joined."""
    tree_ = Tree(one)
    return ranges(tree_, alike(tree_, Tree(other))[1])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, root, fingerprint."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        alone("merkle", _ENDS)
        return texts.map(lambda t: fingerprint(t or ""))

    found = docs.select(id_col, of(F.coalesce(text_col, F.lit(""))).alias("fingerprint"))
    return found.withColumn("root", F.substring("fingerprint", 1, 32))


def equal_classes(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, class_id: documents of equal roots share the least id; partial minima leave no task a whole group."""
    first = prints.groupBy("root").agg(F.min(id_col).alias("class_id"))
    return prints.select(id_col, "root").join(first, "root").select(id_col, "class_id")


def branches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every node: the id under its own name, level (section, paragraph, leaf), path, start, end, hash; join two versions on path and hash to compare."""
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("level string, path string, start long, end long, hash string")])
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("merkle", _ENDS)
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                for i, (section, paragraphs) in enumerate(tree(text or "")):
                    begun = at
                    for j, (paragraph, parts) in enumerate(paragraphs):
                        start = at
                        for k, (leaf, size) in enumerate(parts):
                            rows.append((own, "leaf", f"{i}.{j}.{k}", at, at + size, leaf.hex()))
                            at += size
                        rows.append((own, "paragraph", f"{i}.{j}", start, at, paragraph.hex()))
                        at += 1
                    rows.append((own, "section", f"{i}", begun, at - 1, section.hex()))
                yield record_batch(rows, kinds)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs (id, key, text, bucket, kind) dealt by ranges of the id, each range followed by the next one's first rows.

    One shuffle carries the texts.  Range bounds and each range's least id (a
    few numbers a task) are found first from the ids alone; the rows of that
    least id are sent to the range before as well (kind 1), and the rows of
    the very first to the last range (kind 2).
    """
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))) if whole else F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = rows.select("key")
    n = keys.count()
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(n / ROWS_PER_TASK))
    # bounds from ids of chosen hash, some 64 a range
    chosen = keys.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // (64 * parts)))) == 0).toPandas()["key"]
    ordered = np.sort(chosen.to_numpy(np.int64 if whole else object))
    bounds = np.unique(ordered[[len(ordered) * i // parts for i in range(1, parts)]]) if len(ordered) else ordered

    def find(key: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, key.to_numpy(np.int64 if whole else object), "right").astype(np.int32)

    @F.pandas_udf("int")
    def home(key: pd.Series) -> pd.Series:
        return pd.Series(find(key))

    heads = sorted((r.bucket, r.key) for r in keys.select(home("key").alias("bucket"), "key").groupBy("bucket").agg(F.min("key").alias("key")).collect())
    before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads) if i}
    first, last = (heads[0][1], heads[-1][0]) if heads else (0, 0)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        return pd.Series([[int(b) * 4] + ([before[k] * 4 + 1] if k in before else []) + ([last * 4 + 2] if k == first else []) for b, k in zip(find(key), key, strict=True)])

    dealt = rows.withColumn("place", F.explode(places("key"))).withColumn("bucket", F.floor(F.col("place") / 4).cast("int")).withColumn("kind", F.col("place") % 4).drop("place")
    order = ["bucket", (F.col("kind") == 2), "key", F.col("id").isNotNull(), "text", "kind"]
    return dealt.repartitionByRange(parts, "bucket").sortWithinPartitions(*order)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, the likenesses of both and of the next text's, and where the first differs from the edited one."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edits long, first_edit long")])
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("merkle", _ENDS)
        held = None
        for batch in batches:
            rows = []
            for own, _, text, bucket, place in zip(*(batch.column(i) for i in range(5)), strict=True):
                text, bucket, place = text.as_py(), bucket.as_py(), place.as_py()
                now = fingerprint(text)
                now_tree = Tree(now)
                if held and held[2] == bucket and held[4] == 0:
                    changed = edited_text(held[1], text)
                    other = fingerprint(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    near, lacking = alike(held[5], Tree(other))
                    found = ranges(held[5], lacking)
                    rows.append((held[0], len(held[1]), digest, held[3], other, near, alike(held[5], now_tree)[0], len(found), found[0][0] if found else None))
                held = (own.as_py(), text, bucket, now, place, now_tree)
            if rows:
                yield record_batch(rows, kinds)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
