"""Byte-level BPE by a lazily determinised finite-state transducer.

A merge list fixes, for every byte string, one token sequence.  That sequence
is also the only one in which every two neighbours are *compatible*: encoding
the two tokens' bytes together gives the same two tokens back.  So the
encoding is the single accepting path of a nondeterministic transducer whose
arcs spell tokens and join only compatible ones.  ``Transducer`` runs the
subset construction over it byte by byte and remembers each step:

* a *hypothesis* is (tokens not yet emitted, last token, place in the token
  trie); a state is the set of hypotheses that the bytes so far allow;
* what all hypotheses share at their front is emitted at once, so a token
  leaves after a lookahead bounded by the longest token;
* states and steps are made when first met and kept in a table of bounded
  size, which is dropped and begun anew when full.

Decoding is the reverse table; text comes out through ``Utf8Stream``, a
byte-level state machine that holds back a character split between chunks.

Rows: a null text counts as empty and gives no tokens; texts of any length
are encoded whole; rows repeat as they are; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import alone

#: Remembered steps and pieces of one Python worker, about 130 MB and 60 MB when full.
MAX_STEPS, MAX_PIECES = 400_000, 250_000
#: Texts below this code point take the faster pattern engine.
LATIN = 0x250
#: The rank of a pair that is no token.
NEVER = 1 << 60
#: Tokens decoded at a time.
CHUNK = 1 << 16


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 and rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_bytes(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The definition: join the leftmost pair of least rank until none is left.

    Used to find which tokens go together and, in tests, as brute force.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NEVER))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def narrowed(pattern: str):
    """(findall, search): the pattern by the faster ``re`` for texts below U+0250, and a search for what is above.

    Character properties become lists of the letters below that bound; where
    the pattern has other constructs of ``regex`` the first is None.
    """
    kinds = {k: "".join(re.escape(chr(c)) for c in range(LATIN) if regex.fullmatch(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, at, inside = [], 0, False
    while at < len(pattern):
        kind = next((k for k in (*kinds, r"\S") if pattern.startswith(k, at)), None)
        if kind == r"\S":
            if inside:
                return None, None
            out.append(f"[^{kinds[r'\s']}]")
        elif kind:
            out.append(kinds[kind] if inside else f"[{kinds[kind]}]")
        elif pattern[at] == "\\":
            return None, None
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
        at += len(kind or ".")
    try:
        return re.compile("".join(out)).findall, re.compile(f"[^\x00-{chr(LATIN - 1)}]").search
    except re.error:
        return None, None


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_steps: int = MAX_STEPS):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.max_steps = max_steps
        self._pairs: dict[tuple[int, int], bool] = {}
        self._opens: dict[int, bool] = {}
        self._grown: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        #: Tokens that no merging makes: used only for a piece that equals them.
        self._never = {i for t, i in ranks.items() if len(t) > 1 and merge_bytes(ranks, t) != [i]}
        self._build_trie()
        self._forget()

    def _build_trie(self) -> None:
        self._child: dict[int, int] = {}  # node * 256 + byte -> node
        self._token: list[int] = [-1]
        self._below: dict[int, list[int]] = {}  # node -> tokens that go on from it
        for token, number in self.ranks.items():
            node = 0
            for byte in token:
                if node and number not in self._never:
                    self._below.setdefault(node, []).append(number)
                key = node << 8 | byte
                if key not in self._child:
                    self._child[key] = len(self._token)
                    self._token.append(-1)
                node = self._child[key]
            self._token[node] = number

    def _open(self, last: int, node: int) -> bool:
        """Can a longer token that begins with this node's bytes follow last?"""
        if last < 0:
            return True
        key = last << 32 | node
        known = self._opens.get(key)
        if known is None:
            if len(self._opens) >= self.max_steps:
                self._opens.clear()
            known = self._opens[key] = any(not self._joins(last, t) for t in self._below[node])
        return known

    def _forget(self) -> None:
        start = (((), -1, 0),)
        self._states = [start]
        self._number = {start: 0}
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._rest: list[tuple[int, ...]] = [()]

    def compatible(self, left: int, right: int) -> bool:
        """May the token right follow left? (left -1: may right stand alone?)"""
        key = (left, right)
        if key not in self._pairs:
            if len(self._pairs) >= self.max_steps:
                self._pairs.clear()
            self._pairs[key] = (left < 0 or not self._joins(left, right)) and right not in self._never
        return self._pairs[key]

    def _joins(self, left: int, right: int) -> bool:
        """Would some merge cross the border between the two tokens?

        Both tokens grow by their own merges, in rank order; a crossing merge
        of the parts that touch happens when its rank comes before the merge
        that next changes either part.
        """
        ends, starts = self._growth(left, -1), self._growth(right, 0)
        i = j = 0
        while True:
            crossing = self.ranks.get(self.tokens[ends[i]] + self.tokens[starts[j]], NEVER)
            if crossing == NEVER and i + 1 == len(ends) and j + 1 == len(starts):
                return False
            grow_left = ends[i + 1] if i + 1 < len(ends) else NEVER
            grow_right = starts[j + 1] if j + 1 < len(starts) else NEVER
            # of equal ranks the leftmost pair goes first
            if crossing < grow_left and crossing <= grow_right:
                return True
            if grow_left == NEVER and grow_right == NEVER:
                return False
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _growth(self, token: int, side: int) -> list[int]:
        """The parts that stand at one side of a token as its merges go on."""
        known = self._grown[side]
        if token not in known:
            parts, seen = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))], []
            while True:
                if not seen or seen[-1] != self.ranks[parts[side]]:
                    seen.append(self.ranks[parts[side]])
                if len(parts) == 1:
                    break
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known[token] = seen
        return known[token]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        after, whole = [], None
        for out, last, node in self._states[state]:
            child = self._child.get(node << 8 | byte)
            if child is None:
                continue
            token = self._token[child]
            if token >= 0 and whole is None and self.compatible(last, token):
                whole = (*out, token)
            if child in self._below and self._open(last, child):
                after.append((out, last, child))
        if whole is None:
            raise ValueError(f"no token for byte {byte}: the vocabulary lacks single bytes")
        after.append((whole, whole[-1], 0))
        shared = 0
        first = after[0][0]
        while shared < len(first) and all(len(h[0]) > shared and h[0][shared] == first[shared] for h in after):
            shared += 1
        key = tuple((out[shared:], last, node) for out, last, node in after)
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self._states)
            self._states.append(key)
            self._rest.append(key[-1][0])
        step = self._steps[state << 8 | byte] = (number, first[:shared])
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is itself a token is that token."""
        alone = self.ranks.get(piece)
        if alone is not None:
            return [alone]
        if len(self._steps) > self.max_steps:
            self._forget()
        state, out, steps = 0, [], self._steps
        for byte in piece:
            step = steps.get(state << 8 | byte) or self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += self._rest[state]
        return out


class Utf8Stream:
    """Incremental UTF-8: ``feed`` takes any cut of the bytes, gives whole characters.

    The state is how the last bytes end: between characters, or inside one
    that needs more bytes; bad bytes become U+FFFD as in ``bytes.decode``.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """Length of the unfinished but so far valid character that ends data."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte's range depends on the first
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.open_tail(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


class Codec:
    """Texts to ids and back; ``ids`` are packed little-endian uint32."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        self.transducer = Transducer(ranks)
        self._any = regex.compile(pattern).findall
        self._near, self._far = narrowed(pattern)
        self._max = max_pieces
        self._pieces: dict[str, bytes] = {}
        size = max(ranks.values()) + 1
        self._bytes = [b""] * size
        for token, number in ranks.items():
            self._bytes[number] = token

    def encode_packed(self, text: str) -> bytes:
        """All ids of a text, each pattern match on its own."""
        pieces, known = (self._any if self._near is None or self._far(text) else self._near)(text), self._pieces
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > self._max:
            known.clear()
        encode, out = self.transducer.encode, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = np.array(encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(piece) <= 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode_chunks(self, packed: bytes) -> Iterator[bytes]:
        table = self._bytes.__getitem__
        for at in range(0, len(packed), 4 * CHUNK):
            yield b"".join(map(table, np.frombuffer(packed[at : at + 4 * CHUNK], "<u4").tolist()))

    def decode_text(self, packed: bytes) -> str:
        stream = Utf8Stream()
        return "".join([*map(stream.feed, self.decode_chunks(packed)), stream.end()])


_CODECS: dict[str, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec for this vocabulary and pattern, kept between tasks."""
    alone("bpe", _CODECS)
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def vocabulary(spark, path: str):
    """A broadcast of the vocabulary file (under 1 MB: 50,256 short tokens)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, vocab, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, ids binary (little-endian uint32)."""

    def run(batches: Iterable):
        own = codec(vocab.value, pattern)
        for batch in batches:
            packed = [own.encode_packed(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], [id_col, "ids"])

    chosen = docs.select(id_col, docs[text_col].alias("text"))
    return chosen.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, vocab, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The reverse: id_col, text string, by the incremental UTF-8 machine."""

    def run(batches: Iterable):
        own = codec(vocab.value, pattern)
        for batch in batches:
            texts = [own.decode_text(p or b"") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    chosen = encoded.select(id_col, "ids")
    return chosen.mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")


def digests(own: Codec, text: str) -> tuple[bytes, int, str, str, bool]:
    """(packed ids, n_tokens, ids_sha256, decoded_sha256, round_trip) of one text; decoding is streamed."""
    packed = own.encode_packed(text)
    digest, stream, same, at = hashlib.sha256(), Utf8Stream(), True, 0
    for chunk in own.decode_chunks(packed):
        digest.update(chunk)
        part = stream.feed(chunk)
        same &= text.startswith(part, at)
        at += len(part)
    same &= text.startswith(last := stream.end(), at)
    return packed, len(packed) // 4, hashlib.sha256(packed).hexdigest(), digest.hexdigest(), same and at + len(last) == len(text)


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _digest_arrays(texts: pa.Array, own: Codec) -> list[pa.Array]:
    columns = list(zip(*(digests(own, t.as_py() or "")[1:] for t in texts), strict=True)) or [()] * 4
    return [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]


def encode_digests(docs: DataFrame, vocab, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: id, n_tokens, ids_sha256, decoded_sha256, round_trip.

    round_trip tells whether the streamed decoding gave the text back.
    """
    names = [id_col, *(x.split()[0] for x in _DIGESTS.split(", "))]

    def run(batches: Iterable):
        own = codec(vocab.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_digest_arrays(batch.column(1), own)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(id_col, docs[text_col].alias("text"))
    return chosen.mapInArrow(run, f"{id_col} {kind}, {_DIGESTS}")


def with_tokens(docs: DataFrame, vocab, pattern: str, text_col: str = "text") -> DataFrame:
    """docs' columns and what encode_digests adds; columns of docs with those names are replaced."""

    @F.pandas_udf(_DIGESTS)
    def of(texts: pd.Series) -> pd.DataFrame:
        own = codec(vocab.value, pattern)
        rows = [digests(own, t or "")[1:] for t in texts]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _DIGESTS.split(", ")])

    added = [x.split()[0] for x in _DIGESTS.split(", ")]
    kept = [c for c in docs.columns if c not in added]
    return docs.withColumn("_tokens", of(F.coalesce(F.col(text_col), F.lit("")))).select(*kept, "_tokens.*")
