"""Chat formatting at token level.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Each segment is encoded on
its own, the two marks are reserved ids beyond the vocabulary, and the pieces
are laid end to end; where segments begin and end comes from prefix sums of
their lengths, and so does the loss mask (a +1 where an assistant's text
begins, a -1 where it ends, summed up).  Control strings inside a role or a
text are escaped reversibly: ``<``, any backslashes, ``|`` gain one backslash,
so no text holds ``<|`` and unescaping takes one away.

The formatted table has one row a turn (``format_turns``); in order of turn
the rows are the conversation.  ``read_turns`` reads them back where they lie,
``digests`` streams what was read through the task of its conversation, a turn
at a time, as a digest needs its order.

Rows: a null text or role counts as empty, a null turn sorts first, equal
turns are ordered by role and then by their tokens, rows that repeat are turns
each, a null conv_id is a conversation, an empty table gives no rows.  Only
the columns conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from voxtide.llm import bpe
from voxtide.llm.common import arrow_schema, record_batch, stored

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape, and in one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class Formatter:
    """One turn to (ids, mask), and ids back to turns."""

    def __init__(self, codec: bpe.Codec):
        self.codec = codec
        self.start = len(codec._bytes)
        self.end = self.start + 1
        self.newline = np.frombuffer(codec.encode_packed("\n"), "<u4")

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.codec.encode_packed(text), "<u4")

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        marks = [np.array([self.start], "<u4"), np.array([self.end], "<u4")]
        segments = [marks[0], self.encode(escape_role(role)), self.newline, self.encode(escape(text)), marks[1], self.newline]
        bounds = np.cumsum([0, *map(len, segments)])
        delta = np.zeros(bounds[-1] + 1, np.int8)
        if role == ASSISTANT:
            delta[bounds[3]] += 1
            delta[bounds[4]] -= 1
        return np.concatenate(segments), np.cumsum(delta[:-1]).astype(np.int8)

    def decode(self, ids: np.ndarray) -> str:
        return self.codec.decode_text(ids.astype("<u4").tobytes())

    def read(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str, int]]:
        """(role, text, text under the mask, characters of the template and its turn) of every turn."""
        out = []
        for begin, stop in zip(np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end), strict=True):
            inner = self.decode(ids[begin + 1 : stop])
            role, _, text = inner.partition("\n")
            lost = self.decode(ids[begin:stop][mask[begin:stop] == 1])
            out.append((unescape_role(role), unescape(text), unescape(lost), len(START) + len(inner) + len(END) + 1))
        return out


def _typed(turns: DataFrame, more: str, *names: str) -> StructType:
    """Columns of turns and then more, a DDL string."""
    return StructType([*(StructField(n, turns.schema[n].dataType) for n in names), *StructType.fromDDL(more)])


def format_turns(turns: DataFrame, vocab, pattern: str) -> DataFrame:
    """Each row's conv_id, turn, role and its ids (binary, little-endian uint32) and mask (binary, a byte an id); in order of turn they are the conversation."""
    schema = _typed(turns, "role string, ids binary, mask binary", "conv_id", "turn")
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Formatter(bpe.codec(vocab.value, pattern))
        for batch in batches:
            done = [own.turn(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ids, masks = (pa.array([x[k].tobytes() for x in done], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids, masks], schema=kinds)

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_turns(formatted: DataFrame, vocab, pattern: str) -> DataFrame:
    """conv_id, turn, ids of a formatted table and what its tokens say: said_role, said, lost (text under the mask), formatted_chars, n_tokens, loss_tokens."""
    schema = _typed(formatted, "ids binary, said_role string, said string, lost string, formatted_chars long, n_tokens long, loss_tokens long", "conv_id", "turn")
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Formatter(bpe.codec(vocab.value, pattern))
        for batch in batches:
            rows = []
            for conv, turn, packed, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, mask = np.frombuffer(packed, "<u4"), np.frombuffer(loss, np.int8)
                rows += [(conv, turn, packed, role, text, lost, chars, len(ids), int(mask.sum())) for role, text, lost, chars in own.read(ids, mask)]
            yield record_batch(rows, kinds)

    return formatted.select("conv_id", "turn", "ids", "mask").mapInArrow(run, schema)


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens of every conversation of read_turns."""
    schema = _typed(read, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long", "conv_id")
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, began = None, False
        close = lambda: (now, sums[0], turn_hash.hexdigest(), sums[1], loss_hash.hexdigest(), *sums[2:])
        for batch in batches:
            rows = []
            for conv, role, text, lost, chars, size, masked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or conv != now:
                    if began:
                        rows.append(close())
                    now, began = conv, True
                    sums, turn_hash, loss_hash = [0] * 5, hashlib.sha256(), hashlib.sha256()
                turn_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss_hash.update(lost.encode("utf-8", "surrogatepass"))
                sums = [a + b for a, b in zip(sums, (1, len(lost), chars, size, masked), strict=True)]
            if rows:
                yield record_batch(rows, kinds)
        if began:
            yield record_batch([close()], kinds)

    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "said_role", "ids")
    return dealt.select("conv_id", "said_role", "said", "lost", "formatted_chars", "n_tokens", "loss_tokens").mapInArrow(run, schema)


def read_back(turns: DataFrame, vocab, pattern: str) -> DataFrame:
    """Format every conversation into a stored table, read the turns back from its tokens, and digest what was read."""
    return digests(read_turns(stored(format_turns(turns, vocab, pattern), "formatted"), vocab, pattern))
