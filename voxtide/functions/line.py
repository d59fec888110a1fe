"""Tasks of a barrier stage as a line of neighbours that exchange arrays.

A solve or a search over a volume takes thousands of steps, each of which needs
the last one's values at the slab borders; as Spark jobs they would take a job
a step.  A barrier stage starts all slabs' tasks together: they tell each other
their addresses through the stage's context and then send border planes to
their neighbours, and sums to the first of the line, over connections of their
own.  If a task or its executor is lost the others see their connections end,
and Spark runs the whole stage again.
"""

from __future__ import annotations

import contextlib
import secrets
import socket
import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds that a task waits for a neighbour.
PATIENCE = 1800


class Line:
    """The first `length` of all tasks of the stage; a task alone needs no connections."""

    def __init__(self, rank: int = 0, length: int = 1, links: dict[int, socket.socket] | None = None):
        self.rank, self.length, self._links = rank, length, links or {}

    @property
    def before(self) -> int | None:
        return self.rank - 1 if self.rank > 0 else None

    @property
    def after(self) -> int | None:
        return self.rank + 1 if self.rank + 1 < self.length else None

    def _send(self, to: int, array: np.ndarray) -> None:
        raw = memoryview(np.ascontiguousarray(array)).cast("B")
        self._links[to].sendall(struct.pack("<q", len(raw)))
        self._links[to].sendall(raw)

    def _receive(self, of: int, kind) -> np.ndarray:
        size = np.empty(1, np.int64)
        self._fill(of, size)
        out = np.empty(int(size[0]) // np.dtype(kind).itemsize, kind)
        self._fill(of, out)
        return out

    def _fill(self, of: int, array: np.ndarray) -> None:
        left = memoryview(array).cast("B")
        while left:
            n = self._links[of].recv_into(left)
            if n == 0:
                raise ConnectionError("a task of the line has ended")
            left = left[n:]

    def exchange(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Send low to the task before and high to the one after; what the two have sent, flat, None at the ends."""
        got: dict[int, np.ndarray] = {}
        # pairs take turns, the lower one of a pair speaks first, so nobody waits for a full buffer
        for turn in (0, 1):
            other = self.after if self.rank % 2 == turn else self.before
            if other is None:
                continue
            mine = high if other > self.rank else low
            if other > self.rank:
                self._send(other, mine)
                got[other] = self._receive(other, mine.dtype)
            else:
                got[other] = self._receive(other, mine.dtype)
                self._send(other, mine)
        return got.get(self.rank - 1), got.get(self.rank + 1)

    def sums(self, *values: float) -> tuple[float, ...]:
        """Sums over the line, added in its order, the same in every task."""
        total = np.array(values, np.float64)
        if self.length == 1:
            return values
        if self.rank == 0:
            for other in range(1, self.length):
                total += self._receive(other, np.float64)
            for other in range(1, self.length):
                self._send(other, total)
            return tuple(total.tolist())
        self._send(0, total)
        return tuple(self._receive(0, np.float64).tolist())

    def first(self, length: int) -> Line:
        """The line of its first tasks alone."""
        return Line(self.rank, length, self._links)


@contextlib.contextmanager
def connected() -> Iterator[Line]:
    """The line of all tasks of this barrier stage."""
    context = BarrierTaskContext.get()
    rank, infos = context.partitionId(), context.getTaskInfos()
    links: dict[int, socket.socket] = {}
    with contextlib.ExitStack() as stack:
        listener = stack.enter_context(socket.create_server(("", 0), backlog=len(infos)))
        listener.settimeout(PATIENCE)
        host = infos[rank].address.rsplit(":", 1)[0]
        # each task opens connections to those before it that it talks to, with a word that only the stage knows
        told = [m.rsplit("|", 2) for m in context.allGather(f"{host}|{listener.getsockname()[1]}|{secrets.token_hex(16)}")]
        for other in sorted({0, rank - 1} - {rank, -1}):
            link = stack.enter_context(socket.create_connection((told[other][0], int(told[other][1])), PATIENCE))
            link.sendall(told[other][2].encode() + struct.pack("<q", rank))
            links[other] = link
        awaited = set(range(1, len(infos))) if rank == 0 else {rank + 1} & set(range(len(infos)))
        while awaited:
            link, _ = listener.accept()
            link.settimeout(PATIENCE)
            said = b""
            while len(said) < 40 and (more := link.recv(40 - len(said))):
                said += more
            if len(said) < 40 or said[:32] != told[rank][2].encode():
                link.close()
                continue
            stack.enter_context(link)
            other = struct.unpack("<q", said[32:])[0]
            links[other] = link
            awaited.discard(other)
        for link in links.values():
            link.settimeout(PATIENCE)
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        # a task that is done has read all that was sent to it, so its end takes nothing from the others
        yield Line(rank, len(infos), links)


def slots(spark, slabs: int | None) -> int:
    """Tasks of a barrier stage: all must run at once, so at most as many as the cluster has cores."""
    return max(1, min(slabs or spark.sparkContext.defaultParallelism, spark.sparkContext.defaultParallelism))


def along_lines(planes: DataFrame, key: list[str], kernel: Callable, schema: str, slabs: int | None = None) -> DataFrame:
    """kernel(line, first, head, rows) for every value of key, over a line of tasks; its record batches are the result.

    planes have key, x, nx and more columns.  The planes 1 to nx of a key are
    cut into as many slabs as there are tasks, or as planes; a task of the line
    gets the numbers (first, last) of its own planes, head with the key's
    values and sizes (nx, ny, nz), and rows, those of its planes that exist, in
    order.  Tasks go through the keys in one order, a slab in memory at a time.
    """
    n = slots(planes.sparkSession, slabs)
    most = F.least(F.lit(n), F.col("nx"))
    size = ["nx", "ny", "nz"]
    heads = planes.select(*key, *size).distinct().withColumn("slab", F.explode(F.sequence(F.lit(0), most - 1)))
    rows = planes.withColumn("slab", F.floor((F.col("x") - 1) * most.cast("long") / F.col("nx")).cast("int"))
    both = rows.unionByName(heads, allowMissingColumns=True)
    dealt = both.repartitionById(n, F.col("slab").cast("int")).sortWithinPartitions(*key, F.asc_nulls_first("x"))

    def single(batches):
        for batch in batches:
            for k in range(len(batch)):  # a row at a time: a batch may hold planes of many keys
                yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with connected() as line:
            for _, each in groupby(single(batches), lambda r: tuple(r[k] for k in key)):
                head = next(each)
                length = min(n, head["nx"])
                first, last = (-(-(line.rank + k) * head["nx"] // length) + 1 - k for k in (0, 1))
                yield from kernel(line.first(length), first, last, head, list(each))

    return dealt.mapInArrow(task, schema, barrier=True)
