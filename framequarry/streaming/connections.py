"""TCP connections in streams: delivered bytes, and HTTP bodies as they come, with state of a stated size.

Of each conversation the state store keeps a small value (where each direction stands, the offsets that wait, the parser's head and what is left
of its message) and a map of the segments that wait for a gap, written one by one: `hold` for each direction at most, the farthest is dropped beyond that.
Bodies are never kept: their parts go out as rows as they are delivered. A conversation without frames for `idle` is ended: what the parser had begun goes out
as incomplete, and its state is removed. The session needs a state store that has maps: use_maps(spark) sets it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framequarry.operators.headers import capture_columns
from framequarry.operators.messages import HttpCarver, Part
from framequarry.operators.reassembly import _MOD, _step, stream_rows

#: Delivered bytes: the how many-th byte of the direction `data` begins with, and the frame that made it deliverable.
BYTES = "conv string, frame_no bigint, to_server boolean, off bigint, data binary"
#: A part of a body (done is false), or its end, with what is known of it.
PARTS = "conv string, object bigint, off bigint, data binary, done boolean, frame bigint, hostname string, content_type string, filename string, len bigint, complete boolean"


def use_maps(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB, which comes with Spark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class _Side:
    next: int | None = None  # the sequence number that is wanted
    done: int = 0  # bytes delivered
    waiting: list[int] = field(default_factory=list)  # offsets of held segments, sorted


@dataclass
class _Meta:
    client: tuple[str, int]
    sides: dict[bool, _Side]
    carver: HttpCarver


class _Connection(StatefulProcessor):
    def __init__(self, hold: int, idle_ms: int, carve: bool, names: list[str]):
        self.most, self.idle_ms, self.carve, self.names = hold, idle_ms, carve, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "value binary")
        self.held = handle.getMapState("held", "to_server boolean, off bigint", "data binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("frame_no", kind="stable")
        meta = pickle.loads(bytes(self.meta.get()[0])) if self.meta.exists() else None
        out: list[tuple] = []
        for no, ip, port, seq, flags, data in zip(*(batch[c] for c in ("frame_no", "ip_src", "sport", "tcp_seq", "tcp_flags", "data")), strict=True):
            end = bytes(ip).hex(), int(port)
            meta = meta or _Meta(end, {True: _Side(), False: _Side()}, HttpCarver())
            up = end == meta.client
            data = b"" if data is None else bytes(data)
            side = meta.sides[up]
            if pd.isna(seq):
                out += self._out(meta, up, int(no), [(side.done, data)] if data else [])
                side.done += len(data)
            else:
                out += self._out(meta, up, int(no), self._delivered(side, up, int(seq), data, bool(int(flags) & 2)))
        self.meta.update((pickle.dumps(meta),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.meta.exists():
            meta = pickle.loads(bytes(self.meta.get()[0]))
            left = [self._event(e) for e in meta.carver.finish()] if self.carve else []
            self.meta.clear()
            self.held.clear()
            yield self._frame(key, left)

    def close(self) -> None:
        pass

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in out], columns=self.names)

    @staticmethod
    def _event(e) -> tuple:
        if isinstance(e, Part):
            return (e.number, e.off, e.data, False, None, None, None, None, None, None)
        return (e.number, None, None, True, e.frame, e.hostname, e.content_type, e.filename, e.size, e.complete)

    def _out(self, meta: _Meta, up: bool, no: int, delivered: list[tuple[int, bytes]]) -> list[tuple]:
        if not self.carve:
            return [(no, up, off, data) for off, data in delivered]
        return [self._event(e) for _, data in delivered for e in meta.carver.feed(up, no, data)]

    def _delivered(self, s: _Side, up: bool, seq: int, data: bytes, syn: bool) -> list[tuple[int, bytes]]:
        """What a segment makes deliverable; offsets go on from stream to stream of a direction."""
        if syn:
            seq = (seq + 1) % _MOD
            if s.next is None or not s.done or _step(seq, s.next) > 0 or -_step(seq, s.next) > s.done:  # not a SYN seen again
                for off in s.waiting:
                    self.held.removeKey((up, off))
                s.waiting, s.next = [], seq
        elif s.next is None:
            if not data:
                return []
            s.next = seq
        if not data:
            return []
        low = s.done + _step(seq, s.next)
        if low > s.done:
            self._hold(s, up, low, data)
            return []
        out = self._taken(s, low, data)
        while s.waiting and s.waiting[0] <= s.done:
            off = s.waiting.pop(0)
            out += self._taken(s, off, bytes(self.held.getValue((up, off))[0]))
            self.held.removeKey((up, off))
        return out

    @staticmethod
    def _taken(s: _Side, low: int, data: bytes) -> list[tuple[int, bytes]]:
        fresh = data[s.done - low :]
        if not fresh:
            return []
        at, s.done, s.next = s.done, s.done + len(fresh), (s.next + len(fresh)) % _MOD
        return [(at, fresh)]

    def _hold(self, s: _Side, up: bool, low: int, data: bytes) -> None:
        if low in s.waiting:
            return
        if len(s.waiting) >= self.most:
            if s.waiting[-1] <= low:
                return
            self.held.removeKey((up, s.waiting.pop()))
        s.waiting.append(low)
        s.waiting.sort()
        self.held.updateValue((up, low), (data,))


def _run(frames: DataFrame, hold: int, idle: str, carve: bool) -> DataFrame:
    rows = stream_rows(frames)
    own = capture_columns(rows)
    fields = BYTES if not carve else PARTS
    names = [*own, *(f.strip().split()[0] for f in fields.split(","))]
    processor = _Connection(hold, int(pd.Timedelta(idle).total_seconds() * 1000), carve, names)
    schema = ", ".join([*(f"`{c}` string" for c in own), fields])
    return rows.groupBy(*own, "conv").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def follow_stream_updates(frames: DataFrame, hold: int = 256, idle: str = "10 minutes") -> DataFrame:
    """file (if frames has it) and BYTES of a stream of frames."""
    return _run(frames, hold, idle, False)


def http_parts(frames: DataFrame, hold: int = 256, idle: str = "10 minutes") -> DataFrame:
    """file (if frames has it) and PARTS of the HTTP responses in a stream of frames."""
    return _run(frames, hold, idle, True)


def joined_parts(parts: DataFrame) -> DataFrame:
    """The bodies of stored PARTS: file (if they have it), conv, object, frame, hostname, content_type, filename, len, complete, data."""
    from pyspark.sql import functions as F

    own = capture_columns(parts)
    names = ["frame", "hostname", "content_type", "filename", "len", "complete"]
    ends = parts.where("done").select(*own, "conv", "object", *names)
    bodies = parts.where("NOT done").groupBy(*own, "conv", "object").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY off)").alias("data"))
    return ends.join(bodies, [*own, "conv", "object"])
