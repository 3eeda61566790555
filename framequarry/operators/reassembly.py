"""IP defragmentation, TCP reassembly, following streams, and their packets."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framequarry.functions.bits import checksum_of, ip_text, to_bytes
from framequarry.operators.analytics import conversation_key, flag_text
from framequarry.operators.headers import capture_columns, payload, with_headers
from framequarry.shared import small_batches


def _ready(df: DataFrame) -> DataFrame:
    return df if "l4_off" in df.columns else with_headers(df)


def defragment(frames: DataFrame, idle: float = 30.0) -> DataFrame:
    """file (if frames has it), frame_no (of the last piece needed), packet (the whole IPv4 packet, no link header), fragments.

    Packets that are not fragments pass. Fragments meet by source, destination, protocol and identification. An
    identification may come again: a packet ends with the piece that completes it, and pieces after that, or after
    `idle` seconds without one (if frames have times), are of the next. Of bytes sent twice the earlier frame's count; a packet is complete with its first and last piece and all
    bytes between. Its header is the first fragment's, with length, flags and checksum made right. All of it is
    aggregates over a packet's pieces, 64 KiB at most, so nothing here needs Python.
    """
    df = _ready(frames).where(F.col("ip_v") == 4)
    own = capture_columns(df)
    whole = F.substring("frame", F.col("l3_off") + 1, F.least(F.length("frame") - F.col("l3_off"), F.greatest(F.col("ip_len"), F.col("ip_ihl"))))
    more, off = F.col("ip_flags").bitwiseAND(F.lit(1)) != 0, F.col("ip_frag") * 8
    one = df.where(~more & (off == 0)).select(*own, "frame_no", whole.alias("packet"), F.lit(1).cast("bigint").alias("fragments"))
    body = F.substring("frame", F.col("l4_off") + 1, F.greatest(F.lit(0), F.col("l4_end") - F.col("l4_off")))
    ident = [*own, "ip_src", "ip_dst", "ip_proto", "ip_id"]
    ts = F.col("ts_ns") if "ts_ns" in df.columns else F.lit(0)
    parts = df.where(more | (off > 0)).select(*ident, "frame_no", ts.alias("ts"), off.alias("off"), more.alias("more"), body.alias("body"), F.when(off == 0, F.substring("frame", F.col("l3_off") + 1, F.col("ip_ihl"))).alias("head"))
    parts = parts.withColumn("end", F.col("off") + F.length("body"))
    # where packets of one identification end: after a pause, and after the piece that completes one
    order = Window.partitionBy(*ident).orderBy("frame_no")
    pause = F.coalesce(F.col("ts") - F.lag("ts").over(order) > int(idle * 1e9), F.lit(False))
    runs = parts.withColumn("run", F.sum(pause.cast("int")).over(order))
    places = F.array_sort(F.collect_list(F.struct("frame_no", "off", "end", "more")))
    spans = runs.groupBy(*ident, "run").agg(places.alias("p")).select(*ident, "run", _completions("p").alias("ends"))
    numbered = runs.join(spans, [*ident, "run"]).withColumn("packet_no", F.size(F.filter("ends", lambda e: e < F.col("frame_no")))).drop("ends", "ts")
    key = [*ident, "run", "packet_no"]
    # byte ranges that earlier frames have not given: the pieces sorted by offset, each cut at what came before
    w = Window.partitionBy(*key).orderBy("off", "frame_no").rowsBetween(Window.unboundedPreceding, -1)
    cut = numbered.withColumn("have", F.coalesce(F.max("end").over(w), F.lit(0)))
    fresh = cut.withColumn("gap", F.col("off") > F.col("have")).withColumn("piece", F.when(F.col("end") > F.col("have"), F.substring("body", F.greatest(F.lit(1), F.col("have") - F.col("off") + 1), F.length("body"))).otherwise(F.lit(b"")))
    got = fresh.groupBy(*key).agg(
        F.max("frame_no").alias("frame_no"),
        F.count("*").alias("fragments"),
        F.bool_or("gap").alias("gap"),
        F.min("off").alias("low"),
        F.max("end").alias("size"),
        F.max(F.when(~F.col("more"), F.col("end"))).alias("last"),
        F.min_by("head", F.when(F.col("head").isNotNull(), F.col("frame_no"))).alias("head"),
        F.array_sort(F.collect_list(F.struct("off", "frame_no", "piece"))).alias("pieces"),
    )
    done = got.where(~F.col("gap") & (F.col("low") == 0) & F.col("head").isNotNull() & (F.col("last") == F.col("size")))
    data = F.aggregate(F.transform("pieces", lambda p: p["piece"]), F.lit(b""), lambda a, p: F.concat(a, p))
    total = F.length("head") + F.col("size")
    plain = F.concat(F.substring("head", 1, 2), to_bytes(total, 2), F.substring("head", 5, 2), F.lit(b"\0\0"), F.substring("head", 9, 2), F.lit(b"\0\0"), F.substring("head", 13, 48))
    done = done.withColumn("plain", plain).withColumn("data", data)
    packet = F.concat(F.substring("plain", 1, 10), to_bytes(checksum_of("plain"), 2), F.substring("plain", 13, 48), "data")
    return one.union(done.select(*own, "frame_no", packet.alias("packet"), "fragments"))


def _completions(places: str) -> Column:
    """Of pieces (frame_no, off, end, more) in order, the frames after which a packet has its first and last piece and all bytes between.

    State: the pieces of the packet so far, its end (-1: not known), and the frames found.
    """
    zero = F.struct(F.array().cast("array<struct<off: int, end: int>>").alias("have"), F.lit(-1).alias("size"), F.array().cast("array<bigint>").alias("found"))

    def step(s: Column, p: Column) -> Column:
        have = F.concat(s["have"], F.array(F.struct(p["off"].cast("int").alias("off"), p["end"].cast("int").alias("end"))))
        size = F.when(~p["more"], p["end"].cast("int")).otherwise(s["size"])
        reach = F.aggregate(F.array_sort(have), F.lit(0), lambda r, x: F.when(x["off"] <= r, F.greatest(r, x["end"])).otherwise(r))
        whole = (size >= 0) & (reach >= size)
        empty = F.array().cast("array<struct<off: int, end: int>>")
        return F.struct(F.when(whole, empty).otherwise(have).alias("have"), F.when(whole, F.lit(-1)).otherwise(size).alias("size"), F.when(whole, F.concat(s["found"], F.array(p["frame_no"]))).otherwise(s["found"]).alias("found"))

    return F.aggregate(places, zero, step, lambda s: s["found"])


_MOD, _HALF = 1 << 32, 1 << 31


def _step(seq: int, other: int) -> int:
    """seq - other in 32-bit serial arithmetic, signed."""
    return (seq - other + _HALF) % _MOD - _HALF


class GapIndex:
    """Which bytes of one direction have been seen, as offsets from its first: disjoint ranges, joined where they touch, so there is one more
    than there are gaps. Every byte is the first frame's that has it. No data is kept."""

    def __init__(self) -> None:
        self.base: int | None = None  # the sequence number of offset 0
        self.stream = 0  # a SYN with another number begins the next one
        self._clear()

    def _clear(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.seq, self.off = self.base, 0  # the place that offsets are unwrapped from

    def add(self, seq: int, size: int, syn: bool) -> tuple[int, list[tuple[int, int]]]:
        """The offset of this segment's first byte, and the ranges of offsets that it is the first to bring."""
        low = self.place(seq, size, syn)
        return low, self.fresh(max(0, low), low + size)

    def place(self, seq: int, size: int, syn: bool) -> int:
        """The offset of this segment's first byte (0 without data)."""
        if syn:
            seq = (seq + 1) % _MOD
            if seq != self.base:
                self.stream += self.base is not None
                self.base = seq
                self._clear()
        elif self.base is None and size:
            self.base = seq
            self._clear()
        if not size:
            return 0
        low = self.off + _step(seq, self.seq)
        high = low + size
        if high > self.off:
            self.seq, self.off = (seq + size) % _MOD, high
        return low

    def fresh(self, low: int, high: int) -> list[tuple[int, int]]:
        """The ranges from low to high that were not seen before."""
        if low >= high:
            return []
        i = bisect_left(self.ends, low)  # the first range that ends at or after low
        j = bisect_right(self.starts, high)  # those before it begin at or before high
        out, at = [], low
        for k in range(i, j):
            if self.starts[k] > at:
                out.append((at, self.starts[k]))
            at = max(at, self.ends[k])
        if at < high:
            out.append((at, high))
        if i < j:
            low, high = min(low, self.starts[i]), max(high, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [low], [high]
        return out


class HalfStream:
    """One direction's bytes in order, for callers that take them as they come. `hold` segments ahead of the gap wait at most (None: all), `cap` bytes are delivered."""

    def __init__(self, hold: int | None = None, cap: int | None = None):
        self.next: int | None = None
        self.waiting: dict[int, bytes] = {}
        self.order: list[tuple[int, int]] = []  # a heap of (bytes delivered before, number) of what waits
        self.done = 0
        self.hold, self.cap, self.size = hold, cap, 0

    def add(self, seq: int, data: bytes, syn: bool) -> bytes:
        """The bytes that this segment makes available."""
        if syn:
            self.next = (seq + 1) % _MOD
            seq = self.next
            self.order = [(self.done + _step(s, self.next), s) for s in self.waiting]
            heapq.heapify(self.order)
        elif self.next is None:
            if not data:
                return b""
            self.next = seq
        parts = [self._take(seq, data)] if data else []
        while self.order and self.order[0][0] <= self.done:
            _, s = heapq.heappop(self.order)
            if s in self.waiting:
                parts.append(self._take(s, self.waiting.pop(s)))
        out = b"".join(parts)
        if self.cap is not None:
            out = out[: max(0, self.cap - self.size)]
        self.size += len(out)
        return out

    def _take(self, seq: int, data: bytes) -> bytes:
        ahead = _step(seq, self.next)
        if ahead > 0:
            if seq not in self.waiting:
                if self.hold is not None and len(self.waiting) >= self.hold:
                    far = max(self.waiting, key=lambda s: _step(s, self.next))
                    if _step(far, self.next) <= ahead:
                        return b""
                    del self.waiting[far]
                self.waiting[seq] = data
                heapq.heappush(self.order, (self.done + ahead, seq))
            return b""
        fresh = data[-ahead:] if ahead else data
        self.next = (self.next + len(fresh)) % _MOD
        self.done += len(fresh)
        return fresh


def stream_rows(frames: DataFrame) -> DataFrame:
    df = _ready(frames).where(F.col("sport").isNotNull()).withColumn("k", conversation_key())
    return df.select(
        *capture_columns(df),
        F.concat(F.hex("k.lo.ip"), F.lit("/"), F.col("k.lo.port").cast("string"), F.lit("/"), F.hex("k.hi.ip"), F.lit("/"), F.col("k.hi.port").cast("string"), F.lit("/"), F.col("k.proto").cast("string")).alias("conv"),
        "frame_no", "ts_ns", "ip_src", "sport", "tcp_seq", "tcp_flags", payload().alias("data"),
    )


_SEGMENTS = "conv string, frame_no bigint, ts_ns bigint, to_server boolean, data binary"


def follow_segments(frames: DataFrame, hold: int | None = None, cap: int | None = None) -> DataFrame:
    """file (if frames has it), conv, frame_no, ts_ns, to_server, data: each conversation's delivered bytes in the order in which they became available.

    The sender of the first frame is the client. TCP bytes come in sequence order, UDP payloads as they were sent. A byte is
    that of the first frame that has it, and is delivered by the frame after which it and all before it have been seen; a SYN with another
    number begins another stream. What lies beyond a gap that is never filled is not delivered (missing_bytes() lists such gaps).

    One shuffle, by conversation. Rows sorted by frame go through an index of gaps, which keeps ranges and no data; sorted by
    offset, a running maximum of frame numbers says when each piece is delivered; then they are sorted by that. The sorts
    spill, so no task's memory grows behind a lost segment. With `hold`, so many segments wait in memory at most, and those beyond are dropped.
    """
    if hold is not None:
        return _held_segments(frames, hold, cap)
    own = capture_columns(frames)
    return delivered_pieces(frames, cap).sortWithinPartitions(*own, "conv", "frame_no", "to_server", "stream", "off").select(*own, "conv", "frame_no", "ts_ns", "to_server", "data")


def delivered_pieces(frames: DataFrame, cap: int | None = None) -> DataFrame:
    """file (if frames has it), conv, to_server, stream, off, frame_no, ts_ns, data: delivered bytes direction by direction, in the order of their offsets."""
    own = capture_columns(frames)
    return _delivered(_pieces(frames).sortWithinPartitions(*own, "conv", "to_server", "stream", "off"), own, cap)


def _own_fields(own: list[str]) -> list[str]:
    return [f"`{c}` string" for c in own]


def _by_conversation(frames: DataFrame) -> tuple[DataFrame, list[str]]:
    small_batches(frames.sparkSession)
    rows = stream_rows(frames)
    own = capture_columns(rows)
    return rows.repartition(*own, "conv").sortWithinPartitions(*own, "conv", "frame_no"), own


def _pieces(frames: DataFrame) -> DataFrame:
    """conv, to_server, stream, off, frame_no, ts_ns, data: bytes not seen before, by their offset in the stream; UDP payloads follow each other."""
    dealt, own = _by_conversation(frames)
    names = [*own, "conv", "to_server", "stream", "off", "frame_no", "ts_ns", "data"]
    types = [*(pa.string() for _ in own), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, client, halves, sent = None, None, {}, {}
        for b in batches:
            out: list[tuple] = []
            for *k, no, ts, ip, port, seq, flags, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != conv:
                    conv, client, halves, sent = k, (ip, port), {}, {}
                up = (ip, port) == client
                if seq is None:
                    if data:
                        out.append((*k, up, 0, sent.get(up, 0), no, ts, data))
                        sent[up] = sent.get(up, 0) + len(data)
                    continue
                gaps = halves.get(up)
                if gaps is None:
                    gaps = halves[up] = GapIndex()
                first, fresh = gaps.add(seq, len(data or b""), bool(flags & 2))
                out += [(*k, up, gaps.stream, low, no, ts, data[low - first : high - first]) for low, high in fresh]
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return dealt.mapInArrow(run, ", ".join([*_own_fields(own), "conv string, to_server boolean, stream int, off bigint, frame_no bigint, ts_ns bigint, data binary"]))


def _delivered(pieces: DataFrame, own: list[str], cap: int | None) -> DataFrame:
    """Of pieces sorted by direction, stream and offset those before the first gap, cut at `cap` bytes of a direction; frame_no and ts_ns are of the frame that delivers them."""
    spec = [*_own_fields(own), "conv string, to_server boolean, stream int, off bigint, frame_no bigint, ts_ns bigint, data binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, stream, reach, last, given = None, None, 0, (0, 0), 0
        for b in batches:
            keep, nos, times, datas = [], [], [], []
            data = b.column("data")
            sizes = pc.binary_length(data).to_pylist()
            for i, (*k, up, s, off, no, ts) in enumerate(zip(*(c.to_pylist() for c in b.drop_columns("data").columns), strict=True)):
                if (k, up) != side:
                    side, stream, reach, last, given = (k, up), s, 0, (0, 0), 0
                elif s != stream:
                    stream, reach, last = s, 0, (0, 0)
                if off != reach:
                    continue  # the first gap, or beyond it: reach stays
                reach, last = off + sizes[i], max(last, (no, ts or 0))
                n = sizes[i] if cap is None else min(sizes[i], cap - given)
                if n > 0:
                    given += n
                    keep.append(i)
                    nos.append(last[0])
                    times.append(last[1])
                    datas.append(data[i] if n == sizes[i] else pa.scalar(data[i].as_py()[:n], pa.binary()))
            got = b.take(pa.array(keep, pa.int64()))
            columns = {"frame_no": pa.array(nos, pa.int64()), "ts_ns": pa.array(times, pa.int64()), "data": got.column("data") if cap is None else pa.array([d.as_py() for d in datas], pa.binary())}
            yield pa.RecordBatch.from_arrays([columns.get(n, got.column(n)) for n in got.schema.names], names=got.schema.names)

    return pieces.mapInArrow(run, ", ".join(spec))


def missing_bytes(frames: DataFrame) -> DataFrame:
    """file (if frames has it), conv, to_server, stream, low, high: ranges of a direction's offsets that no frame has brought, before the last byte seen."""
    own = capture_columns(frames)
    order = Window.partitionBy(*own, "conv", "to_server", "stream").orderBy("off")
    end = F.col("off") + F.length("data")
    seen = _pieces(frames).withColumn("low", F.coalesce(F.lag(end).over(order), F.lit(0).cast("bigint")))
    return seen.where("low < off").select(*own, "conv", "to_server", "stream", "low", F.col("off").alias("high"))


def _held_segments(frames: DataFrame, hold: int, cap: int | None) -> DataFrame:
    """follow_segments() with a bound on the segments that wait."""
    dealt, own = _by_conversation(frames)
    names = [*own, "conv", "frame_no", "ts_ns", "to_server", "data"]
    types = [*(pa.string() for _ in own), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, client, halves = None, None, {}
        for b in batches:
            out: list[tuple] = []
            for *k, no, ts, ip, port, seq, flags, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != conv:
                    conv, client, halves = k, (ip, port), {}
                up = (ip, port) == client
                if seq is None:
                    got = data or b""
                else:
                    half = halves.setdefault(up, HalfStream(hold, cap))
                    got = half.add(seq, data or b"", bool(flags & 2))
                if got:
                    out.append((*k, no, ts, up, got))
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return dealt.mapInArrow(run, ", ".join([*_own_fields(own), _SEGMENTS]))


def follow_stream(frames: DataFrame, hold: int | None = None, cap: int | None = None) -> DataFrame:
    """One row for each conversation: file (if frames has it), conv, client (bytes sent by the first sender), server.

    A row holds a whole conversation, so `cap` must bound what a direction delivers where conversations may be huge;
    follow_segments() has no such bound, its rows are segments.
    """
    own = capture_columns(frames)
    if hold is None:
        seg, order = delivered_pieces(frames, cap), "struct(stream, off)"
    else:
        seg, order = _held_segments(frames, hold, cap), "frame_no"
    side = lambda up: F.expr(f"listagg(data) WITHIN GROUP (ORDER BY {order}) FILTER (WHERE {'to_server' if up else 'NOT to_server'})")
    empty = F.lit(b"")
    return seg.groupBy(*own, "conv").agg(F.coalesce(side(True), empty).alias("client"), F.coalesce(side(False), empty).alias("server"))


def stream_packets(frames: DataFrame, conversation: int, file: str | None = None) -> DataFrame:
    """frame_no, ts_ns, seq, ack, len, win, to_server, flags of the conversation whose first frame is `conversation`; of several captures, name the file."""
    df = _ready(frames).where(F.col("sport").isNotNull())
    if file is not None:
        df = df.where(F.col("file") == file)
    ends = ["ip_src", "sport", "ip_dst", "dport"]
    first = df.where(F.col("frame_no") == conversation).select(F.col("l4_proto").alias("_p"), *(F.col(c).alias(f"_{c}") for c in ends))
    same = F.col("ip_src").eqNullSafe(F.col("_ip_src")) & (F.col("sport") == F.col("_sport")) & (F.col("ip_dst") == F.col("_ip_dst")) & (F.col("dport") == F.col("_dport"))
    back = F.col("ip_src").eqNullSafe(F.col("_ip_dst")) & (F.col("sport") == F.col("_dport")) & (F.col("ip_dst") == F.col("_ip_src")) & (F.col("dport") == F.col("_sport"))
    own = df.join(F.broadcast(first), (F.col("l4_proto") == F.col("_p")) & (same | back))  # one row
    return own.select("frame_no", "ts_ns", F.col("tcp_seq").alias("seq"), F.col("tcp_ack").alias("ack"), F.col("pay_len").alias("len"), F.col("tcp_win").alias("win"), same.alias("to_server"), flag_text().alias("flags"))


def half_stream_sizes(frames: DataFrame) -> DataFrame:
    """file (if frames has it), conv, to_server, bytes delivered in order."""
    seg = follow_segments(frames)
    return seg.groupBy(*capture_columns(seg), "conv", "to_server").agg(F.sum(F.length("data").cast("bigint")).alias("bytes"))


def ends_text(frames: DataFrame) -> DataFrame:
    """The frames with src and dst as text."""
    return _ready(frames).withColumns({"src": ip_text("ip_src"), "dst": ip_text("ip_dst")})
