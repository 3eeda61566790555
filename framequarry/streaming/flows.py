"""Structured Streaming over frames: filters, counts in windows, flows that end, TCP state, defragmentation.

Header parsing and filters are plain columns, so a streaming frame source needs nothing special for them. What keeps state
has a watermark or a timeout: late frames are dropped after `late`, quiet conversations leave the state store.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions.bits import ip_text
from framequarry.operators import analytics
from framequarry.operators.headers import with_headers
from framequarry.operators.tcp_state import stateful_analysis
from framequarry.plans.filters import compile_filter
from framequarry.shared import file_system
from framequarry.sources import captures, tail


def io_graph_stream(frames: DataFrame, series: dict[str, str], width: str = "1 second", late: str = "10 seconds", ts_col: str = "ts") -> DataFrame:
    """Intervals with counts of frames and of those that each named filter matches; an interval comes out once it is over."""
    timed = with_headers(frames).withWatermark(ts_col, late)
    return analytics.io_graph(timed, {k: compile_filter(e).column for k, e in series.items()}, width, ts_col)


def session_flows_stream(frames: DataFrame, gap: str = "60 seconds", late: str = "10 seconds", ts_col: str = "ts") -> DataFrame:
    """Conversations that have been quiet for `gap`."""
    return analytics.session_flows(with_headers(frames).withWatermark(ts_col, late), gap, ts_col)


def conversation_totals(frames: DataFrame) -> DataFrame:
    """Running totals of conversations, for update or complete output."""
    df = with_headers(frames).where(F.col("sport").isNotNull()).withColumn("k", analytics.conversation_key())
    got = df.groupBy("k").agg(F.min("frame_no").alias("id"), F.count("*").alias("packets"), F.sum(F.length("frame").cast("bigint")).alias("bytes"))
    return got.select("id", analytics.proto_name("k.proto").alias("proto"), ip_text("k.lo.ip").alias("addr_lo"), F.col("k.lo.port").alias("port_lo"), ip_text("k.hi.ip").alias("addr_hi"), F.col("k.hi.port").alias("port_hi"), "packets", "bytes")


def filter_stream(frames: DataFrame, expr: str, dialect: str = "capture", **options) -> DataFrame:
    """A header filter on a stream."""
    c = compile_filter(expr, dialect, **options)
    if not c.needs <= {"headers"}:
        raise ValueError("a stream is filtered on header fields; dissect it or add its state first")
    return with_headers(frames).where(c.column).select(*frames.columns)


tcp_analysis_stream = stateful_analysis


class _Datagram:
    """Pieces of one IPv4 packet: bytes by offset, the first header and the end, once known."""

    __slots__ = ("end", "head", "pieces")

    def __init__(self) -> None:
        self.pieces: dict[int, bytes] = {}
        self.head, self.end = b"", -1

    def add(self, off: int, more: bool, body: bytes, head: bytes) -> bytes | None:
        self.pieces.setdefault(off, body)
        if off == 0 and not self.head:
            self.head = head
        if not more:
            self.end = off + len(body)
        if not self.head or self.end < 0:
            return None
        at, out = 0, bytearray()
        for o in sorted(self.pieces):
            if o > at:
                return None
            out += self.pieces[o][at - o :]
            at = max(at, o + len(self.pieces[o]))
        return bytes(out) if at >= self.end else None


def defragment_stream(frames: DataFrame, idle: str = "30 seconds") -> DataFrame:
    """frame_no, packet of every IPv4 packet that becomes complete; pieces of one that does not are forgotten after `idle`."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from framequarry.build.packets import checksum

    df = with_headers(frames).where(F.col("ip_v") == 4)
    whole = (F.col("ip_flags").bitwiseAND(F.lit(1)) == 0) & (F.col("ip_frag") == 0)
    key = F.when(whole, F.concat(F.lit("one/"), F.col("frame_no").cast("string"))).otherwise(F.concat_ws("/", F.hex("ip_src"), F.hex("ip_dst"), F.col("ip_proto").cast("string"), F.col("ip_id").cast("string")))
    rows = df.select(key.alias("k"), "frame_no", (F.col("ip_frag") * 8).alias("off"), (F.col("ip_flags").bitwiseAND(F.lit(1)) != 0).alias("more"), F.substring("frame", F.col("l3_off") + 1, F.col("ip_ihl")).alias("head"), F.substring("frame", F.col("l4_off") + 1, F.greatest(F.lit(0), F.col("l4_end") - F.col("l4_off"))).alias("body"))
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        d = _Datagram()
        if state.exists:
            head, end, offs, bodies = state.get
            d.head, d.end = bytes(head), end
            d.pieces = {int(o): bytes.fromhex(b) for o, b in zip(offs.split(",") if offs else [], bodies.split(",") if offs else [], strict=True)}
        done = None
        for r in pd.concat(list(parts)).sort_values("frame_no").itertuples(index=False):
            got = d.add(r.off, r.more, bytes(r.body), bytes(r.head))
            if got is not None and done is None:
                h = bytearray(d.head)
                h[2:4], h[6:8], h[10:12] = (len(h) + len(got)).to_bytes(2, "big"), b"\0\0", b"\0\0"
                h[10:12] = checksum(bytes(h)).to_bytes(2, "big")
                done = (r.frame_no, bytes(h) + got)
        if done is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame([done], columns=["frame_no", "packet"])
        else:
            state.update((d.head, d.end, ",".join(map(str, d.pieces)), ",".join(b.hex() for b in d.pieces.values())))
            state.setTimeoutDuration(ms)

    return rows.groupBy("k").applyInPandasWithState(run, "frame_no bigint, packet binary", "head binary, end bigint, offs string, bodies string", "append", GroupStateTimeout.ProcessingTimeTimeout)


class _Passed:
    """How many frames each batch of a loop has passed, in the folder of its checkpoint, or in memory where there is none."""

    def __init__(self, checkpoint: str | None):
        self.counts: dict[int, int] = {}
        self.fs, self.folder = file_system(f"{checkpoint.rstrip('/')}/passed") if checkpoint else (None, "")
        if self.fs is not None:
            self.fs.create_dir(self.folder, recursive=True)
            for i in self.fs.get_file_info(pafs.FileSelector(self.folder)):
                batch, _, n = i.base_name.partition("-")
                if batch.isdigit() and n.isdigit():
                    self.counts[int(batch)] = int(n)

    def before(self, batch: int) -> int:
        """A batch that comes again after a failure does not count twice."""
        return sum(n for b, n in self.counts.items() if b < batch)

    def add(self, batch: int, n: int) -> None:
        self.counts[batch] = n
        if self.fs is not None:
            with self.fs.open_output_stream(f"{self.folder}/{batch}-{n}"):
                pass


def capture_loop(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], expr: str = "", count: int | None = None, snaplen: int = 0, checkpoint: str | None = None, growing: bool = False):
    """Follows a folder of capture files: each batch of frames that the filter passes goes to handle(frames, batch number).

    Returns the query; query.stop() breaks the loop. With count, the loop ends by itself once so many frames have passed:
    the batch that reaches it is the last to be handled, and the query stops when it is done. With a checkpoint, frames that passed before
    a restart count. With `growing`, files may still be written to, and each frame comes once it is whole (sources.tail).
    """
    if growing:
        tail.register(spark)
        source = spark.readStream.format("capture_tail").load(folder)
    else:
        source = captures.read_capture_stream(spark, folder)
    frames = captures.snapped(source, snaplen)
    passed = filter_stream(frames, expr) if expr else frames
    seen, enough = _Passed(checkpoint), threading.Event()

    def each(batch: DataFrame, n: int) -> None:
        if count is not None:
            left = count - seen.before(n)
            if left > 0:
                batch = batch.orderBy("file", "frame_no").limit(left).persist()
                handle(batch, n)
                seen.add(n, batch.count())
                batch.unpersist()
            if left <= 0 or seen.before(n + 1) >= count:
                enough.set()
            return
        handle(batch, n)

    def ended(query) -> None:
        enough.wait()
        while query.isActive and query.status["isTriggerActive"]:  # the last batch commits first
            time.sleep(0.05)
        query.stop()

    w = passed.writeStream.foreachBatch(each)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    query = w.start()
    if count is not None:
        if seen.before(1 << 62) >= count:
            enough.set()  # all have passed before a restart
        threading.Thread(target=ended, args=(query,), daemon=True).start()
    return query


def capture_to_file(frames: DataFrame, path: str, checkpoint: str):
    """A stream's frames as capture files in a folder, one per task and batch."""
    captures.register(frames.sparkSession)
    return frames.writeStream.foreachBatch(lambda b, _: b.write.format("capture").mode("append").save(path)).option("checkpointLocation", checkpoint).start()
