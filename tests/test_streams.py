"""Connections and growing captures in streams: against the same work in one batch, across restarts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from framequarry import synth
from framequarry.build import packets as P
from framequarry.operators import objects, reassembly
from framequarry.sources import formats, tail
from framequarry.streaming import connections, flows


@pytest.fixture(scope="module")
def maps(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    connections.use_maps(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, frames, tmp_path, parts, make):
    """Rows that make() gives of frames that come in three batches."""
    df = frames.withColumn("part", parts)
    for i in range(3):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        for f in os.listdir(f"{tmp_path}/in{i}"):
            if f.endswith(".parquet"):
                to = f"{tmp_path}/in/{i}.parquet"
                os.replace(f"{tmp_path}/in{i}/{f}", to)
                os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    total, until = df.count(), time.time() + 90  # timers by the clock keep a query at work, so it never says that it is done
    while q.isActive and sum(p.numInputRows for p in q.recentProgress) < total and time.time() < until:
        time.sleep(0.3)
    assert q.exception() is None
    q.stop()
    return spark.read.parquet(f"{tmp_path}/out")


def test_http_bodies_in_a_stream_are_those_of_a_batch(spark, tmp_path, maps):
    pages = spark.createDataFrame([(i, f"http://h{i}.example/dir/p{i}.html?x", "<p>" + "text of a page " * (40 * i) + "</p>") for i in range(12)], "page_id bigint, url string, html string")
    frames = synth.page_frames(pages, mss=400).cache()
    n = (F.col("frame_no") - 1) % (1 << 20)
    parts = F.when(n < 2, 0).when(n < 6, 1).otherwise(2)
    got = connections.joined_parts(streamed(spark, frames, tmp_path, parts, connections.http_parts))
    columns = ["conv", "frame", "hostname", "content_type", "filename", "len", "complete", "data"]
    rows = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    want = rows(objects.http_files(frames))
    assert len(want) == 12 and rows(got) == want


def test_delivered_bytes_in_a_stream_are_those_of_a_batch(spark, tmp_path, maps):
    docs = spark.createDataFrame([(i, f"{i} some text, " * 120) for i in range(6)], "doc_id bigint, text string")
    frames = synth.text_frames(docs, mss=100).cache()
    parts = F.when((F.col("frame_no") - 1) % (1 << 20) < 13, 0).when((F.col("frame_no") - 1) % (1 << 20) < 30, 1).otherwise(2)
    got = streamed(spark, frames, tmp_path, parts, connections.follow_stream_updates)
    sides = got.groupBy("conv").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY off)").alias("client"))
    want = {r.conv: bytes(r.client) for r in reassembly.follow_stream(frames).collect()}
    assert {r.conv: bytes(r.client) for r in sides.collect()} == want and len(want) == 6
    # a piece comes with the frame that a batch says
    frame_of = {(r.conv, r.frame_no) for r in reassembly.follow_segments(frames).collect()}
    assert {(r.conv, r.frame_no) for r in got.collect()} == frame_of


def test_what_waits_is_bounded(spark, tmp_path, maps):
    t = lambda seq, data: P.tcp_frame("10.0.0.1", "10.0.0.2", 7, 8, seq=seq, ack=1, flags=24, payload=data)
    items = [t(1, b"a"), t(5, b"e"), t(3, b"c"), t(4, b"d"), t(2, b"b")]  # two may wait: 5 goes for 4
    frames = spark.createDataFrame([(i + 1, 1000 * i, 1, f) for i, f in enumerate(items)], "frame_no bigint, ts_ns bigint, linktype int, frame binary")
    got = streamed(spark, frames, tmp_path, F.least(F.lit(2), F.col("frame_no").cast("int") - 1), lambda s: connections.follow_stream_updates(s, hold=2))
    assert [(r.frame_no, r.off, bytes(r.data)) for r in got.orderBy("off").collect()] == [(1, 0, b"a"), (5, 1, b"b"), (5, 2, b"c"), (5, 3, b"d")]


def test_a_growing_capture_gives_each_frame_once_across_a_restart(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "live", f"{tmp_path}/checkpoint", f"{tmp_path}/out"
    folder.mkdir()
    tail.register(spark)
    blocks = [formats.section_header() + formats.interface_description(1), *(formats.enhanced_packet(b"frame %d" % i, i + 1) for i in range(9)), formats.interface_description(101, 0xFFFF, [formats.NANOSECONDS]), *(formats.enhanced_packet(b"other %d" % i, i + 1, interface_id=1) for i in range(9))]
    data = b"".join(blocks)
    classic = b"\xd4\xc3\xb2\xa1" + b"\x02\0\x04\0" + b"\0" * 8 + b"\xff\xff\0\0" + b"\x71\0\0\0"
    packet = (1).to_bytes(4, "little") * 2 + (5).to_bytes(4, "little") * 2 + b"cooks"

    def once() -> None:
        frames = spark.readStream.format("capture_tail").option("range_bytes", 100).option("pattern", "*.pcap*").load(str(folder))
        q = frames.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()

    (folder / "notes.txt").write_bytes(b"no capture")
    (folder / "a.pcapng").write_bytes(data[:150])  # within a block
    once()
    first = spark.read.parquet(out).count()
    assert 0 < first < 9
    (folder / "a.pcapng").write_bytes(data[:201])
    (folder / "b.pcap").write_bytes(classic + packet + packet[:7])
    once()
    (folder / "a.pcapng").write_bytes(data)
    (folder / "b.pcap").write_bytes(classic + packet * 3)
    once()
    once()  # nothing new
    got = spark.read.parquet(out).collect()
    a = sorted((r.frame_no, bytes(r.frame), r.linktype, r.ts_ns) for r in got if r.file.endswith("a.pcapng"))
    assert a == [(p.frame_no, p.frame, p.linktype, p.ts_ns) for p in formats.packets(data)] and len(a) == 18
    assert sorted((r.frame_no, bytes(r.frame), r.linktype) for r in got if r.file.endswith("b.pcap")) == [(i, b"cooks", 113) for i in (1, 2, 3)]


def test_a_loop_counts_across_a_restart(spark, tmp_path):
    folder, checkpoint, got = tmp_path / "live", f"{tmp_path}/checkpoint", []
    folder.mkdir()
    head = formats.section_header() + formats.interface_description(1)
    packets = [formats.enhanced_packet(P.udp_frame("1.1.1.1", "2.2.2.2", 1, 2, b"%d" % i), i + 1) for i in range(10)]
    run = lambda: flows.capture_loop(spark, str(folder), lambda b, _: got.extend(r.frame_no for r in b.collect()), "udp", count=7, checkpoint=checkpoint, growing=True)
    (folder / "a.pcapng").write_bytes(head + b"".join(packets[:4]))
    q = run()
    q.processAllAvailable()
    q.stop()
    assert got == [1, 2, 3, 4]
    (folder / "a.pcapng").write_bytes(head + b"".join(packets))
    q = run()
    q.awaitTermination(60)
    assert not q.isActive and got == [1, 2, 3, 4, 5, 6, 7]
    q = run()  # all have passed: it ends by itself
    q.awaitTermination(60)
    time.sleep(0.1)
    assert not q.isActive and got == [1, 2, 3, 4, 5, 6, 7]
