"""What the fourth round's findings named, on small data."""

import itertools
import os
import random
import struct
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle

from framequarry import shared, synth
from framequarry.build import packets as P
from framequarry.operators import analytics, messages, objects, reassembly, tcp_state
from framequarry.plans.queries import ORACLES, QUERIES
from framequarry.sources import captures


@pytest.fixture
def customers(spark):
    return spark.range(40).select(F.col("id").alias("c_custkey"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_broadcasts_nothing_and_keeps_frames_without_a_time(spark, customers):
    frames = synth.exchange_frames(customers)
    assert "Broadcast" not in plan(captures.merged(frames))  # of frames least of all
    given = [("b", 1, 5_000_000_000), ("a", 2, None), ("a", 3, -1), ("a", 1, 5_000_000_000), ("b", 2, 4_999_999_999), ("b", 3, 5_000_999_999), ("b", 4, 3_700_000_000_000)]
    got = captures.merged(spark.createDataFrame(given, "file string, frame_no bigint, ts_ns bigint")).orderBy("frame_no").collect()
    assert [(r.frame_no, r.file_of, r.no_in_file) for r in got] == [(i + 1, f, n) for i, (f, n) in enumerate([("a", 2), ("a", 3), ("b", 2), ("a", 1), ("b", 1), ("b", 3), ("b", 4)])]


@pytest.mark.parametrize(
    ("name", "events"),
    [
        ("checksums", [(305485, 4785, "purchase"), (317158, 4731, "signup"), (4, 7, "view")]),  # 0 would be right for the first two
        ("dissected_fields", [(117423, 2647, "signup"), (119661, 2454, "error"), (123712, 2454, "signup"), (134131, 2365, "view"), (493250, 7056, "click")]),  # from ports that decoders have
        ("filter_alias", [(2, 300, "view"), (4, 70000, "click"), (6, 5, "view")]),  # clients beyond the first 256
    ],
)
def test_events_of_larger_tables_against_sql(spark, tmp_path, monkeypatch, name, events):
    rows = spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string")
    rows.selectExpr("*", "timestamp_ntz '2024-01-01 00:00:11' AS ts").toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    monkeypatch.setattr(oracle, "SF", str(tmp_path))
    assert oracle.compare(spark, QUERIES[name], ORACLES[name]) > 0


def test_flags_are_merged_with_frames_not_broadcast(spark, customers):
    assert "Broadcast" not in plan(tcp_state.tcp_analysis_full(synth.exchange_frames(customers)))


def test_conversations_are_hashed_and_begin_with_their_first_sender(spark, customers):
    got = analytics.conversations(synth.exchange_frames(customers).where("frame_no % 32 <> 1"), analysis=False)  # without the client's SYN: the server sends first
    assert "SortAggregate" not in plan(got)
    rows = got.orderBy("file", "id").collect()
    assert [(r.file, r.id, r.addr_a, r.port_a, r.addr_b, r.port_b, r.packets) for r in rows] == [(f"capture-{f}", n * 32 + 2, "192.168.0.1", 7, f"10.0.0.{n}", 50000, 24) for f in range(2) for n in range(20)]


def test_streams_are_followed_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    pages = spark.range(2).selectExpr("id AS page_id", "'http://a.b/c' AS url", "repeat('x', 9000000) AS html")
    files = objects.http_files(synth.page_frames(pages))
    assert int(spark.conf.get(key)) == shared.BATCH_BYTES
    assert [(r.n, r.complete) for r in files.select("len", "complete").withColumnRenamed("len", "n").collect()] == [(9000000, True)] * 2
    spark.conf.set(key, "65536")
    reassembly.follow_segments(synth.page_frames(pages))
    assert spark.conf.get(key) == "65536"
    spark.conf.unset(key)


def smb(command, mid, response, body, after=0):
    return b"\xfeSMB" + struct.pack("<HHIHHIIQ", 64, 0, 0, command, 1, int(response), after, mid) + b"\0" * 32 + body


def smb_talk(rng, files):
    """(client's, server's) bytes: files read in parts, of which some hold what looks like a frame's head; compounds, other messages, SMB1."""
    framed = lambda m: b"\0" + len(m).to_bytes(3, "big") + m
    up, down = [], []
    for k in range(files):
        fid, data = bytes([k]) * 16, rng.randbytes(rng.choice([1, 40, 300])) + b"\0\0\0\x09\xfeSMB" * rng.randint(0, 4)
        name = f"d\\f{k}.txt".encode("utf-16-le")
        create = smb(5, 10 * k, False, b"\0" * 44 + struct.pack("<HH", 120, len(name)) + b"\0" * 8 + name)
        created = smb(5, 10 * k, True, b"\0" * 48 + struct.pack("<Q", len(data)) + b"\0" * 8 + fid + b"\0" * 8)
        for i, off in enumerate(range(0, len(data), 150)):
            part = data[off : off + 150]
            ask = smb(8, 10 * k + i + 1, False, b"\0" * 8 + struct.pack("<Q", off) + fid + b"\0" * 16)
            answer = smb(8, 10 * k + i + 1, True, b"\x11\0\x50\0" + struct.pack("<I", len(part)) + b"\0" * 8 + part)
            if i == 0 and k % 2:
                up.append(framed(create[:20] + struct.pack("<I", len(create)) + create[24:] + ask))
                down.append(framed(created[:20] + struct.pack("<I", len(created)) + created[24:] + answer))
            elif i == 0:
                up += [framed(create), framed(smb(3, 1, False, b"x" * 9)), framed(ask)]
                down += [framed(created), framed(b"\xffSMB" + b"y" * rng.randint(0, 99)), framed(answer)]
            else:
                up.append(framed(ask))
                down.append(framed(answer))
    return b"".join(up), b"".join(down)


def smb_in_order(frames, cap=None):
    """What smb_messages() gives, by a direction's delivered bytes one after the other."""
    pieces = sorted(reassembly.delivered_pieces(frames, cap).select("conv", "to_server", "stream", "off", "frame_no", "data").collect())
    out = []
    for side, rows in itertools.groupby(pieces, lambda r: tuple(r[:3])):
        buf, at = b"", 0
        for r in rows:
            buf += bytes(r.data)
            while len(buf) >= at + 8 and (end := messages.smb_frame_end(buf, at)) is not None and end <= len(buf):
                out += [(*side, at + 4 + i, r.frame_no, m.command, m.message_id, m.file_id, m.off, m.size, m.name, m.data) for i, m in messages.smb_frame(buf[at + 4 : end])]
                at = end
    return sorted(out, key=str)


def smb_capture(spark, rng, files, ending=b"", lost=False):
    """Two connections, one of which begins anew; segments of 1 to 200 bytes, swapped and sent twice with other bytes."""
    items = []
    for c in range(2):
        for again in range(1 + c):
            seqs = [(1 << 32) - 700 + 5000 * again, 77 + again]
            for up, data in ((True, b""), (False, b""), *zip((True, False), smb_talk(rng, files), strict=True)):
                a, b = (f"10.0.0.{c}", 50000), ("10.0.1.1", 445)
                (src, sport), (dst, dport) = (a, b) if up else (b, a)
                frame = lambda seq, payload, flags=24: P.tcp_frame(src, dst, sport, dport, seq=seq % (1 << 32), ack=1, flags=flags, payload=payload)  # noqa: B023, E731
                base = seqs[not up]
                if not data:
                    items.append(frame(base - 1, b"", 2))
                    continue
                data, at, made = data + ending, 0, []
                while at < len(data):
                    n = rng.randint(1, 200)
                    made.append(frame(base + at, data[at : at + n]))
                    if rng.random() < 0.2:
                        made.append(frame(base + at - 3, b"?" * (n // 2)))
                    at += n
                for i in range(0, len(made) - 1, 5):
                    made[i], made[i + 1] = made[i + 1], made[i]
                items += made[: 3 * len(made) // 4] + made[3 * len(made) // 4 + 1 :] if lost else made
    return spark.createDataFrame([(i + 1, (i + 1) * 1000, 1, f) for i, f in enumerate(items)], "frame_no bigint, ts_ns bigint, linktype int, frame binary")


@pytest.mark.parametrize(("block", "ending", "lost", "cap"), [(64, b"", False, None), (1000, b"\0\0\0\0\xfeSMB", True, None), (100, b"\0\0\x10\0\xfeSMB unfinished", False, None), (64, b"", False, 2100), (1 << 20, b"\0\0", False, None)])
def test_smb_messages_by_blocks_are_those_read_in_order(spark, block, ending, lost, cap):
    frames = smb_capture(spark, random.Random(block), 9, ending, lost)
    want = smb_in_order(frames, cap)
    assert len(want) > 30
    got = objects.smb_messages(frames, cap, block).select("conv", "to_server", "stream", "n", "frame_no", "command", "message_id", "file_id", "off", "size", "name", "data").collect()
    assert sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got), key=str) == [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in want]


def test_one_connection_is_read_by_many_tasks(spark):
    docs = spark.range(1, 61).selectExpr("2 * id AS doc_id", "repeat(concat('text ', id, ' '), 3000) AS text")  # even numbers: of one connection
    key = "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        frames = synth.smb_frames(docs)
        rows = objects.smb_messages(frames).where("data IS NOT NULL")
        assert rows.select(F.input_file_name().alias("f")).distinct().count() > 1  # a task's file each
        got = objects.smb_files(frames)
        assert got.join(docs, F.col("filename") == F.concat(F.lit("doc-"), "doc_id", F.lit(".txt"))).where("complete AND data = cast(text AS binary)").count() == 60 == got.count()
    finally:
        spark.conf.set(key, was)
