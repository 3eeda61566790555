"""Large captures in ranges, ordered export, long flows in blocks, gap indexes: against the plain way on small data."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from framequarry import synth
from framequarry.build import packets as P
from framequarry.operators import analytics, reassembly
from framequarry.operators.headers import with_headers
from framequarry.sources import captures, formats, ranges


def next_generation(rng, blocks=300):
    """Sections, interfaces that come up late, other blocks, and packets that hold a capture themselves."""
    inner = formats.section_header() + formats.interface_description(1) + b"".join(formats.enhanced_packet(bytes(40), i) for i in range(60))
    out = [formats.section_header(), formats.interface_description(1), formats.interface_description(101, 0xFFFF, [formats.NANOSECONDS])]
    for _ in range(blocks):
        k = rng.random()
        if k < 0.02:
            out.append(formats.interface_description(rng.choice([1, 101, 228]), 100, [formats.NANOSECONDS] if rng.random() < 0.5 else None))
        elif k < 0.03:
            out += [formats.section_header(), formats.interface_description(113)]
        elif k < 0.06:
            out.append(formats.custom_block(77, rng.randbytes(rng.randint(0, 50))))
        elif k < 0.08:
            out.append(formats.name_resolution([(b"\1\2\3\4", ["a"])]))
        elif k < 0.1:
            out.append(formats.simple_packet(rng.randbytes(30)))
        elif k < 0.14:
            out.append(formats.enhanced_packet(b"\0" * rng.choice([0, 2]) + inner, 5))
        else:
            out.append(formats.enhanced_packet(rng.randbytes(rng.randint(0, 300)), rng.getrandbits(50), None, rng.randint(0, 3), [(1, b"said")] if rng.random() < 0.1 else []))
    return b"".join(out)


def big_endian(rng, n=80):
    out = struct.pack(">IIIHHqI", formats.SHB, 28, formats.BYTE_ORDER, 1, 0, -1, 28) + struct.pack(">IIHHII", 1, 20, 1, 0, 65535, 20)
    for i in range(n):
        frame = rng.randbytes(rng.randint(1, 200))
        body = struct.pack(">IIIII", 0, 0, i, len(frame), len(frame)) + frame + b"\0" * (-len(frame) % 4)
        out += struct.pack(">II", 6, 12 + len(body)) + body + struct.pack(">I", 12 + len(body))
    return out


def classic(rng, n=300, order="<", nano=False):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nano]
    out = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 113)
    inner = b"".join(struct.pack(order + "IIII", 1, 2, 20, 20) + bytes(20) for _ in range(30))
    for i in range(n):
        frame = rng.randbytes(rng.randint(0, 200)) if rng.random() < 0.9 else inner
        out += struct.pack(order + "IIII", 1000 + i, rng.randint(0, 999_999), len(frame), len(frame)) + frame
    return out


class Handle:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def by_ranges(data, range_bytes):
    """The packets by ranges, and how often a range was gone through again."""
    f = ranges.format_of(ranges.Bytes(Handle(data), len(data)))
    found, again, reach = {}, 0, 1
    for n in range(max(1, -(-len(data) // range_bytes))):
        got = ranges.guessed(f, n, range_bytes)
        if got:
            found.setdefault(n, []).append(got)
    while True:
        good, lost = ranges.confirmed(len(data), range_bytes, found)
        if lost is None:
            break
        reach, again = reach * 2, again + 1
        for s in ranges.walked(f, *lost, reach, range_bytes):
            found.setdefault(s.n, []).append(s)
    out = []
    for _, s, end, n in good:
        got = list(f.packets(s, end, False))
        assert len(got) == n
        out += got
    return out, again


def test_ranges_of_any_size_give_the_same_packets(monkeypatch):
    rng = random.Random(1)
    one, other = next_generation(rng), classic(rng)
    files = {"one": one, "orders": one + big_endian(rng) + one, "cut": one[:-7], "damaged": one[:20000] + b"\xff" * 16 + one[20016:], "classic": other, "cut classic": other[:3001], "big": classic(rng, 50, ">", True), "foreign": rng.randbytes(5000), "tiny": b"abc", "head": other[:24], "empty": b""}
    misled = 0
    for name, data in files.items():
        want = list(formats.packets(data))
        for size in (61, 100, 997, 4096, 12345, 1 << 20):
            monkeypatch.setattr(ranges, "READ_BYTES", rng.choice([64, 1000, 1 << 20]))
            got, again = by_ranges(data, size)
            misled += again
            assert got == want, (name, size)
    assert misled > 0  # captures inside packets did mislead some ranges


def test_captures_in_ranges_by_tasks(spark, tmp_path):
    rng = random.Random(2)
    one = next_generation(rng, 120)
    (tmp_path / "a.pcapng").write_bytes(one + big_endian(rng, 30))
    (tmp_path / "b.pcap").write_bytes(classic(rng, 60))
    (tmp_path / "c.pcapng").write_bytes(b"")
    columns = ["file", "frame_no", "section", "interface_id", "linktype", "ts_ns", "caplen", "origlen", "frame", "comment", "custom", "pen"]
    rows = lambda df: sorted(tuple(r) for r in df.withColumn("comment", F.coalesce("comment", F.lit(""))).withColumn("pen", F.coalesce("pen", F.lit(-1))).select(columns).collect())
    want = rows(captures.read_capture(spark, str(tmp_path)))
    assert len(want) > 150
    assert rows(captures.read_capture(spark, str(tmp_path), range_bytes=3001)) == want
    index = ranges.index_captures(spark, str(tmp_path), 5000)
    assert index.agg(F.sum("packets")).first()[0] == len(want) and index.count() > 5
    some = index.where("n = 2")  # conditions on the index leave ranges out
    assert 0 < captures.scan_captures(some).count() == some.agg(F.sum("packets")).first()[0]
    captures.register(spark)
    named = lambda rs: [r[1:] for r in rs]
    assert sorted(named(rows(spark.read.format("capture").load(str(tmp_path))))) == sorted(named(want))
    assert spark.read.format("capture").load(f"{tmp_path}/*.pcap").count() == 60
    frames = captures.read_capture(spark, f"{tmp_path}/b.pcap")
    frames.write.format("capture").mode("append").save(f"file://{tmp_path}/out")
    assert spark.read.format("capture").load(f"file://{tmp_path}/out").count() == 60
    frames.limit(5).write.format("capture").mode("overwrite").save(f"{tmp_path}/out")
    assert spark.read.format("capture").load(f"{tmp_path}/out").count() == 5 and not [x for x in os.listdir(tmp_path / "out") if x.endswith(".tmp")]


def test_export_in_order(spark, tmp_path):
    frames = spark.createDataFrame([("x", i, 1000 * i, 1 + 100 * (i % 2), bytes([i])) for i in range(1, 40)] + [("y", i, 5, 1, b"y%d" % i) for i in range(1, 4)], "file string, frame_no bigint, ts_ns bigint, linktype int, frame binary")
    picks = spark.createDataFrame([("x", 9, 1), ("y", 2, 2), ("x", 3, 5), ("x", 9, 7), ("x", 99, 8), ("x", 38, 30), ("x", 1, 31)], "file string, frame_no bigint, ordinal int")
    manifest = captures.export_captures(frames, picks, f"{tmp_path}/out", parts=3)
    assert manifest.count() == 3 and manifest.agg(F.sum("n_frames")).first()[0] == 6
    got = [(r.frame_no, bytes(r.frame), r.linktype) for r in captures.read_export(manifest).orderBy("frame_no").collect()]
    assert got == [(1, b"\x09", 101), (2, b"y2", 1), (3, b"\x03", 101), (4, b"\x09", 101), (5, b"\x26", 1), (6, b"\x01", 101)]
    none = captures.export_captures(frames, picks.where("false"), f"{tmp_path}/none")
    assert none.count() == 0 and captures.read_export(none).count() == 0


def frames_of(spark, items, file=None):
    rows = [(i + 1, (i + 1) * 1000, 1, f, *([file] if file else [])) for i, f in enumerate(items)]
    return spark.createDataFrame(rows, "frame_no bigint, ts_ns bigint, linktype int, frame binary" + (", file string" if file else ""))


def flagged(df):
    return sorted(tuple(r) for r in df.select("frame_no", "retransmission", "out_of_order", "dup_ack").collect())


def brute_flags(rows):
    """(direction, seq, ack, size, flags) in order, each with its flags, by the direction's highest end and last ACK."""
    state, out = {}, []
    for i, (side, seq, ack, size, flags) in enumerate(rows):
        top, last = state.get(side, (None, None))
        again = size > 0 and top is not None and (seq + size <= top or seq < top)
        late = size > 0 and top is not None and seq > top
        bare = bool(flags & 16) and size == 0 and not flags & 3
        out.append((i + 1, again, late, bare and last == ack))
        end = seq + size + (1 if flags & 3 else 0)
        state[side] = (end if top is None else max(top, end), ack if flags & 16 else last)
    return out


def test_flows_beyond_two_gigabytes_in_blocks_of_any_size(spark):
    rng = random.Random(4)
    rows, at = [], {0: 4_000_000_000, 1: 77}
    for _ in range(160):
        side, k = rng.randint(0, 1), rng.random()
        at[side] += rng.choice([0, 10, 900_000_000, 5])
        seq = at[side] - rng.choice([0, 0, 0, 10, 7, 60])
        size = 0 if k < 0.3 else rng.randint(1, 20)
        rows.append((side, seq, rng.randint(1, 3), size, rng.choice([16, 16, 24, 17, 2])))
        at[side] = max(at[side], seq + size)
    assert at[0] - 4_000_000_000 > 5 << 30
    ends = [("10.0.0.1", "10.0.0.2", 1, 2), ("10.0.0.2", "10.0.0.1", 2, 1)]
    items = [P.tcp_frame(*ends[side], seq=seq % (1 << 32), ack=ack, flags=flags, payload=b"x" * size) for side, seq, ack, size, flags in rows]
    items.insert(50, P.udp_frame(*ends[0], payload=b"no part of it"))
    want = brute_flags(rows)
    want = sorted([(n + (n > 50), *f) for n, *f in want] + [(51, False, False, False)])
    for block in (1 << 22, 1, 7, 50):
        assert flagged(analytics.tcp_analysis(frames_of(spark, items), block=block)) == want, block
    two = frames_of(spark, items, "a").union(frames_of(spark, items, "b"))
    got = analytics.tcp_analysis(two, block=16)
    assert flagged(got.where("file = 'a'")) == want == flagged(got.where("file = 'b'"))
    assert set(got.columns) == {*with_headers(two).columns, "retransmission", "out_of_order", "dup_ack"}


def test_tags_of_any_depth(spark):
    inner = P.udp_frame("1.1.1.1", "2.2.2.2", 5, 6, b"deep")
    tags = lambda n: inner[:12] + b"".join((b"\x81\x00" if i % 2 else b"\x88\xa8") + struct.pack(">H", i % 4096) for i in range(n)) + inner[12:]
    depths = [0, 1, 3, 4, 5, 12, 16000]
    items = [tags(n) for n in depths] + [tags(9)[:20], tags(2)[:15], inner[:12] + b"\x81\x00" * 9]
    got = with_headers(frames_of(spark, items)).orderBy("frame_no").collect()
    for n, r in zip(depths, got, strict=False):
        assert (len(r.vlan_stack), r.ip_v, r.dport, r.vlan_id, r.l3_off) == (n, 4, 6, 0 if n else None, 14 + 4 * n)
    assert [r.ip_v for r in got[len(depths) :]] == [None] * 3


def test_first_writer_wins_by_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        g, isn, own = reassembly.GapIndex(), rng.getrandbits(32), {}
        g.add(isn, 0, True)
        for no in range(rng.randint(1, 30)):
            low, size = rng.randint(-5, 60), rng.randint(1, 15)
            first, fresh = g.add((isn + 1 + low) % (1 << 32), size, False)
            new = [x for x in range(max(0, low), low + size) if x not in own]
            own.update(dict.fromkeys(new, no))
            assert first == low and [x for a, b in fresh for x in range(a, b)] == new
        assert all(e < s for e, s in zip(g.ends, g.starts[1:], strict=False)) and sum(g.ends) - sum(g.starts) == len(own)


def test_a_lost_segment_costs_nothing():
    g, h = reassembly.GapIndex(), reassembly.HalfStream()
    g.add(0, 0, True)
    h.add(0, b"", True)
    for i in range(1, 40_000):  # seconds, if every segment looked through those that wait
        g.add(1 + 10 * i, 10, False)
        h.add(1 + 10 * i, b"x" * 10, False)
    assert len(g.starts) == 1 and len(h.add(1, b"y" * 10, False)) == 400_000


def brute_delivery(segments):
    """(frame, bytes) as they become deliverable: every byte is the first frame's that has it."""
    own, base, reach, out = {}, None, 0, []
    for no, seq, data, syn in segments:
        if syn:
            base = seq + 1
            seq += 1
        elif base is None and data:
            base = seq
        for i, b in enumerate(data):
            if seq + i >= (base or 0):
                own.setdefault(seq + i - base, b)
        got = bytearray()
        while reach in own:
            got.append(own[reach])
            reach += 1
        if got:
            out.append((no, bytes(got)))
    return out


@pytest.mark.parametrize("with_syn", [True, False])
def test_delivery_is_by_the_frame_that_closes_the_gap(spark, with_syn):
    rng = random.Random(6)
    start = (1 << 32) - 40
    segments = [(1, start - 1, b"", True)] if with_syn else [(1, start, b"abc", False)]
    for no in range(2, 40):
        at = 0 if no == 20 else rng.randint(0, 120)
        segments.append((no, start + at, rng.randbytes(rng.randint(1, 12)), False))
    segments = [(no, seq, b"" if 60 <= seq - start < 62 else d, s) for no, seq, d, s in segments]
    items = [P.tcp_frame("10.0.0.1", "10.0.0.2", 7, 8, seq=seq % (1 << 32), ack=1, flags=2 if syn else 24, payload=data) for _, seq, data, syn in segments]
    df = frames_of(spark, items)
    got = {}
    for r in reassembly.follow_segments(df).collect():
        got[r.frame_no] = got.get(r.frame_no, b"") + bytes(r.data)
        assert r.ts_ns == 1000 * r.frame_no and r.to_server
    want = brute_delivery(segments)
    assert sorted(got.items()) == want
    whole = b"".join(d for _, d in want)
    assert bytes(reassembly.follow_stream(df).first().client) == whole
    assert bytes(reassembly.follow_stream(df, cap=20).first().client) == whole[:20]
    seen = {x - start for no, seq, d, s in segments for x in range(seq, seq + len(d))} if with_syn else None
    if with_syn:
        gaps = {x for r in reassembly.missing_bytes(df).collect() for x in range(r.low, r.high)}
        assert gaps == set(range(max(seen) + 1)) - seen


def test_a_new_connection_on_the_same_ports_is_another_stream(spark):
    t = lambda seq, data, flags=24: P.tcp_frame("10.0.0.1", "10.0.0.2", 7, 8, seq=seq, ack=1, flags=flags, payload=data)
    items = [t(99, b"", 2), t(100, b"one"), t(99, b"", 2), t(100, b"one"), t(103, b"!"), t(4999, b"", 2), t(5003, b"more"), t(5000, b"two")]
    assert [(r.frame_no, bytes(r.data)) for r in reassembly.follow_segments(frames_of(spark, items)).collect()] == [(2, b"one"), (5, b"!"), (8, b"two"), (8, b"more")]
    r = reassembly.follow_stream(frames_of(spark, items)).first()
    assert bytes(r.client) == b"one!twomore"


def test_synthesised_flows_are_long(spark):
    events = spark.range(3000).withColumnRenamed("id", "event_id")
    got = with_headers(synth.long_flow_frames(events))
    assert got.where("sport = 40000").agg(F.count("*")).first()[0] == 1000 and 24000044 * 250 > 5 << 30
