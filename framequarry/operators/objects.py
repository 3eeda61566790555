"""Files carried by HTTP and SMB2, out of delivered bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framequarry.operators.blocks import BLOCK, entered_blocks, frame_at, given_file, mapped, plain_file, stream_blocks
from framequarry.operators.headers import capture_columns
from framequarry.operators.messages import Done, HttpCarver, Part, safe_name, smb_frame, smb_frame_end, smb_jumps
from framequarry.operators.reassembly import follow_segments
from framequarry.shared import drop, stored

OBJECTS = "conv string, proto string, frame bigint, hostname string, content_type string, filename string, len bigint, complete boolean, data binary"

#: Files of more bytes are no single value: their rows have no data; smb_parts() has all of it.
LARGEST_VALUE = 1 << 30


@dataclass
class Carved:
    proto: str
    at: int  # offset in the stream where the object ends
    hostname: str
    content_type: str
    filename: str
    data: bytes
    complete: bool


def _smb_messages(stream: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset after it, message) of every SMB2 message in NetBIOS frames, compounds taken apart."""
    at = 0
    while at + 4 <= len(stream):
        size = int.from_bytes(stream[at + 1 : at + 4], "big")
        frame, at = stream[at + 4 : at + 4 + size], at + 4 + size
        while frame[:4] == b"\xfeSMB" and len(frame) >= 64:
            nxt = struct.unpack_from("<I", frame, 20)[0]
            yield at, frame[:nxt] if nxt else frame
            if not nxt:
                break
            frame = frame[nxt:]


def smb_objects(client: bytes, server: bytes) -> list[Carved]:
    """Files that were read: CREATE gives a file's name and size, READ its parts; both by message id."""
    names: dict[int, str] = {}
    reads: dict[int, tuple[bytes, int]] = {}
    for _, m in _smb_messages(client):
        command, mid = struct.unpack_from("<H", m, 12)[0], struct.unpack_from("<Q", m, 24)[0]
        if command == 5 and len(m) >= 64 + 48:
            off, n = struct.unpack_from("<HH", m, 64 + 44)
            names.setdefault(mid, m[off : off + n].decode("utf-16-le", "replace"))
        elif command == 8 and len(m) >= 64 + 32:
            reads.setdefault(mid, (m[64 + 16 : 64 + 32], struct.unpack_from("<Q", m, 64 + 8)[0]))
    files: dict[bytes, list] = {}
    for at, m in _smb_messages(server):
        command, status, mid = struct.unpack_from("<H", m, 12)[0], struct.unpack_from("<I", m, 8)[0], struct.unpack_from("<Q", m, 24)[0]
        if status:
            continue
        if command == 5 and len(m) >= 64 + 80 and mid in names:
            size = struct.unpack_from("<Q", m, 64 + 48)[0]
            files.setdefault(m[64 + 64 : 64 + 80], [names[mid], size, {}, at])
        elif command == 8 and len(m) >= 64 + 16 and mid in reads:
            off, n = m[64 + 2], struct.unpack_from("<I", m, 64 + 4)[0]
            fid, pos = reads[mid]
            f = files.setdefault(fid, [f"file-{fid.hex()[:8]}", 0, {}, at])
            f[2].setdefault(pos, m[off : off + n])
            f[3] = at
    out = []
    for name, size, parts, at in files.values():
        data = bytearray()
        for pos in sorted(parts):
            if pos > len(data):
                data += b"\0" * (pos - len(data))
            data[pos : pos + len(parts[pos])] = parts[pos]
        if data:
            out.append(Carved("SMB", at, "", "application/octet-stream", safe_name(name.replace("\\", "/").rsplit("/", 1)[-1]), bytes(data), bool(size) and len(data) >= size))
    return out


def extract_objects(frames: DataFrame, hold: int | None = None, cap: int | None = None, protocols: tuple[str, ...] = ("HTTP", "SMB")) -> DataFrame:
    """OBJECTS: every file that a conversation carried; frame is the one that brought its last byte. With a column file in frames, the objects have it too."""
    found = [f for p, f in (("HTTP", lambda: http_files(frames, hold, cap)), ("SMB", lambda: smb_files(frames, cap))) if p in protocols]
    out = found[0]()
    for f in found[1:]:
        out = out.unionByName(f())
    return out


def http_files(frames: DataFrame, hold: int | None = None, cap: int | None = None) -> DataFrame:
    """OBJECTS of HTTP responses. Segments arrive conversation by conversation; one body at a time is in memory."""
    seg = follow_segments(frames, hold, cap)  # its rows come conversation by conversation already
    own = capture_columns(seg)
    schema = pa.schema([*((c, pa.string()) for c in own), ("conv", pa.string()), ("proto", pa.string()), ("frame", pa.int64()), ("hostname", pa.string()), ("content_type", pa.string()), ("filename", pa.string()), ("len", pa.int64()), ("complete", pa.bool_()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, carver, body = None, HttpCarver(), []

        def rows(events: Iterator[Part | Done]) -> Iterator[pa.RecordBatch]:
            for e in events:
                if isinstance(e, Part):
                    body.append(e.data)
                else:
                    row = (*conv, "HTTP", e.frame, e.hostname, e.content_type, e.filename, e.size, e.complete, b"".join(body))
                    body.clear()
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            for *k, no, _, up, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != conv:
                    yield from rows(carver.finish())
                    body.clear()
                    conv, carver = k, HttpCarver()
                yield from rows(carver.feed(up, no, data))
        yield from rows(carver.finish())

    return seg.mapInArrow(run, ", ".join([*(f"`{c}` string" for c in own), OBJECTS]))


SMB_MESSAGES = "conv string, to_server boolean, stream int, n bigint, frame_no bigint, command int, status bigint, response boolean, message_id bigint, file_id binary, off bigint, size bigint, name string, data binary"


def smb_messages(frames: DataFrame, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """SMB_MESSAGES (and file, if frames has it): every CREATE and READ, asked or answered; n is a message's offset in its stream."""
    return given_file(_smb_rows(frames, cap, block))


def _smb_rows(frames: DataFrame, cap: int | None, block: int) -> DataFrame:
    """smb_messages(), file as plain_file() has it. Blocks of a stream are read by themselves; a frame that several of them have parts of is put together after that."""
    own = capture_columns(frames)
    n = len(own) + 1
    blocks, clients = stream_blocks(frames, smb_jumps, block)
    key = [*own, "conv", "lo", "stream", "block"]
    entered = stored(entered_blocks(blocks, clients, cap, block), "entered")  # few numbers for each block: joined without a shuffle of the data where its size on disk allows
    rows = blocks.join(entered, key).select(*own, "conv", "to_server", "stream", "block", "given", "entry", "opened", "top", "ends", "nos", "data")
    place = [*((c, pa.string(), "string") for c in own), ("conv", pa.string(), "string"), ("to_server", pa.bool_(), "boolean"), ("stream", pa.int32(), "int")]
    fields = [*place, ("n", pa.int64(), "bigint"), ("frame_no", pa.int64(), "bigint"), ("command", pa.int32(), "int"), ("status", pa.int64(), "bigint"), ("response", pa.bool_(), "boolean"), ("message_id", pa.int64(), "bigint"), ("file_id", pa.binary(), "binary"), ("off", pa.int64(), "bigint"), ("size", pa.int64(), "bigint"), ("name", pa.string(), "string"), ("data", pa.binary(), "binary")]
    parts = [*fields[:-1], ("whole", pa.int64(), "bigint"), ("part", pa.int64(), "bigint"), fields[-1]]  # of frames in several blocks: n and whole say where they begin and end

    def messages(side: list, at: int, no: int, frame: bytes) -> Iterator[tuple]:
        for i, m in smb_frame(frame):
            yield (*side, at + 4 + i, no, m.command, m.status, m.response, m.message_id, m.file_id, m.off, m.size, m.name), m.data

    def read(given: Iterator[list]) -> Iterator[tuple]:
        nothing = (None,) * 8
        for row in given:
            side, (b, stop, at, opened, top, ends, nos, data) = row[: n + 2], row[n + 2 :]
            start = b * block
            if opened is not None and at > start:
                end = min(at, stop)
                yield (*side, opened, frame_at(ends, nos, top, end), *nothing, at, b, data[: end - start])
            while at < stop:
                end = smb_frame_end(data, at - start)
                if end is None:
                    break
                end += start
                if end <= stop:
                    for m, body in messages(side, at, frame_at(ends, nos, top, end), data[at + 4 - start : end - start]):
                        yield (*m, None, None, body)
                elif stop == start + block:
                    yield (*side, at, frame_at(ends, nos, top, stop), *nothing, end, b, data[at - start : stop - start])
                at = end

    def join(given: Iterator[list]) -> Iterator[tuple]:
        for *side, at, no, frame in given:
            for m, body in messages(side, at, no, frame[4:]):
                yield (*m, body)

    got = stored(mapped(rows, read, parts), "smb")
    drop(blocks, clients, entered)
    names = [c for c, *_ in place]
    cut = got.where("part IS NOT NULL").groupBy(*names, "n", "whole").agg(F.max("frame_no").alias("frame_no"), F.expr("listagg(data) WITHIN GROUP (ORDER BY part)").alias("data"))
    cut = cut.where(F.length("data") == F.col("whole") - F.col("n")).select(*names, "n", "frame_no", "data")
    return got.where("part IS NULL").drop("whole", "part").unionByName(stored(mapped(cut, join, fields), "smb"))


def _sent() -> Column:
    """The order of a direction's messages."""
    return F.struct("stream", "n")


def _smb_reads(m: DataFrame, key: list[str], by_file: bool = False) -> DataFrame:
    """key, file_id, off, n, frame_no, data: every answered READ, the first of each place of a file. With by_file a file's rows are in one partition."""
    ask, answer = ~F.col("response"), F.col("response") & (F.col("status") == 0)
    asked = m.where((F.col("command") == 8) & ask).groupBy(*key, "message_id").agg(F.min_by(F.struct("file_id", "off"), _sent()).alias("q")).select(*key, "message_id", "q.file_id", "q.off")
    answered = m.where((F.col("command") == 8) & answer & (F.length("data") > 0)).select(*key, "message_id", "stream", "n", "frame_no", "data")
    parts = answered.join(asked, [*key, "message_id"])
    places = (parts.repartition(*key, "file_id") if by_file else parts).groupBy(*key, "file_id", "off").agg(F.min_by(F.struct("n", "frame_no", "data"), _sent()).alias("r"))
    return places.select(*key, "file_id", "off", "r.n", "r.frame_no", "r.data")


def _smb_keys(frames: DataFrame) -> list[str]:
    return [*capture_columns(frames), "conv"]


def smb_parts(frames: DataFrame, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """file (if frames has it), conv, file_id, off, n, frame_no, data: the parts of files that were read, whatever their size."""
    return _smb_reads(_smb_rows(frames, cap, block), _smb_keys(frames)).transform(given_file)


def smb_files(frames: DataFrame, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """OBJECTS of SMB2 files that were read: CREATE gives a file's name, size and id, READ its parts, each question joined to its answer by message id.

    Streams are read in blocks and messages are rows, so a connection of any size is many tasks' work. Parts are put together in the order of their places,
    what two of them have in common from the earlier one, holes as zeros; a file that nothing named is called by its id.
    """
    key = _smb_keys(frames)
    m = _smb_rows(frames, cap, block)  # read for questions and answers of both kinds
    named = m.where((F.col("command") == 5) & ~F.col("response")).groupBy(*key, "message_id").agg(F.min_by("name", _sent()).alias("name"))
    made = m.where((F.col("command") == 5) & F.col("response") & (F.col("status") == 0)).select(*key, "message_id", "stream", "n", "file_id", "size")
    files = made.join(named, [*key, "message_id"]).groupBy(*key, "file_id").agg(F.min_by(F.struct("name", "size"), _sent()).alias("f")).select(*key, "file_id", "f.name", F.col("f.size").alias("eof"))
    end = F.col("off") + F.length("data")
    order = Window.partitionBy(*key, "file_id").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    parts = _smb_reads(m, key, by_file=True).withColumn("have", F.coalesce(F.max(end).over(order), F.lit(0).cast("bigint")))
    hole = F.expr(f"cast(repeat(chr(0), cast(greatest(0, least(off - have, {LARGEST_VALUE})) as int)) as binary)")
    rest = F.when(end > F.col("have"), F.substring("data", F.greatest(F.lit(1), F.col("have") - F.col("off") + 1).cast("int"), F.length("data"))).otherwise(F.lit(b""))
    fits = F.max(end).over(Window.partitionBy(*key, "file_id")) <= LARGEST_VALUE
    parts = parts.withColumn("piece", F.when(fits, F.concat(hole, rest)))
    whole = parts.groupBy(*key, "file_id").agg(F.max(end).alias("len"), F.max("frame_no").alias("frame"), F.expr("listagg(piece) WITHIN GROUP (ORDER BY off)").alias("data"))
    got = whole.join(files, [*key, "file_id"], "left")
    name = F.regexp_replace(F.regexp_extract(F.coalesce("name", F.concat(F.lit("file-"), F.lower(F.substring(F.hex("file_id"), 1, 8)))), r"([^\\\\/]*)$", 1), "[^A-Za-z0-9._-]", "_")
    nothing = F.lit("")
    out = got.select(*key, F.lit("SMB").alias("proto"), "frame", nothing.alias("hostname"), F.lit("application/octet-stream").alias("content_type"), F.substring(name, 1, 128).alias("filename"), "len", F.coalesce((F.col("eof") > 0) & (F.col("len") >= F.col("eof")), F.lit(False)).alias("complete"), "data")
    return given_file(out)


def smb_requests_answered(fields: DataFrame) -> DataFrame:
    """SMB2 requests and responses of dissected rows, joined on conversation and message id: conv, message_id, command, request_frame, response_frame."""
    mid = lambda d: F.get(F.filter(f"{d}.fields", lambda x: x["abbrev"] == "smb2.message_id"), F.lit(0))["u"]
    one = lambda n: F.get(F.filter("d.fields", lambda x: x["abbrev"] == n), F.lit(0))["u"]
    rows = fields.select("conv", "frame_no", mid("d").alias("message_id"), one("smb2.command").alias("command"), one("smb2.response").alias("response")).where(F.col("message_id").isNotNull())
    q = rows.where("response = 0").select("conv", "message_id", "command", F.col("frame_no").alias("request_frame"))
    a = rows.where("response = 1").select("conv", "message_id", F.col("frame_no").alias("response_frame"))
    return q.join(a, ["conv", "message_id"]).groupBy("conv", "message_id", "command").agg(F.min("request_frame").alias("request_frame"), F.min("response_frame").alias("response_frame"))
