"""Streams in blocks of their bytes: one connection of any size is many tasks' work.

Only numbers of a direction go through one task in their order: a segment's sequence number and size (about 20 bytes), and where messages may
begin. Bytes are dealt by the block of offsets that they are in.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.operators.headers import capture_columns
from framequarry.operators.reassembly import GapIndex, stream_rows
from framequarry.shared import drop, small_batches, stored

#: Bytes of a stream in a block, and of the next one that a block has besides, so that it sees every head which begins in it.
BLOCK, AHEAD = 1 << 20, 7

#: Frame numbers of a direction whose numbers are one row.
CELL = 1 << 14

#: Of a block's bytes (place where a message may begin, place where the next one would), in order.
Jumps = Callable[[bytes], Iterator[tuple[int, int]]]


def plain_file(df: DataFrame) -> DataFrame:
    """A null file as a text, so that joins meet it."""
    return df.withColumns({c: F.coalesce(F.concat(F.lit("/"), c), F.lit("")) for c in capture_columns(df)})


def given_file(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != "", F.substring(c, 2, 1 << 30)) for c in capture_columns(df)})


def _fields(own: list[str]) -> list[tuple[str, pa.DataType, str]]:
    return [*((c, pa.string(), "string") for c in own), ("conv", pa.string(), "string"), ("lo", pa.bool_(), "boolean")]


def mapped(df: DataFrame, run: Callable[[Iterator[list]], Iterator[tuple]], fields: list[tuple[str, pa.DataType, str]], rows: int = 1 << 14, size: int = 1 << 21) -> DataFrame:
    """df's rows, as lists, through run(), which yields tuples of `fields`; they leave in batches of so many rows, or of such a size of what their last fields hold."""
    schema = pa.schema([(n, t) for n, t, _ in fields])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        out, held = [], 0
        for row in run(list(r) for b in given for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            out.append(row)
            held += len(row[-1]) if isinstance(row[-1], bytes | list) else 0
            if len(out) >= rows or held >= size:
                yield made()
                out, held = [], 0
        if out:
            yield made()

    return df.mapInArrow(batches, ", ".join(f"`{n}` {t}" for n, _, t in fields))


def stream_blocks(frames: DataFrame, jumps: Jumps, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, clients) of frames' conversations, file as plain_file() has it; both are stored().

    blocks: file (if frames has it), conv, lo (sent by the conversation's lower end), stream, block, size, ends, nos, heads, nexts, data. data are the block's bytes before
    its first gap, with those of the next block that AHEAD says; size counts them without these; the bytes before ends[i] are there after frame nos[i];
    heads and nexts are what jumps() finds. clients: file, conv, client (whether lo sent the first frame).
    """
    small_batches(frames.sparkSession)
    rows = stream_rows(frames)
    own = capture_columns(rows)
    key, side = [*own, "conv"], [*own, "conv", "lo"]
    lo = F.startswith("conv", F.concat(F.hex("ip_src"), F.lit("/"), F.col("sport").cast("string"), F.lit("/")))
    syn = F.coalesce(F.col("tcp_flags").bitwiseAND(F.lit(2)) != 0, F.lit(False))
    seg = rows.select(*key, lo.alias("lo"), "frame_no", F.col("tcp_seq").cast("bigint").alias("seq"), syn.alias("syn"), F.coalesce(F.length("data"), F.lit(0)).alias("size"), "data")
    seg = stored(plain_file(seg), "segments")  # its numbers are read without the data
    clients = stored(seg.groupBy(*key).agg(F.min_by("lo", "frame_no").alias("client")), "clients")
    placed = seg.where("size > 0").join(_places(seg, own), [*side, "frame_no"]).withColumn("end", F.col("off") + F.col("size")).where("end > 0")
    first, last = F.floor((F.greatest(F.col("off"), F.lit(0)) - AHEAD) / block), F.floor((F.col("end") - 1) / block)
    dealt = placed.select(*side, "stream", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), last)).alias("block"), "frame_no", "off", "data")
    dealt = dealt.repartition(*side, "stream", "block").sortWithinPartitions(*side, "stream", "block", "frame_no")
    n = len(side) + 2

    def run(given: Iterator[list]) -> Iterator[tuple]:
        at, gaps, pieces = None, GapIndex(), []

        def whole() -> Iterator[tuple]:
            start, reach, top, ends, nos, data = at[-1] * block, at[-1] * block, 0, [], [], []
            for off, no, piece in sorted(pieces):
                if off != reach:
                    break
                if reach < start + block:
                    if no > top or not ends:
                        top = max(top, no)
                        ends.append(0)
                        nos.append(top)
                    ends[-1] = min(off + len(piece), start + block)
                reach = off + len(piece)
                data.append(piece)
            if data:
                body = b"".join(data)
                found = list(jumps(body))
                yield (*at, min(len(body), block), ends, nos, [start + p for p, _ in found], [start + p for _, p in found], body)

        for row in given:
            no, off, data = row[n:]
            if row[:n] != at:
                if at:
                    yield from whole()
                at, gaps, pieces = row[:n], GapIndex(), []
            begin = max(off, at[-1] * block)
            pieces += [(low, no, data[low - off : high - off]) for low, high in gaps.fresh(begin, min(off + len(data), (at[-1] + 1) * block + AHEAD))]
        if at:
            yield from whole()

    longs = (pa.list_(pa.int64()), "array<bigint>")
    fields = [*_fields(own), ("stream", pa.int32(), "int"), ("block", pa.int64(), "bigint"), ("size", pa.int32(), "int"), *((c, *longs) for c in ("ends", "nos", "heads", "nexts")), ("data", pa.binary(), "binary")]
    blocks = stored(mapped(dealt, run, fields), "blocks")
    drop(seg)
    return blocks, clients


def _places(seg: DataFrame, own: list[str]) -> DataFrame:
    """file, conv, lo, frame_no, stream, off: where each segment's data begins in its stream, which may be before its first byte."""
    side = [*own, "conv", "lo"]
    n = len(side) + 1
    some = seg.where("size > 0 OR syn").select(*side, F.floor(F.col("frame_no") / CELL).alias("cell"), "frame_no", "seq", "size", "syn")
    some = some.repartition(*side, "cell").sortWithinPartitions(*side, "cell", "frame_no")

    def pack(given: Iterator[list]) -> Iterator[tuple]:
        at, rows = None, []
        for row in given:
            if row[:n] != at or len(rows) == CELL:
                if at:
                    yield (*at, rows[0][0], *map(list, zip(*rows, strict=True)))
                at, rows = row[:n], []
            rows.append(row[n:])
        if at:
            yield (*at, rows[0][0], *map(list, zip(*rows, strict=True)))

    cells = [*_fields(own), ("cell", pa.int64(), "bigint"), ("first", pa.int64(), "bigint"), ("frame_no", pa.list_(pa.int64()), "array<bigint>"), ("seq", pa.list_(pa.int64()), "array<bigint>"), ("size", pa.list_(pa.int32()), "array<int>"), ("syn", pa.list_(pa.bool_()), "array<boolean>")]
    packed = mapped(some, pack, cells, size=1 << 16).repartition(*side).sortWithinPartitions(*side, "cell", "first")

    def run(given: Iterator[list]) -> Iterator[tuple]:
        at, gaps, sent = None, GapIndex(), 0
        for row in given:
            if row[: n - 1] != at:
                at, gaps, sent = row[: n - 1], GapIndex(), 0
            for no, seq, size, syn in zip(*row[n + 1 :], strict=True):
                if seq is None:  # UDP payloads follow each other
                    yield (*at, no, 0, sent)
                    sent += size
                else:
                    off = gaps.place(seq, size, syn)
                    if size:
                        yield (*at, no, gaps.stream, off)

    return mapped(packed, run, [*_fields(own), ("frame_no", pa.int64(), "bigint"), ("stream", pa.int32(), "int"), ("off", pa.int64(), "bigint")])


def entered_blocks(blocks: DataFrame, clients: DataFrame, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """file, conv, lo, stream, block, given, entry, opened, top, to_server: of delivered blocks with messages, in which bytes are delivered up to `given`, where the first message begins
    (beyond the block, if none does), where the one began that reaches into it (null: none), and the last frame needed before it. `cap` is of a direction."""
    own = capture_columns(blocks)
    side = [*own, "conv", "lo"]
    n = len(side)
    rows = blocks.select(*side, "stream", "block", "size", F.element_at("nos", -1).alias("top"), "heads", "nexts").repartition(*side).sortWithinPartitions(*side, "stream", "block")

    def run(given: Iterator[list]) -> Iterator[tuple]:
        at = stream = entry = opened = None
        used = due = top = 0
        for row in given:
            s, b, size, last, heads, nexts = row[n:]
            if row[:n] != at:
                at, stream, used = row[:n], None, 0
            if s != stream:
                stream, due, entry, opened, top = s, 0, 0, None, 0
            if b != due:
                continue  # behind a gap, or nothing is due any more
            end = b * block + size
            if cap is not None:
                size = min(size, cap - used)
                used += size
            if size <= 0:
                due = None
                continue
            if entry is not None:
                yield (*at, s, b, b * block + size, entry, opened, top)
            jump = dict(zip(heads, nexts, strict=True))
            while entry is not None and entry < end:
                entry, opened = jump.get(entry), entry
            top = max(top, last)
            due = b + 1 if end == (b + 1) * block else None

    fields = [*_fields(own), ("stream", pa.int32(), "int"), *((c, pa.int64(), "bigint") for c in ("block", "given", "entry", "opened", "top"))]
    entered = mapped(rows, run, fields)
    return entered.join(clients, [*own, "conv"]).withColumn("to_server", F.col("lo") == F.col("client")).drop("client")


def frame_at(ends: list[int], nos: list[int], top: int, end: int) -> int:
    """The frame after which the bytes before `end`, and all of earlier blocks, are there."""
    return max(top, nos[bisect_left(ends, end)])
