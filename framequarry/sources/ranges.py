"""Captures in byte ranges: one large file is read by many tasks.

A block says how long it is, so blocks can only be followed from the start of a file, or from any place where one is known to
begin. Each range therefore looks for such a place by itself: where a chain of blocks fits, each with its length before and after
(or, in classic files, a chain of plausible packet headers). From there it notes what an index needs: how many packets it has, which sections and interfaces
begin in it, and at which byte of a later range its last block ends. That place must be where the next range
begins: going through a file's ranges in order, all are confirmed, from the first one on, whose start is certain. A range that was
led astray, by a packet that holds a capture, is gone through again from the right place, and twice as many after it each time.
So what is found never depends on the guess, and the result is that of reading the file from its start: frame numbers, sections, interfaces, byte order.

The index has a row for each range (some 100 bytes for RANGE_BYTES of file); its rows for one file meet in one task. It can be kept and read again.
Files are opened by pyarrow's file systems (local, HDFS and viewfs, S3, GCS); read_capture() reads any other store that Spark reaches, a file by one task.
An empty, foreign or damaged file gives the packets before the damage, as when it is read whole. A block may be longer than a range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.shared import file_system, stored
from framequarry.sources import formats
from framequarry.sources.formats import CB, CB_NOCOPY, DSB, EPB, IDB, ISB, MAGICS, NRB, PB, SHB, SPB

#: Bytes of a range, and of what is read of a file at once.
RANGE_BYTES, READ_BYTES = 128 << 20, 1 << 20
#: Blocks that must fit in a row where a range guesses its start, unless the file ends before.
CHAIN = 12
#: No block is guessed to be longer, and no packet of a classic file.
LONGEST_BLOCK, LONGEST_PACKET = 1 << 26, 1 << 18
_KINDS = np.array([SHB, IDB, PB, SPB, NRB, ISB, EPB, DSB, CB, CB_NOCOPY], np.uint32)


class Bytes:
    """A file's bytes by place, read in windows; `known` is where the caller is, so reading goes on from there."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size
        self.low, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to n bytes, fewer where the file ends."""
        i = place - self.low
        if i < 0 or i + n > len(self.held):
            want = min(max(n, READ_BYTES), self.size - place)
            if want <= 0:
                return b""
            self.low, self.held, i = place, self.handle.read_at(want, place), 0
        return self.held[i : i + n]


@dataclass
class State:
    """What must be known where a range begins: where that is, the byte order, and what the file has said so far."""

    place: int = 0
    order: str = "<"
    packets: int = 0
    section: int = -1
    interfaces: list[formats.Interface] = field(default_factory=list)


@dataclass
class Summary:
    """Of a walk from `entry` through one range: where it ends (-1: the file does), and what came up on the way."""

    n: int
    entry: int
    order: str
    end: int = -1
    end_order: str = "<"
    packets: int = 0
    sections: int = 0
    interfaces: list[formats.Interface] = field(default_factory=list)  # of the last section begun here, or added to the current one


class NextGeneration:
    """Blocks: 12 bytes at least, a multiple of 4, as long as they say."""

    step = 4

    def __init__(self, src: Bytes):
        self.src = src

    def first(self) -> int:
        return 0

    def block(self, at: int, order: str) -> tuple[int, int, str] | None:
        """Type, size and byte order of the block at a place."""
        head = self.src.at(at, 12)
        if len(head) < 12:
            return None
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(order + "II", head)
        if size < 12 or size % 4 or at + size > self.src.size:
            return None
        return kind, size, order

    def walk(self, n: int, entry: int, order: str, end: int) -> Summary:
        s = Summary(n, entry, order)
        at = entry
        while at < end:
            got = self.block(at, order)
            if got is None:
                s.end_order = order
                return s
            kind, size, order = got
            if kind == SHB:
                s.sections += 1
                s.interfaces = []
            elif kind == IDB and size >= 20:
                s.interfaces.append(formats.interface_of(formats.Block(0, kind, size, self.src.at(at + 8, size - 12), order, 0)))
            elif formats.is_packet(kind, size - 12):
                s.packets += 1
            at += size
        s.end, s.end_order = at, order
        return s

    def guesses(self, at: int, end: int) -> Iterator[tuple[int, str]]:
        """Places, in order, where a block of a known type may begin."""
        at += -at % 4
        while at < end:
            data = self.src.at(at, min(READ_BYTES, end - at) + 8)
            words = np.frombuffer(data[: len(data) & ~3], "<u4")
            if len(words) < 3:
                return
            found = []
            for order in "<>":
                w = words if order == "<" else words.byteswap()
                kind, size = w[:-1], w[1:]
                fits = np.isin(kind, _KINDS) & (size >= 12) & (size % 4 == 0) & (size <= LONGEST_BLOCK)
                found += [(at + 4 * int(i), order) for i in np.flatnonzero(fits)]
            yield from sorted(x for x in found if x[0] < end)
            at += max(4, 4 * (len(words) - 1) - 4)

    def fits(self, at: int, order: str) -> bool:
        """Whether a chain of blocks begins here, each with its length at both ends."""
        for _ in range(CHAIN):
            got = self.block(at, order)
            if got is None:
                return False
            kind, size, order = got
            if size > LONGEST_BLOCK or self.src.at(at + size - 4, 4) != struct.pack(order + "I", size):
                return False
            at += size
            if at == self.src.size:
                return True
        return True

    def packets(self, s: State, end: int, compat: bool) -> Iterator[formats.Packet]:
        at, order, section, number, interfaces = s.place, s.order, s.section, s.packets, list(s.interfaces)
        while at < end:
            got = self.block(at, order)
            if got is None:
                return
            kind, size, order = got
            if kind == SHB:
                section, interfaces = section + 1, []
            elif kind == IDB or formats.is_packet(kind, size - 12):
                b = formats.Block(0, kind, size, self.src.at(at + 8, size - 12), order, section)
                if kind == IDB:
                    if len(b.body) >= 8:
                        interfaces.append(formats.interface_of(b))
                else:
                    number += 1
                    yield formats.packet_of(b, interfaces, number, compat)
            at += size


class Classic:
    """Packets behind a header of 16 bytes; what holds for all is in the file's first 24."""

    step = 1

    def __init__(self, src: Bytes):
        self.src = src
        head = src.at(0, 24)
        self.order, self.nano = MAGICS[head[:4]]
        self.linktype = struct.unpack_from(self.order + "I", head, 20)[0] & 0xFFFF if len(head) == 24 else 0

    def first(self) -> int:
        return 24

    def size_at(self, at: int) -> int | None:
        head = self.src.at(at, 16)
        if len(head) < 16:
            return None
        size = 16 + struct.unpack_from(self.order + "I", head, 8)[0]
        return size if at + size <= self.src.size else None

    def walk(self, n: int, entry: int, order: str, end: int) -> Summary:
        s = Summary(n, entry, order, end_order=order)
        at = entry
        while at < end:
            size = self.size_at(at)
            if size is None:
                return s
            s.packets += 1
            at += size
        s.end = at
        return s

    def guesses(self, at: int, end: int) -> Iterator[tuple[int, str]]:
        at = max(at, 24)
        while at < end:
            data = self.src.at(at, min(READ_BYTES, end - at) + 15)
            n = len(data) - 15
            if n <= 0:
                return
            word = lambda k: np.ndarray((n,), self.order + "u4", data, k, (1,))  # noqa: B023, E731
            sub, cap, orig = word(4), word(8), word(12)
            fits = (sub < (1_000_000_000 if self.nano else 1_000_000)) & (cap <= LONGEST_PACKET) & (orig <= LONGEST_PACKET) & (cap <= orig) & (orig > 0)
            for i in np.flatnonzero(fits).tolist():
                yield at + i, self.order
            at += n

    def fits(self, at: int, order: str) -> bool:
        for _ in range(CHAIN):
            head = self.src.at(at, 16)
            if len(head) < 16:
                return False
            _, sub, cap, orig = struct.unpack(self.order + "IIII", head)
            if sub >= (1_000_000_000 if self.nano else 1_000_000) or cap > min(orig, LONGEST_PACKET) or at + 16 + cap > self.src.size:
                return False
            at += 16 + cap
            if at == self.src.size:
                return True
        return True

    def packets(self, s: State, end: int, compat: bool) -> Iterator[formats.Packet]:
        at, number = s.place, s.packets
        while at < end:
            size = self.size_at(at)
            if size is None:
                return
            sec, sub, _, orig = struct.unpack(self.order + "IIII", self.src.at(at, 16))
            number += 1
            yield formats.Packet(number, 0, 0, self.linktype, sec * 1_000_000_000 + (sub if self.nano else sub * 1000), size - 16, orig, self.src.at(at + 16, size - 16))
            at += size


def format_of(src: Bytes) -> NextGeneration | Classic:
    return Classic(src) if src.at(0, 4) in MAGICS else NextGeneration(src)


def guessed(f: NextGeneration | Classic, n: int, range_bytes: int) -> Summary | None:
    """The summary of range n from where it seems to begin; of the first range from where it does."""
    low, high = n * range_bytes, min((n + 1) * range_bytes, f.src.size)
    if not n:
        return f.walk(0, f.first(), getattr(f, "order", "<"), high)
    for at, order in f.guesses(low, high):
        if f.fits(at, order):
            return f.walk(n, at, order, high)
    return None


def walked(f: NextGeneration | Classic, n: int, entry: int, order: str, ranges: int, range_bytes: int) -> Iterator[Summary]:
    """Summaries of `ranges` ranges from n on, the first of which certainly begins at `entry`."""
    for k in range(n, n + ranges):
        high = min((k + 1) * range_bytes, f.src.size)
        if entry >= f.src.size:
            return
        if entry < high:
            s = f.walk(k, entry, order, high)
            yield s
            if s.end < 0:
                return
            entry, order = s.end, s.end_order


def confirmed(size: int, range_bytes: int, found: dict[int, list[Summary]]) -> tuple[list[tuple[int, State, int, int]], tuple[int, int, str] | None]:
    """Goes through a file's ranges in order: number, state at its start, end, packets of those with packets; and, if the way is lost, the range, place and order to walk from."""
    out: list[tuple[int, State, int, int]] = []
    if not found.get(0):
        return out, None
    first = found[0][0]
    s = State(first.entry, first.order)
    for n in range(max(1, -(-size // range_bytes))):
        if s.place >= min((n + 1) * range_bytes, size):
            continue  # a block goes on through all of it
        match = next((x for x in found.get(n, ()) if x.entry == s.place and x.order == s.order), None)
        if match is None:
            return out, (n, s.place, s.order)
        if match.packets:
            out.append((n, s, min((n + 1) * range_bytes, size), match.packets))
        s = State(match.end, match.end_order, s.packets + match.packets, s.section + match.sections, match.interfaces if match.sections else s.interfaces + match.interfaces)
        if match.end < 0:
            break
    return out, None


# ---- as Spark jobs --------------------------------------------------------------------------------------

_FACE = "array<struct<linktype: int, snaplen: bigint, ticks: bigint, offset: bigint>>"
_FACES = pa.list_(pa.struct([("linktype", pa.int32()), ("snaplen", pa.int64()), ("ticks", pa.int64()), ("offset", pa.int64())]))
_FOUND = pa.schema([("file", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("entry", pa.int64()), ("order", pa.string()), ("end", pa.int64()), ("end_order", pa.string()), ("packets", pa.int64()), ("sections", pa.int32()), ("interfaces", _FACES)])
FOUND = f"file string, size bigint, n bigint, entry bigint, `order` string, end bigint, end_order string, packets bigint, sections int, interfaces {_FACE}"
#: A row for each range with packets: where it begins, its byte order, the packets and sections before it, its interfaces at that point.
INDEX = f"file string, size bigint, n bigint, place bigint, `order` string, before bigint, section int, interfaces {_FACE}, end bigint, packets bigint"
_LOST = pa.schema([("file", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("entry", pa.int64()), ("order", pa.string())])


def _packed(faces: list[formats.Interface]) -> list[dict]:
    return [{"linktype": i.linktype, "snaplen": i.snaplen, "ticks": i.ticks, "offset": i.offset} for i in faces]


def _faces(rows: list[dict] | None) -> list[formats.Interface]:
    return [formats.Interface(r["linktype"], r["snaplen"], r["ticks"], r["offset"]) for r in rows or []]


def _found_batch(file: str, size: int, found: list[Summary]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"file": file, "size": size, "n": s.n, "entry": s.entry, "order": s.order, "end": s.end, "end_order": s.end_order, "packets": s.packets, "sections": s.sections, "interfaces": _packed(s.interfaces)} for s in found], schema=_FOUND)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """A task for each row: the rows are small, what they stand for is not."""
    return rows.repartition(max(1, n))


def index_captures(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """INDEX of the capture files at a path (a file, a folder, a pattern), written as a table in the shared folder."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    ranges = stored(files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / range_bytes))).alias("n")), "ranges")

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, name = file_system(r["file"])
                with fs.open_input_file(name) as handle:
                    got = guessed(format_of(Bytes(handle, r["size"])), r["n"], range_bytes)
                if got is not None:
                    yield _found_batch(r["file"], r["size"], [got])

    found = stored(_dealt(ranges, ranges.count()).mapInArrow(guess, FOUND), "found")

    def confirm(rows: pa.Table, lost: bool) -> pa.Table:
        found: dict[int, list[Summary]] = {}
        for r in rows.to_pylist():
            found.setdefault(r["n"], []).append(Summary(r["n"], r["entry"], r["order"], r["end"], r["end_order"], r["packets"], r["sections"], _faces(r["interfaces"])))
        file, size = rows["file"][0].as_py(), rows["size"][0].as_py()
        good, missing = confirmed(size, range_bytes, found)
        if lost:
            return pa.Table.from_pylist([{"file": file, "size": size, "n": missing[0], "entry": missing[1], "order": missing[2]}] if missing else [], schema=_LOST)
        return pa.Table.from_pylist([{"file": file, "size": size, "n": n, "place": s.place, "order": s.order, "before": s.packets, "section": s.section, "interfaces": _packed(s.interfaces), "end": end, "packets": k} for n, s, end, k in good], schema=_INDEX)

    reach = 1
    while True:
        lost = stored(found.groupBy("file").applyInArrow(lambda t: confirm(t, True), "file string, size bigint, n bigint, entry bigint, `order` string"), "lost")
        n = lost.count()
        if not n:
            break
        reach *= 2

        def again(batches: Iterator[pa.RecordBatch], ranges: int = reach) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    fs, name = file_system(r["file"])
                    with fs.open_input_file(name) as handle:
                        got = list(walked(format_of(Bytes(handle, r["size"])), r["n"], r["entry"], r["order"], ranges, range_bytes))
                    yield _found_batch(r["file"], r["size"], got)

        found = stored(found.union(_dealt(lost, n).mapInArrow(again, FOUND)), "found")
    return stored(found.groupBy("file").applyInArrow(lambda t: confirm(t, False), INDEX), "index")


_INDEX = pa.schema([("file", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("order", pa.string()), ("before", pa.int64()), ("section", pa.int32()), ("interfaces", _FACES), ("end", pa.int64()), ("packets", pa.int64())])


def scan(index: DataFrame, batches_of, schema: str, compat: bool = False) -> DataFrame:
    """The packets of an index's ranges, a task for each; conditions on file and frame numbers can be put on the index first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, name = file_system(r["file"])
                with fs.open_input_file(name) as handle:
                    f = format_of(Bytes(handle, r["size"]))
                    s = State(r["place"], r["order"], r["before"], r["section"], _faces(r["interfaces"]))
                    yield from batches_of(r["file"], f.packets(s, r["end"], compat))

    return _dealt(index, index.count()).mapInArrow(run, schema)


def file_packets(path: str, compat: bool = False) -> Iterator[formats.Packet]:
    """All packets of one file, of which a window is held at a time."""
    fs, name = file_system(path)
    size = fs.get_file_info(name).size
    with fs.open_input_file(name) as handle:
        f = format_of(Bytes(handle, size))
        yield from f.packets(State(f.first(), getattr(f, "order", "<")), size, compat)
