"""Captures that are still written to, as a stream: every complete block once, as soon as it is there.

The offset that Spark checkpoints holds for each file where it has been read to, the byte order and interfaces in effect there, and the frames
so far; so a query goes on after a restart where it ended, and a block that is only half written waits for the next batch. Files are
found by name in a folder and read through pyarrow's file systems, `range_bytes` of new blocks by a task; a file that has gone leaves the offset.
The driver follows the lengths of the new blocks, tasks read their packets: for what grows, not for an archive, which read_capture() indexes by tasks.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from framequarry.shared import file_system
from framequarry.sources import formats, ranges

#: New bytes of a file that one task reads, if the option does not say so.
RANGE_BYTES = 64 << 20


def _state(d: dict) -> ranges.State:
    return ranges.State(d["place"], d["order"], d["packets"], d["section"], [formats.Interface(*i) for i in d["interfaces"]])


def _plain(s: ranges.State) -> dict:
    return {"place": s.place, "order": s.order, "packets": s.packets, "section": s.section, "interfaces": [[i.linktype, i.snaplen, i.ticks, i.offset] for i in s.interfaces]}


def advanced(f: ranges.NextGeneration | ranges.Classic, s: ranges.State, end: int) -> ranges.State:
    """The state after the complete blocks that begin before `end`."""
    at, order, out = s.place, s.order, ranges.State(s.place, s.order, s.packets, s.section, list(s.interfaces))
    while at < end:
        got = f.walk(0, at, order, at + 1)  # one block
        if got.end < 0:
            break
        at, order = got.end, got.end_order
        out = ranges.State(at, order, out.packets + got.packets, out.section + got.sections, got.interfaces if got.sections else out.interfaces + got.interfaces)
    return out


class _Range(InputPartition):
    def __init__(self, file: str, state: dict, end: int):
        super().__init__(file)
        self.file, self.state, self.end = file, state, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.pattern = options.get("pattern", "*")
        self.most = int(options.get("range_bytes", RANGE_BYTES))
        self.last: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> dict[str, int]:
        fs, top = file_system(self.path)
        scheme = self.path[: len(self.path) - len(top)]
        found = fs.get_file_info(pafs.FileSelector(top, allow_not_found=True))
        return {scheme + i.path: i.size for i in found if i.type == pafs.FileType.File and fnmatch.fnmatchcase(i.base_name, self.pattern) and not i.base_name.startswith((".", "_"))}

    def latestOffset(self) -> dict:
        """Goes on from the last offset known; after a restart from the files' beginnings, which gives the same states."""
        out = {}
        for file, size in sorted(self._files().items()):
            fs, name = file_system(file)
            known = self.last.get(file)
            if known is not None and known["place"] >= size:
                out[file] = known
                continue
            with fs.open_input_file(name) as handle:
                src = ranges.Bytes(handle, size)
                if known is None and size < 24:
                    continue  # not even a header
                f = ranges.format_of(src)
                s = _state(known) if known else ranges.State(f.first(), getattr(f, "order", "<"))
                out[file] = _plain(advanced(f, s, size))
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        got: list[InputPartition] = []
        for file, to in sorted(end.items()):
            self.last.setdefault(file, to)  # a restarted query may begin here
            begin = start.get(file)
            if begin is None or begin["place"] < to["place"]:
                fs, name = file_system(file)
                with fs.open_input_file(name) as handle:
                    f = ranges.format_of(ranges.Bytes(handle, to["place"]))
                    s = _state(begin) if begin else ranges.State(f.first(), getattr(f, "order", "<"))
                    while s.place < to["place"]:
                        upto = advanced(f, s, min(to["place"], s.place + self.most)) if to["place"] - s.place > self.most else _state(to)
                        got.append(_Range(file, _plain(s), upto.place))
                        s = upto
        return got

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        from framequarry.sources.captures import _batches, _row

        fs, name = file_system(partition.file)
        with fs.open_input_file(name) as handle:
            f = ranges.format_of(ranges.Bytes(handle, partition.end))
            yield from _batches(_row(partition.file, p) for p in f.packets(_state(partition.state), partition.end, False))

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.readStream.format("capture_tail").option("pattern", "*.pcapng").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "capture_tail"

    def schema(self) -> str:
        from framequarry.sources.captures import PACKETS

        return PACKETS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(TailSource)
