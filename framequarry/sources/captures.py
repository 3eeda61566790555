"""Captures as Spark sources and sinks.

Files are listed and read by Spark's own binary reader, so any store that Spark reaches will do, and become rows in
Arrow batches, one task for a few files; with `range_bytes`, large files are read in ranges by many tasks (sources.ranges). `register(spark)` adds
the data source "capture" for spark.read, for spark.write and as a stream's sink; read_capture_stream() follows a folder that capture files are dropped into.
"""

from __future__ import annotations

import fnmatch
import posixpath
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from framequarry.shared import file_system, stored, work_dir
from framequarry.sources import formats, ranges

PACKETS = "file string, frame_no bigint, section int, interface_id bigint, linktype int, ts_ns bigint, ts timestamp, caplen bigint, origlen bigint, frame binary, comment string, custom boolean, pen bigint"
BLOCKS = "file string, block_no bigint, block_type bigint, block_len bigint, body binary"

_PACKETS = pa.schema(
    [("file", pa.string()), ("frame_no", pa.int64()), ("section", pa.int32()), ("interface_id", pa.int64()), ("linktype", pa.int32()), ("ts_ns", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("caplen", pa.int64()), ("origlen", pa.int64()), ("frame", pa.binary()), ("comment", pa.string()), ("custom", pa.bool_()), ("pen", pa.int64())]
)


def _row(file: str, p: formats.Packet) -> tuple:
    return (file, p.frame_no, p.section, p.interface_id, p.linktype, p.ts_ns, p.ts_ns // 1000, p.caplen, p.origlen, p.frame, p.comment, p.custom, p.pen)


def _batches(rows: Iterator[tuple], size: int = 4000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKETS, strict=True)], schema=_PACKETS)


def packets_of(files: DataFrame, path_col: str = "path", content_col: str = "content", compat: bool = False) -> DataFrame:
    """Packets of captures that a column holds whole; a null or foreign content gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _batches(_row(path, p) for p in formats.packets(content or b"", compat))

    return files.select(F.col(path_col).cast("string"), content_col).mapInArrow(run, PACKETS)


def read_capture(spark: SparkSession, path: str | list[str], compat: bool = False, range_bytes: int | None = None) -> DataFrame:
    """The packets of all capture files at a path (a file, a folder, a pattern), numbered within their file.

    Without range_bytes a file is read whole by one task, from any store that Spark reaches, up to 2 GB. With it, files are indexed in
    ranges of so many bytes and then read by a task for each range (two passes), whatever their size; scan_captures() reads a kept index.
    """
    if range_bytes:
        return scan_captures(ranges.index_captures(spark, path, range_bytes), compat)
    return packets_of(spark.read.format("binaryFile").load(path), compat=compat)


def scan_captures(index: DataFrame, compat: bool = False) -> DataFrame:
    """The packets of an index of ranges (ranges.index_captures), or of those of its ranges that the caller leaves in."""
    return ranges.scan(index, lambda file, packets: _batches(_row(file, p) for p in packets), PACKETS, compat)


def capture_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The blocks of next-generation captures, whatever their type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = list(formats.blocks(content or b""))
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(found), pa.string()), "block_no": pa.array([x.number for x in found], pa.int64()), "block_type": pa.array([x.kind for x in found], pa.int64()), "block_len": pa.array([x.size for x in found], pa.int64()), "body": pa.array([x.body for x in found], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def read_capture_stream(spark: SparkSession, folder: str, max_files: int = 16) -> DataFrame:
    """The packets of capture files as they are dropped into a folder."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return packets_of(files)


def read_hex(spark: SparkSession, rows: DataFrame, text_col: str, linktype: int = 1, dumps: bool = True) -> DataFrame:
    """frame and linktype of hex dumps in a text column. Plain hex stays in the JVM; dumps with offsets go through Python."""
    plain = F.regexp_replace(F.col(text_col), r"[\s:]", "")
    if not dumps:
        return rows.withColumn("frame", F.unhex(F.when(plain.rlike("^([0-9A-Fa-f]{2})*$"), plain))).withColumn("linktype", F.lit(linktype))
    f = F.udf(lambda t: None if t is None else formats.hex_text(t), "binary", useArrow=True)
    return rows.withColumn("frame", f(F.col(text_col))).withColumn("linktype", F.lit(linktype))


def nth_packet(frames: DataFrame, n: int, file: str | None = None) -> DataFrame:
    """The n-th packet, from 1, of a file, or of every file."""
    return frames.where(_nth(n, file))


def _nth(n: int, file: str | None) -> Column:
    return (F.col("frame_no") == n) if file is None else (F.col("frame_no") == n) & (F.col("file") == file)


def merged(frames: DataFrame) -> DataFrame:
    """The frames of several files as one capture: numbered from 1 by time, then file and number; the columns are file_of and no_in_file instead of file.

    Numbers are counted within milliseconds, those within seconds, seconds within hours and hours, so only a row for each hour meets in one place,
    and a task's sort is of the frames of a few milliseconds. Frames without a time come first. Nothing is broadcast: what frames are made of says little of their size.
    """
    df = frames.withColumn("_ms", F.coalesce(F.floor(F.col("ts_ns") / 1_000_000), F.lit(-(1 << 62))))
    parts = df.groupBy("_ms").agg(F.count("*").alias("_n")).withColumn("_s", F.floor(F.col("_ms") / 1000)).withColumn("_h", F.floor(F.col("_s") / 3600))
    seconds = parts.groupBy("_h", "_s").agg(F.sum("_n").alias("_sn"))
    hours = seconds.groupBy("_h").agg(F.sum("_sn").alias("_hn"))

    def before(n: str, by: Column | str, order: str) -> Column:
        return F.coalesce(F.sum(n).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    hours = hours.select("_h", before("_hn", F.lit(0), "_h").alias("_h0"))
    seconds = seconds.withColumn("_s0", before("_sn", "_h", "_s")).join(hours.hint("merge"), "_h").select("_s", (F.col("_s0") + F.col("_h0")).alias("_s0"))
    parts = parts.withColumn("_n0", before("_n", "_s", "_ms")).join(seconds.hint("merge"), "_s").select("_ms", (F.col("_n0") + F.col("_s0")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_ms").orderBy("ts_ns", "file", "frame_no"))
    out = df.join(parts.hint("merge"), "_ms").withColumn("_no", F.col("_first") + place)
    names = {"file": "file_of", "frame_no": "no_in_file"}
    return out.select(F.col("_no").alias("frame_no"), *(F.col(c).alias(names.get(c, c)) for c in frames.columns))


# ---- writing --------------------------------------------------------------------------------------------


#: What a written packet is made from, as far as frames have it.
_WRITTEN = ("frame", "linktype", "ts_ns", "origlen", "comment", "interface_id")


def _written(w: formats.Writer, v: dict) -> bytes:
    linktype = v.get("linktype")  # 0 is one
    return w.packet(bytes(v["frame"]), 1 if linktype is None else linktype, v.get("ts_ns") or 0, v.get("origlen"), v.get("comment"), v.get("interface_id") or 0)


def capture_files(frames: DataFrame, order_by: str = "frame_no") -> DataFrame:
    """content: one whole capture for each partition of frames, its packets in order."""
    src = frames.sortWithinPartitions(order_by).select(*(c for c in _WRITTEN if c in frames.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = formats.Writer()
        parts = [w.start()]
        for b in batches:
            parts += [_written(w, v) for v in b.to_pylist() if v["frame"] is not None]
        if len(parts) > 1:
            yield pa.RecordBatch.from_pydict({"content": pa.array([b"".join(parts)], pa.binary())})

    return src.mapInArrow(run, "content binary")


MANIFEST = "part int, file string, first bigint, last bigint, n_frames bigint"


def export_captures(frames: DataFrame, picks: DataFrame, folder: str | None = None, parts: int | None = None, pick_col: str = "frame_no") -> DataFrame:
    """Writes the picked frames in the order in which `picks` lists them (its column `ordinal`, with `file` where both have it) and returns the manifest.

    The list is dealt into ranges of ordinals; each becomes a capture with an interface table of its own, written by one task. The manifest, a
    committed table, names the captures that count, in order: part, file, its first and last ordinal, its frames. Unknown picks
    are skipped, a frame listed twice is written twice, equal ordinals follow frame numbers. read_export() reads it as one capture.
    """
    spark = frames.sparkSession
    folder = folder or work_dir(spark, "export")
    own = [c for c in ("file",) if c in frames.columns and c in picks.columns]
    chosen = frames.join(picks.select(F.col(pick_col).alias("frame_no"), F.col("ordinal").cast("bigint").alias("ordinal"), *own), ["frame_no", *own])
    cols = ["ordinal", *(c for c in _WRITTEN if c in frames.columns)]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.repartitionByRange(n, "ordinal").sortWithinPartitions("ordinal", "frame_no").select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, w, frames_written, first, last, sink = TaskContext.get().partitionId(), formats.Writer(), 0, None, None, None
        fs, base = file_system(folder)
        name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}.pcapng"  # of this attempt
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.to_pylist()
            if sink is None:
                fs.create_dir(base, recursive=True)
                sink, first = fs.open_output_stream(f"{base}/{name}"), rows[0]["ordinal"]
                sink.write(w.start())
            blocks = [_written(w, v) for v in rows if v["frame"] is not None]
            sink.write(b"".join(blocks))  # one write for a batch: a stream has no buffer of its own
            frames_written += len(blocks)
            last = rows[-1]["ordinal"]
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()), "n_frames": pa.array([frames_written], pa.int64())})

    return stored(dealt.mapInArrow(run, MANIFEST), "manifest")


def export_capture(frames: DataFrame, picks: DataFrame, pick_col: str = "frame_no") -> DataFrame:
    """content: one capture of the picked frames as a value, for lists that fit in one; export_captures() writes any list."""
    own = [c for c in ("file",) if c in frames.columns and c in picks.columns]
    chosen = frames.join(picks.select(F.col(pick_col).alias("frame_no"), "ordinal", *own), ["frame_no", *own])
    return capture_files(chosen.coalesce(1), "ordinal")


def read_export(manifest: DataFrame) -> DataFrame:
    """The packets of exported captures as one capture: numbered from 1 in the order of the manifest."""
    before = F.coalesce(F.sum("n_frames").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from _batches((row[0], row[1] + r["before"], *row[2:]) for row in (_row(r["file"], p) for p in ranges.file_packets(r["file"])))

    files = manifest.select("file", before.cast("bigint").alias("before"))
    return files.repartition(max(1, manifest.count())).mapInArrow(run, PACKETS)


def replace_packet(frames: DataFrame, n: int, frame: bytes, file: str | None = None) -> DataFrame:
    """frames with the bytes of the n-th packet (of a file, or of each) replaced."""
    hit = _nth(n, file)
    new = F.lit(frame)
    out = frames.withColumn("frame", F.when(hit, new).otherwise(F.col("frame")))
    for c in ("caplen", "origlen"):
        if c in frames.columns:
            out = out.withColumn(c, F.when(hit, F.length(new).cast("bigint")).otherwise(F.col(c)))
    return out


def set_comment(frames: DataFrame, n: int, comment: str | None, file: str | None = None) -> DataFrame:
    return frames.withColumn("comment", F.when(_nth(n, file), F.lit(comment)).otherwise(F.col("comment")))


def commented(frames: DataFrame) -> DataFrame:
    return frames.where(F.length("comment") > 0)


def snapped(frames: DataFrame, snaplen: int) -> DataFrame:
    """frames cut to snaplen bytes (0: 65535)."""
    n = snaplen or 65535
    return frames.withColumn("frame", F.substring("frame", 1, n)).withColumn("caplen", F.length("frame").cast("bigint"))


# ---- the data source ------------------------------------------------------------------------------------


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.compat = options.get("path", ""), options.get("compat", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        fs, top = file_system(self.path.rstrip("/"))
        where = top if "*" not in top else top[: top.index("*")].rpartition("/")[0]
        info = fs.get_file_info(where)
        if info.type == pafs.FileType.File:
            return [_File(self.path)]
        if info.type != pafs.FileType.Directory:
            return []
        files = [i.path for i in fs.get_file_info(pafs.FileSelector(where, recursive=True)) if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))]
        scheme = self.path[: len(self.path.rstrip("/")) - len(top)]
        return [_File(scheme + f) for f in sorted(files) if where == top or fnmatch.fnmatchcase(f, top)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        """A window of the file is held at a time, so its size does not matter."""
        yield from _batches(_row(partition.path, p) for p in ranges.file_packets(partition.path, self.compat))


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class _Writer(DataSourceWriter):
    """A file for each task under a temporary name, renamed when the whole job commits."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.names = schema.names
        self.overwrite = overwrite

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        fs, top = file_system(self.path)
        fs.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.pcapng"
        temporary = posixpath.join(top, f".{name}.tmp")
        w = formats.Writer()
        with fs.open_output_stream(temporary) as f:
            f.write(w.start())
            for r in rows:
                v = dict(zip(self.names, r, strict=True))
                if v.get("frame") is not None:
                    f.write(_written(w, v if v.get("ts_ns") is not None else {**v, "ts_ns": time.time_ns()}))
        return _Written(temporary, posixpath.join(top, name))

    def commit(self, messages: list) -> None:
        fs, top = file_system(self.path)
        new = {m.final for m in messages if m}
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
                if i.path.endswith(".pcapng") and i.path not in new:
                    fs.delete_file(i.path)
        for m in messages:
            if m:
                fs.move(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m and fs.get_file_info(m.temporary).type == pafs.FileType.File:
                fs.delete_file(m.temporary)


class CaptureSource(DataSource):
    """spark.read.format("capture").load(path); df.write.format("capture").mode(...).save(path). For stores that pyarrow's file
    systems reach (local, HDFS, S3, GCS); read_capture() reads any store."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)
