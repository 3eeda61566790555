"""What the text operators share: the shared work folder, Arrow text slices, and word and hash arithmetic.

All heavy per-byte work is numpy over slices of a few MB, so a worker's memory does not depend on how many rows a
partition holds. One text is the least a slice can be; operators work on a longer one in blocks where they can,
so it costs a small multiple of its own size while it is worked on, and nothing afterwards.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 21
#: Bytes that Spark hands a Python worker at once; its own default, 64 MB, stays with the JVM as buffers outside the heap.
BATCH_BYTES = 2 << 20
#: A shuffled side whose partitions are all so small is hashed in a join.
HASHED_BYTES = 64 << 20
#: Bytes read for each task that writes a work table.
FILE_BYTES = 8 << 20
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) sets its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import os
        import re
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "framequarry")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below shared_dir."""
    return f"{shared_dir(spark)}/fq-{label}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends, if nobody has deleted it before."""
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)


def stash(df: DataFrame, label: str, by_partition: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and a lost executor costs nothing.

    Without a codec: what is stored is hashes and numbers, or compressed already, and codecs keep buffers outside the heap.
    A table made from little is written by a task for each core and each FILE_BYTES that it reads, not as many empty files;
    with by_partition every partition keeps a task of its own, whose number df's functions may use.
    """
    path = work_dir(df.sparkSession, label)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-read_bytes(df) // FILE_BYTES))
    out = df if by_partition else df.coalesce(min(tasks, (1 << 31) - 1))
    out.write.option("compression", "none").parquet(path)
    delete_at_end(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fq_stash = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def stash_measured(df: DataFrame, label: str, measures: dict[str, Column]) -> tuple[DataFrame, dict]:
    """stash(), and aggregates of the rows, observed as they are written."""
    seen = Observation()
    return stash(df.observe(seen, *(c.alias(k) for k, c in measures.items())), label), seen.get


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables stashed inside are deleted at the end, but for those taken out of the list."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        drop(*_scratch.pop())


def drop(*stashes: DataFrame) -> None:
    """Deletes stashed tables that nothing will read again."""
    for df in stashes:
        p, fs = _hadoop_path(df.sparkSession, df._fq_stash)
        fs.delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's size of df: file sizes of what it reads, scaled by its columns; joins can only make it larger."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read_bytes(df: DataFrame) -> int:
    """What df reads, all columns: the sizes of the tables at its leaves."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
    while leaves.hasNext():
        total += int(leaves.next().stats().sizeInBytes())
    return total


def is_small(df: DataFrame, limit: int) -> bool:
    return plan_bytes(df) <= limit


def small(df: DataFrame, limit: int) -> DataFrame:
    """df, to be broadcast if it is at most `limit` bytes large; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if is_small(df, limit) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the id's text modulo 5 is 0; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Texts:
    """Some rows of a batch: `buf` holds their UTF-8 bytes end to end, row i being buf[offs[i]:offs[i + 1]]."""

    def __init__(self, batch: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray):
        self.batch, self.buf, self.offs = batch, buf, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def raw(self) -> list[bytes]:
        b = self.buf.tobytes()
        return [b[i:j] for i, j in zip(self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The batches' rows in order, cut so that a slice has at most `limit` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = _bytes_of(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            to = min(to, n)
            yield Texts(batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            at = to


def release() -> None:
    """Gives what a worker has freed back to the system: workers live on from stage to stage and share the executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        pass


def _size(spark: SparkSession, name: str, default: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, default))


def bounded_memory(spark: SparkSession) -> None:
    """Session settings that keep executors small; no result depends on them.

    Arrow batches have BATCH_BYTES at most. A join whose measured partitions are all within the session's advisory size (HASHED_BYTES
    at most) on one side is hashed instead of sorted, which spares each task the pages that sorts take even for a few rows.
    """
    batch, hashed = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    limit = min(HASHED_BYTES, _size(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))
    if not 0 < _size(spark, batch, "64m") <= BATCH_BYTES:
        spark.conf.set(batch, str(BATCH_BYTES))
    if _size(spark, hashed, "0") < limit:
        spark.conf.set(hashed, str(limit))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    bounded_memory(df.sparkSession)
    return df.mapInArrow(run, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


# ---- words -------------------------------------------------------------------------------------


def class_table(inside: Callable[[int], bool]) -> np.ndarray:
    """A table over byte values: whether the byte belongs to a word."""
    return np.array([inside(b) for b in range(256)])


#: Words between ASCII white space: [^\x20\x09-\x0D]+.
NOT_SPACE = class_table(lambda b: b != 32 and not 9 <= b <= 13)
#: Runs of ASCII letters, digits and anything beyond ASCII: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+.
ALNUM = class_table(lambda b: b >= 128 or chr(b).isalnum())


def word_spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses a row."""
    if not len(buf):
        return (np.empty(0, np.int64),) * 3
    flag = inside[buf]
    full = offs[:-1] < offs[1:]
    before = np.empty_like(flag)
    before[0], before[1:] = False, flag[:-1]
    before[offs[:-1][full]] = False
    after = np.empty_like(flag)
    after[-1], after[:-1] = False, flag[1:]
    after[offs[1:][full] - 1] = False
    start = np.flatnonzero(flag & ~before)
    end = np.flatnonzero(flag & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the public splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_LANES = _odd(64, 11)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=_U)
#: Spans of more bytes than this are digested one by one.
_LONG = 64


def _loads(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as an integer, zeros after the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each span's bytes; with fold, A-Z count as a-z.

    Eight bytes at a time go through a mixing chain (long spans through BLAKE2), so no pattern of bytes collides by construction.
    """
    if not len(start):
        return np.empty(0, _U)
    text = FOLD[buf] if fold else np.ascontiguousarray(buf)
    load = _loads(text)
    size = end - start
    h = mix(size.astype(_U) * _LANES[0] + _LANES[1])
    h = mix(h ^ (load[start] & _MASKS[np.minimum(size, 8)]))
    at, n = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(at):
        h[at] = mix(h[at] ^ (load[start[at] + n] & _MASKS[np.minimum(size[at] - n, 8)]))
        n += 8
        at = at[size[at] > n]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def gram_hashes(buf: np.ndarray, start: np.ndarray | None, k: int) -> np.ndarray:
    """A quick hash of the k bytes from each start on (None: each position that has so many): for dealing and filtering, where a clash costs work but no result."""
    load = _loads(np.ascontiguousarray(buf))
    n = len(buf) - k + 1
    read = (lambda o: load[o : o + n]) if start is None else (lambda o: load[start + o])
    if k < 8:
        return mix((read(0) & _MASKS[k]) * _LANES[2])
    total = read(0) * _LANES[2]
    for j, o in enumerate([*range(8, k - 7, 8), *([k - 8] if k % 8 else [])], 3):
        total += read(o) * _LANES[j % 64]
    return mix(total)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, whatever rows they are of."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, _U)
    total = np.zeros(m, _U)
    for j in range(n):
        total += words[j : j + m] * _LANES[j]
    return mix(total)


class HashIndex:
    """Distinct unsigned keys to their positions: open addressing that numpy looks up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.zeros(1 << self.bits, _U)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            self.probes += 1
            s = slot[left]
            free = self.at[s] < 0
            take = left[free]
            _, first = np.unique(slot[take], return_index=True)
            took = take[first]
            self.at[slot[took]], self.keys[slot[took]] = took, keys[took]
            done = np.zeros(len(keys), bool)
            done[took] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key is unknown."""
        slot = self._slot(keys)
        got = self.at[slot]
        hit = self.keys[slot] == keys
        out = np.where(hit, got, -1)
        open_ = np.flatnonzero(~hit & (got >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.at[slot[open_]]
            hit = (self.keys[slot[open_]] == keys[open_]) & (got >= 0)
            out[open_[hit]] = got[hit]
            open_ = open_[~hit & (got >= 0)]
        return out
