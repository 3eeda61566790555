"""Token ids in Arrow files of fixed-size lists.

A data file holds its part of the corpus's token stream, cut into rows of `seq_len` ids (FixedSizeList) and
as many mask bits (1: an id, 0: the padding after a file's last id). Ids take 16 bits where the vocabulary
allows it, else 32. Batches have a fixed number of rows, so
sequence i of a file is row i % rows of batch i // rows: a memory map gives it without a copy. An index file
beside it lists the file's documents: doc_id, start (ids of all earlier documents), n_tokens.

Files follow ascending doc_id: the documents are dealt by ranges of it, each partition writes one pair of files,
under a name of its attempt, and the manifest, a committed table, names the files that count; what an attempt
that died has written is never read. There is a pair for about FILE_BYTES of input, so files do not grow with the corpus.
Null texts are empty; a document always ends with `end_id`. Documents with a null id come first; rows with the same id
follow each other. A table without rows gives no files. Columns other than the id and the text are not read, whatever their names.
A text that holds an added token's string (`<|endoftext|>`) gets that token's id there, as the library gives it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MANY_PIECES, PieceCoder, _empty_safe
from .common import arrow_map, delete_at_end, read_bytes, stash, text_slices, work_dir

MANIFEST = "part int, data string, docs string, first_doc bigint, n_docs bigint, n_tokens bigint"
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_coders: dict[str, tuple[_Coder, np.dtype]] = {}
#: Bytes of the tables read for each pair of files; small tables are dealt to all shuffle partitions, down to the second number.
FILE_BYTES, LEAST_BYTES = 64 << 20, 1 << 20


class _Coder:
    """Texts to ids: in known pieces, or, where the text of an added token stands in them, whole by the library, which looks for those first."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.folds = any(t.normalized for t in tokenizer.get_added_tokens_decoder().values()) and tokenizer.normalizer is not None
        self.pieces = PieceCoder(lambda pieces: [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)], MANY_PIECES)

    def ids(self, text: str) -> bytes:
        if self.folds or any(a in text for a in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.pieces.ids(text)


def tokenizers_coder(path: str) -> tuple[_Coder, np.dtype]:
    """Of a worker, made once: texts to ids by the tokenizers library, no special tokens added; the type that holds an id."""
    if path not in _coders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        coder = _Coder(t)
        _coders[path] = coder, np.dtype(np.uint16 if t.get_vocab_size() <= 1 << 16 else np.uint32)
    return _coders[path]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class SequenceWriter:
    """Writes a stream of ids as fixed-size rows; keeps less than one batch."""

    def __init__(self, sink, seq_len: int, rows: int, id_type: np.dtype):
        self.seq_len, self.size, self.id_type = seq_len, seq_len * rows, id_type
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(id_type), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids.astype(self.id_type), mask)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            flat = np.concatenate(self.parts)
            at = 0
            for at in range(0, len(flat) - self.size + 1, self.size):
                self._batch(flat[at : at + self.size], self.size)
            self.parts = [flat[at + self.size :]]
            self.held = len(self.parts[0])

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.parts)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.seq_len, np.uint32)]), len(flat))
        self.writer.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, seq_len: int = 2048, rows: int = 64, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns the manifest (MANIFEST), read from its table; part ascends with doc_id."""
    spark = docs.sparkSession
    own = folder is None  # a folder of the caller's stays
    folder = folder or work_dir(spark, "tokens")
    size, usual = read_bytes(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 60  # Spark takes rows that are in no table for endlessly many
    n = partitions or (max(1, -(-size // FILE_BYTES), min(usual, -(-size // LEAST_BYTES))) if known else usual)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        coder, id_type = tokenizers_coder(tokenizer_path)
        fs, base = _open(folder)
        data, index = (f"{kind}-{part:06d}-{name}.arrow" for kind in ("data", "docs"))
        w = ids_of = None
        total = n_docs = 0
        first = None
        end = np.array([end_id], np.uint32)
        for s in text_slices(batches, text_col):
            if w is None:
                fs.create_dir(base, recursive=True)
                sink, sink2 = fs.open_output_stream(f"{base}/{data}"), fs.open_output_stream(f"{base}/{index}")
                w, ids_of = SequenceWriter(sink, seq_len, rows, id_type), pa.ipc.new_file(sink2, _INDEX)
                first = s.batch.column(0)[0].as_py()
            counts = []
            for t in _empty_safe(s.batch, text_col):
                ids = np.frombuffer(coder.ids(t), "<u4")
                w.add(ids)
                w.add(end)
                counts.append(len(ids) + 1)
            at = np.cumsum([total, *counts])
            ids_of.write_batch(pa.RecordBatch.from_arrays([s.batch.column(0).cast(pa.int64()), pa.array(at[:-1]), pa.array(np.array(counts, np.int64))], schema=_INDEX))
            total, n_docs = int(at[-1]), n_docs + len(counts)
        if w is not None:
            w.close()
            ids_of.close()
            sink.close()
            sink2.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": [f"{folder}/{data}"], "docs": [f"{folder}/{index}"], "first_doc": pa.array([first], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    src = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).repartitionByRange(n, F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first())
    # A row for each pair of files, so one task can write them. Without Hadoop's native library every file that a JVM writes starts
    # processes, which until they run their program count as the whole JVM again: not beside the workers that encode.
    manifest = stash(arrow_map(src, run, MANIFEST).repartition(1), "manifest")
    if own:
        delete_at_end(spark, folder)
    return manifest


def with_offsets(manifest: DataFrame) -> DataFrame:
    """manifest with base: the ids of all earlier files. One row per file, so a window over them is small."""
    rows = manifest.select("part", "n_tokens").orderBy("part").collect()  # a few bytes for each file of many MB
    at, offsets = 0, []
    for r in rows:
        offsets.append((r.part, at))
        at += r.n_tokens
    return manifest.join(F.broadcast(manifest.sparkSession.createDataFrame(offsets, "part int, base bigint")), "part")


def read_sequence(data_file: str, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Sequence i of a data file and its mask: views into the memory map of a local file."""
    fs, path = _open(data_file)
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    r = pa.ipc.open_file(source)
    rows = r.get_batch(0).num_rows
    b = r.get_batch(i // rows)
    k = r.schema.field("ids").type.list_size
    ids, mask = (c.flatten()[(i % rows) * k : (i % rows + 1) * k] for c in b.columns)
    return ids.to_numpy(), mask


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    src = with_offsets(manifest).select("data", "docs", "base")
    src = src.repartition(max(1, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "data")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def stream(reader) -> Iterator[np.ndarray]:
        for i in range(reader.num_record_batches):
            ids, mask = (c.flatten() for c in reader.get_batch(i).columns)
            yield ids.to_numpy()[: mask.true_count].astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, docs, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (fs, path), (_, index) = _open(data), _open(docs)
                opened = pa.memory_map if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
                chunks = stream(pa.ipc.open_file(opened(path)))
                held, listing = np.empty(0, np.uint32), pa.ipc.open_file(opened(index))
                for k in range(listing.num_record_batches):
                    doc, start, n = listing.get_batch(k).columns
                    crc = []
                    for m in n.to_pylist():
                        c = 0
                        while m:
                            if not len(held):
                                held = next(chunks)
                            c = zlib.crc32(np.ascontiguousarray(held[:m]), c)
                            took = min(m, len(held))
                            held, m = held[took:], m - took
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(start.to_numpy() + base), n, pa.array(crc, pa.int64())], schema=out)

    return arrow_map(src, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
