"""Web archives (WARC 1.1) compressed record by record with a shared Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary, itself compressed, as the public specification of
Zstandard-compressed archives has it; then come a `warcinfo` record and one record for each page, each a frame of its own, so
any record can be read from its offset. The dictionary is built from pieces of the records to be archived, drawn evenly from all their
bytes: SAMPLE_BYTES of them are a documented bound, and no result depends on which. Too few records to build one from are archived without.

A payload that several pages have is stored once, by the page with the largest id; the others are `revisit` records that refer to
it and keep the HTTP head only, whose Content-Length says how long the payload is. Payloads shorter than `revisit_from` bytes are always stored. Ids of records
are UUIDs of version 8 that hold the page's id and a part of the payload's digest, so a reader gets the page from the id alone.

Pages are written where they are read, a part of an archive's name telling apart attempts; the manifest, a committed table, names the archives that
count. Digests are grouped as hashes and numbers alone; of those that repeat a small table is broadcast, and a large one joined with salt, so a payload
that a third of all pages have does not meet in one task. Files are written with pyarrow's file systems: the shared folder must be one
that these reach (local, HDFS, S3, GCS).

A null html is an empty payload, a null url gives no target. Pages without an id are stored if all that share their payload have none, and else are revisits, their ids null when read. Rows
that repeat under the largest id are all stored, each with the same record id, as they are one page. A table without rows gives no archives. Columns
other than the id, the url and the html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import arrow_map, bounded_memory, delete_at_end, is_small, record, stash, text_slices, work_dir

#: Bytes of records that the dictionary is built from, of a piece of one, and of the dictionary.
SAMPLE_BYTES, PIECE_BYTES, DICTIONARY_BYTES = 8 << 20, 8 << 10, 112_640
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: A table of repeated digests of so many bytes at most is broadcast; shares that pages are dealt to when it is larger.
BROADCAST_BYTES, SALTS = 8 << 20, 8
#: The specification's fixed values: the first frame, any skippable frame, and what makes a record a revisit.
DICTIONARY_FRAME, SKIPPABLE = 0x184D2A5D, 0x184D2A50
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, n_records bigint, n_bytes bigint"
_PAGE_BITS, _DIGEST_BITS = 64, 57


# ---- records --------------------------------------------------------------------------------------------


def record_id(page_id: int | None, sha1: bytes) -> str:
    """A UUID of version 8: whether there is a page id, 57 bits of the payload's digest, the id."""
    v = (0 if page_id is None else 1) << (_PAGE_BITS + _DIGEST_BITS) | (int.from_bytes(sha1[:8], "big") >> (64 - _DIGEST_BITS)) << _PAGE_BITS | ((page_id or 0) & ((1 << _PAGE_BITS) - 1))
    high, middle, low = v >> 74, v >> 62 & 0xFFF, v & ((1 << 62) - 1)
    return f"<{uuid.UUID(int=high << 80 | 8 << 76 | middle << 64 | 2 << 62 | low).urn}>"


def page_of(record: str) -> int | None:
    """The page id that a record's id holds."""
    n = uuid.UUID(record.strip("<>").removeprefix("urn:")).int
    v = (n >> 80) << 74 | (n >> 64 & 0xFFF) << 62 | n & ((1 << 62) - 1)
    if not v >> (_PAGE_BITS + _DIGEST_BITS):
        return None
    page = v & ((1 << _PAGE_BITS) - 1)
    return page - (1 << _PAGE_BITS) if page >> (_PAGE_BITS - 1) else page


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _address(url: str) -> str:
    """The url without characters that would end a header's line or value."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def _assembled(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response, or a revisit of the page `refers_to`, which has the same payload."""
    sha1 = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, sha1)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _address(url)))
    if revisit:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers_to, sha1)), ("WARC-Refers-To-Date", date)]
    headers += [("WARC-Payload-Digest", f"sha1:{base32_sha1(sha1)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).digest())}"), ("Content-Type", "application/http; msgtype=response")]
    return _assembled(headers, block)


def info_record(date: str) -> bytes:
    return _assembled([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: framequarry\r\nformat: WARC File Format 1.1\r\n")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; a record that is not whole or does not have its own digests is refused."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers.get("content-length", -1))
    block = rest[:size]
    if not lines[0].startswith("WARC/") or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("no whole record")
    digest = headers.get("warc-block-digest")
    if digest and digest != f"sha1:{base32_sha1(hashlib.sha1(block).digest())}":
        raise ValueError(f"block of {headers.get('warc-record-id')} is not what was written")
    return headers, block


def http_parts(block: bytes) -> tuple[int, bytes]:
    """The Content-Length of an HTTP message and its body."""
    head, _, body = block.partition(b"\r\n\r\n")
    sizes = [int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    return (sizes[0] if sizes else len(body)), body


# ---- frames ---------------------------------------------------------------------------------------------


class ArchiveWriter:
    """One archive: dictionary frame, warcinfo, then records as they come, each its own frame."""

    def __init__(self, sink, dictionary: bytes, level: int, date: str):
        self.sink, self.n_bytes, self.n_records = sink, 0, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.coder = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self._put(self.coder.compress(info_record(date)))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.n_bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.coder.compress(data))
        self.n_records += 1


def archive_records(stream, chunk: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed size and bytes of every record of an archive; holds one record and `chunk` bytes."""
    buf, at, coder = b"", 0, None
    while True:
        while len(buf) < 8 and (more := stream.read(chunk)):
            buf += more
        if not buf:
            return
        magic = int.from_bytes(buf[:4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            size = 8 + int.from_bytes(buf[4:8], "little")
            while len(buf) < size and (more := stream.read(chunk)):
                buf += more
            if len(buf) < size:
                raise ValueError("the archive ends within a frame")
            if magic == DICTIONARY_FRAME and at == 0:
                held = buf[8:size]
                if held[:4] == b"\x28\xb5\x2f\xfd":  # compressed itself
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            buf, at = buf[size:], at + size
            continue
        coder = coder or zstandard.ZstdDecompressor()
        one, parts, began, fed = coder.decompressobj(), [], at, 0
        while not one.eof:
            if not buf and not (buf := stream.read(chunk)):
                raise ValueError("the archive ends within a frame")
            parts.append(one.decompress(buf))
            fed += len(buf)
            buf = b""
        buf = one.unused_data
        at = began + fed - len(buf)
        yield began, at - began, b"".join(parts)


def read_record(file: str, offset: int, size: int, dictionary: bytes = b"") -> tuple[dict[str, str], bytes]:
    """One record by its place, without reading those before it."""
    fs, path = _open(file)
    with fs.open_input_file(path) as f:
        data = f.read_at(size, offset)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return parse_record(zstandard.ZstdDecompressor(dict_data=known).decompress(data))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


# ---- pages to archives --------------------------------------------------------------------------------------


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))


def build_dictionary(rows: DataFrame, total: int, date: str) -> bytes:
    """A dictionary of DICTIONARY_BYTES at most from pieces of the records, each drawn with the same chance; nothing where there is too little."""
    if not total:
        return b""
    share = min(1.0, SAMPLE_BYTES / total)
    n_pieces = F.ceil(F.greatest(F.lit(1), F.length("payload")) / PIECE_BYTES).cast("int")
    # the numbers of the pieces drawn, before any piece is cut: each by a hash with its row's number, however often a payload repeats
    drawn_at = lambda i: F.pmod(F.xxhash64("row", i), F.lit(1 << 30)) < int(share * (1 << 30))
    numbers = F.filter(F.sequence(F.lit(0), n_pieces - 1), drawn_at)
    pieces = rows.withColumn("row", F.monotonically_increasing_id()).select("page_id", "url", "payload", F.explode(numbers).alias("n"))
    drawn = pieces.select("page_id", "url", "n", F.expr(f"substring(payload, n * {PIECE_BYTES} + 1, {PIECE_BYTES})").alias("piece"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for b in batches:
            for page, url, n, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                samples.append(page_record(page, url, piece, date) if n == 0 else piece)
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples
            made = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([made], pa.binary())})

    bounded_memory(rows.sparkSession)
    got = drawn.repartition(1).mapInArrow(train, "dictionary binary").first()
    return bytes(got[0]) if got else b""


def write_archives(pages: DataFrame, folder: str | None = None, revisit_from: int = 0, level: int = 3, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives and returns the manifest (MANIFEST), read from its table."""
    spark = pages.sparkSession
    own = folder is None  # a folder of the caller's stays
    folder = folder or work_dir(spark, "archives")
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = _rows(pages, id_col, url_col, html_col)
    if rows.select("page_id").isEmpty():
        return spark.createDataFrame([], MANIFEST)
    seen = Observation()
    digests = rows.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").cast("bigint").alias("n"))
    digests = digests.observe(seen, F.sum("n").alias("total"))
    grouped = digests.where(F.col("n") >= revisit_from).groupBy(F.unhex("digest").alias("of")).agg(F.count("*").alias("copies"), F.max("page_id").alias("leader"))
    repeated = stash(grouped.where("copies > 1").select("of", "leader"), "repeated")
    dictionary = build_dictionary(rows, int(seen.get["total"] or 0), date)
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    if is_small(repeated, BROADCAST_BYTES):
        joined = keyed.join(F.broadcast(repeated), F.col("digest") == F.col("of"), "left")
    else:
        salted = repeated.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = keyed.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, (F.col("digest") == F.col("of")) & (F.col("deal") == F.col("salt")), "left")
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    src = joined.select("page_id", "url", "payload", revisit.alias("revisit"), "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        fs, base = _open(folder)
        made: list[tuple[str, int, int]] = []
        w = None

        def close() -> None:
            w.sink.close()
            made.append((f"{folder}/{name}", w.n_records, w.n_bytes))

        for s in text_slices(batches, "payload"):
            for page, url, payload, again, leader in zip(s.batch.column(0).to_pylist(), s.batch.column(1).to_pylist(), s.raw(), s.batch.column(3).to_pylist(), s.batch.column(4).to_pylist(), strict=True):
                if w is not None and w.n_bytes >= archive_bytes:
                    close()
                    w = None
                if w is None:
                    fs.create_dir(base, recursive=True)
                    name, n = f"pages-{part:06d}-{n:04d}-{uuid.uuid4().hex[:12]}.warc.zst", n + 1
                    # by its name pyarrow would compress the whole file once more
                    w = ArchiveWriter(fs.open_output_stream(f"{base}/{name}", compression=None), dictionary, level, date)
                w.add(page_record(page, url, payload, date, leader, again))
        if w is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pydict({"file": [m[0] for m in made], "n_records": pa.array([m[1] for m in made], pa.int64()), "n_bytes": pa.array([m[2] for m in made], pa.int64())})

    manifest = stash(arrow_map(src, run, MANIFEST).repartition(1), "manifest")  # a row for each archive
    if own:
        delete_at_end(spark, folder)
    return manifest


# ---- archives to rows ---------------------------------------------------------------------------------------

RECORDS = "file string, offset bigint, size bigint, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """RECORDS of every page's record, from the archives alone; with payloads also `payload` (null in revisits)."""
    fields = [("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    out = pa.schema(fields + ([("payload", pa.binary())] if payloads else []))

    def row(file: str, offset: int, size: int, data: bytes) -> tuple | None:
        headers, block = parse_record(data)
        kind = headers.get("warc-type")
        if kind not in ("response", "revisit"):
            return None
        n, body = http_parts(block)
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(body) != n or base32_sha1(hashlib.sha1(body).digest()) != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} is not what was written")
        refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
        got = (file, offset, size, page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, n, digest, refers)
        return (*got, body if kind == "response" else None) if payloads else got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, path = _open(file)
                held, weight = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, size, data in archive_records(stream):
                        got = row(file, offset, size, data)
                        if got is not None:
                            held.append(got)
                            weight += len(data) if payloads else 0
                        if len(held) >= 4000 or weight >= 2 << 20:
                            yield record(out, *zip(*held, strict=True))
                            held, weight = [], 0
                if held:
                    yield record(out, *zip(*held, strict=True))

    files = manifest.select("file").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    return arrow_map(files, run, RECORDS + (", payload binary" if payloads else ""))
