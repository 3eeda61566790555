"""Repeated substrings across documents by a distributed enhanced suffix array and its common-prefix interval tree.

A suffix array of all texts cannot be sorted in one place, but only intervals of depth `length` and more matter
here. Equal strings of `length` bytes have the same minimiser (their `k`-gram with the smallest hash, leftmost of
equals), so suffixes are dealt by the minimiser of their first `length` bytes and every such interval lies in one
bucket whole. Consecutive suffixes with one minimiser travel as one string.

1. Documents are packed into chunks, a table of compressed blocks that later passes read.
2. Every chunk posts the distinct minimisers of its documents; those that two documents share are sent back. A minimiser
   that more than HOT chunks have (a common phrase, whatever stands around it) is told apart further, by half a
   window of the bytes before or after it, so that no bucket grows with it.
3. Every chunk sends its strings with shared minimisers to their buckets. Of equal strings in a chunk only those
   of the smallest id travel, unless all occurrences are asked for; the others repeat them for certain. A chunk sends a
   bucket one message at most, and no more messages than it has minimisers, so messages grow with the input.
4. A bucket collapses equal strings (compared byte by byte), and builds the enhanced suffix array of the rest: suffixes in
   order with the common prefix of neighbours. A stack scan of the prefixes yields the interval tree. An interval
   whose occurrences differ in the byte to their left, or begin their strings, is a group of repeats: no longer
   repeat has all its occurrences. A group gives all of them, and all but those in its smallest document lose the repeat.
   Intervals that could be extended to the left say nothing that the longer one does not.
5. Chunks gather the spans to remove and apply them.

A group's text ends with its string, `length` to 2 * length - k bytes after its start; maximal_repeats() joins the groups of one
longer repeat.

Texts are UTF-8 bytes; null is empty. Documents are compared by id: rows with one id never remove each other's
bytes, and equal rows have equal results. Rows with a null id are kept whole and remove nothing. Whole copies are
found by a 128-bit digest first, so a text with thousands of copies is indexed once. An empty table gives no rows. Columns
that are not asked for are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import _U, arrow_map, drop, gram_hashes, mix, release, span_hashes, stash, text_slices

#: Bytes of text in a chunk, bytes of text for each bucket, and suffixes sorted at once.
CHUNK_BYTES, BUCKET_BYTES, SORT_AT_ONCE = 2 << 20, 4 << 20, 40_000
SLICE = 1 << 18
#: A minimiser that so many chunks have is told apart further.
HOT = 64


def _zip(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b)


def _unzip(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


# ---- strings that share a minimiser -----------------------------------------------------------------


class Strings:
    """The runs of suffixes with one minimiser of a text buffer: start and end of each string, its row, its minimiser's place and hash."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, k: int):
        n = len(buf)
        self.length, self.k, self.buf = length, k, buf
        self.start = self.end = self.row = self.place = np.empty(0, np.int64)
        self.key = np.empty(0, _U)
        if n < length:
            return
        h = gram_hashes(buf, None, k)
        low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
        w, have = length - k + 1, 1
        while have * 2 <= w:
            low = np.minimum(low[: len(low) - have], low[have:])
            have *= 2
        if have < w:
            low = np.minimum(low[: len(low) - (w - have)], low[w - have :])
        size = np.diff(offs)
        fits = size >= length
        mark = np.zeros(n + 1, np.int8)
        np.add.at(mark, offs[:-1][fits], 1)
        np.add.at(mark, (offs[1:] - length + 1)[fits], -1)
        idx = np.flatnonzero(np.cumsum(mark[: n - length + 1]))
        if not len(idx):
            return
        m = low[idx]
        new = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (idx[1:] != idx[:-1] + 1)])
        self.start = idx[new]
        self.end = idx[np.r_[new[1:], len(idx)] - 1] + length
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.place = (m[new] & _U(0xFFFFFFFF)).astype(np.int64)
        self.key = mix(h[self.place])

    def take(self, which: np.ndarray) -> Strings:
        for name in ("start", "end", "row", "place", "key"):
            setattr(self, name, getattr(self, name)[which])
        return self

    def told_apart(self, hot: np.ndarray) -> Strings:
        """The strings that `hot` marks in two: suffixes with `part` bytes or more before their minimiser, whose key takes
        those in, and the others, all of which hold `part` bytes after it. Equal suffixes stay together."""
        part = (self.length - self.k + 1) // 2
        if not part or not hot.any():
            return self
        rest = np.flatnonzero(~hot)
        at = np.flatnonzero(hot)
        last = self.end[at] - self.length  # the last suffix's start
        cut = self.place[at] - part  # the last start with `part` bytes before the minimiser
        early, late = at[self.start[at] <= cut], at[last > cut]
        before = mix(self.key[early] ^ gram_hashes(self.buf, self.place[early] - part, part))
        after = mix((self.key[late] + _U(1)) ^ gram_hashes(self.buf, self.place[late] + self.k, part))
        end = np.minimum(self.end[early], self.place[early] - part + self.length)
        start = np.maximum(self.start[late], self.place[late] - part + 1)
        self.start, self.end = np.r_[self.start[rest], self.start[early], start], np.r_[self.end[rest], end, self.end[late]]
        self.key = np.r_[self.key[rest], before, after]
        which = np.r_[rest, early, late]
        self.row, self.place = self.row[which], self.place[which]
        return self


def equal_strings(h: np.ndarray, at: np.ndarray, size: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """A number for each string, the same for equal ones: hashes propose, bytes decide."""
    order = np.lexsort([size, h])
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1])]
    of = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][of]
    again = np.flatnonzero(head != order)
    differs = np.zeros(len(order), bool)
    step = max(1, SLICE // max(1, int(size.max())))
    for i in range(0, len(again), step):
        p = again[i : i + step]
        n = size[order[p]]
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = buf[np.repeat(at[order[p]], n) + j] == buf[np.repeat(at[head[p]], n) + j]
        differs[p] = ~np.logical_and.reduceat(same, np.cumsum(n) - n)
    out = np.empty(len(order), np.int64)
    out[order] = of
    if differs.any():  # two strings with one hash: name those by their bytes
        names: dict[bytes, int] = {}
        for i in order[np.isin(of, of[differs])].tolist():
            out[i] = names.setdefault(buf[at[i] : at[i] + size[i]].tobytes(), len(order) + len(names))
    return out


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> _U(32)) % _U(buckets)).astype(np.int64)


# ---- the enhanced suffix array ------------------------------------------------------------------------


def suffix_order(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes buf[start:end] and the common prefix of each with the one before it in that order."""
    n = len(start)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = end - start
    wide = int(-(-size.max() // 8) * 8)
    text = np.lib.stride_tricks.sliding_window_view(np.r_[buf, np.zeros(wide, np.uint8)], wide)[start]
    text[np.arange(wide, dtype=np.int32)[None, :] >= size[:, None].astype(np.int32)] = 0
    order = np.lexsort([size, *(text[:, 8 * j : 8 * j + 8].copy().view(">u8")[:, 0].astype(_U) for j in range(wide // 8 - 1, -1, -1))])
    lcp = np.zeros(n, np.int64)
    for i in range(1, n, 1 << 14):  # a block of neighbours at a time
        o = order[i - 1 : i + (1 << 14)]
        differ = text[o[1:]] != text[o[:-1]]
        same = np.where(differ.any(1), differ.argmax(1), wide)
        lcp[i : i + (1 << 14)] = np.minimum(same, np.minimum(size[o[1:]], size[o[:-1]]))
    return order, lcp


def intervals(lcp: np.ndarray, least: int, value: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(first, last, depth, smallest value) of every common-prefix interval of depth `least` or more: the stack scan.

    lcp[i] belongs to suffixes i - 1 and i. Children come before their parents.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[list[int]] = []  # depth, first, smallest value so far
    depths = np.where(lcp < least, 0, lcp).tolist()
    values = value.tolist() if value is not None else [0] * len(depths)
    depths.append(0)
    for i in range(1, len(depths)):
        d = depths[i]
        start, low = i - 1, values[i - 1]
        while stack and stack[-1][0] > d:
            depth, first, least_here = stack.pop()
            if least_here < low:
                low = least_here
            start = first
            out.append((first, i - 1, depth, low))
        if d:
            if not stack or stack[-1][0] < d:
                stack.append([d, start, low])
            elif low < stack[-1][2]:
                stack[-1][2] = low
    return out


def left_diverse(left: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the symbols before an interval's suffixes differ (-1: several already)."""
    change = np.zeros(len(left) + 1, np.int64)
    change[1:-1] = np.cumsum(left[1:] != left[:-1])
    change[-1] = change[-2]
    several = np.r_[0, np.cumsum(left < 0)]
    return (change[last] != change[first]) | (several[last + 1] > several[first])


class Bucket:
    """The strings of one bucket: owner id, chunk, row, start, the byte before (256: none) and their text."""

    def __init__(self, sent: pa.Table):
        parts = [(chunk, *_unpack(b.as_buffer())) for chunk, b in zip(sent["chunk"].to_pylist(), sent["blob"], strict=True)]
        self.chunk = np.concatenate([np.full(len(p[1]), p[0], np.int64) for p in parts])
        self.key, self.id, self.row, self.start, self.size, self.left = (np.concatenate([p[j] for p in parts]) for j in range(1, 7))
        self.buf = np.concatenate([p[7] for p in parts])
        self.to = np.cumsum(self.size)
        self.at = self.to - self.size

    def _hashes(self) -> np.ndarray:
        """A hash of each string, a slice of the buffer at a time."""
        cut = np.unique(np.r_[0, np.searchsorted(self.to, np.arange(SLICE, len(self.buf), SLICE)), len(self.to)])
        out = np.empty(len(self.to), _U)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            lo, hi = int(self.at[a]), int(self.to[b - 1])
            out[a:b] = span_hashes(self.buf[lo:hi], self.at[a:b] - lo, self.to[a:b] - lo, fold=False)
        return out

    def _gathered(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings' bytes end to end, and where each begins."""
        size = self.size[strings]
        at = np.cumsum(size) - size
        return self.buf[np.repeat(self.at[strings] - at, size) + np.arange(int(size.sum()))], at

    def scan(self, length: int) -> Iterator[Groups]:
        """The bucket's groups of repeats, a block of whole minimisers at a time."""
        text = equal_strings(self._hashes(), self.at, self.size, self.buf)
        self.order = np.lexsort([self.id, text, self.key])
        key, text, ids = self.key[self.order], text[self.order], self.id[self.order]
        self.head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])])
        self.count = np.diff(np.r_[self.head, len(self.order)])
        self.low, self.rep = ids[self.head], self.order[self.head]
        lefts = self.left[self.order]
        several = np.minimum.reduceat(lefts, self.head) != np.maximum.reduceat(lefts, self.head)
        left = np.where(several | (lefts[self.head] == 256), -1, lefts[self.head])
        key = key[self.head]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        kinds = np.diff(np.r_[first, len(key)])
        # a string that no other shares its minimiser with is compared with none
        suffixes = np.where(np.repeat(kinds > 1, kinds) | (self.count > 1), self.size[self.rep] - length + 1, 0)
        total = np.cumsum(np.add.reduceat(suffixes, first))
        cut = np.searchsorted(total, np.arange(SORT_AT_ONCE, total[-1] + SORT_AT_ONCE, SORT_AT_ONCE), "left") + 1
        bounds = np.unique(np.r_[0, np.minimum(cut, len(first))])
        edges = np.r_[first, len(key)]
        for a, b in zip(edges[bounds[:-1]].tolist(), edges[bounds[1:]].tolist(), strict=True):
            pick = np.flatnonzero(suffixes[a:b]) + a
            if len(pick):
                yield Groups(self, pick, suffixes[pick], left, length)


class Groups:
    """The groups of repeats among some of a bucket's strings: the tree's intervals that cannot be extended to the left.

    s and j: the suffixes in order, by string and offset. first, last, depth, smallest: each group's suffixes, its
    repeat's length and its smallest document. A suffix stands for its string's every owner.
    """

    def __init__(self, bucket: Bucket, pick: np.ndarray, suffixes: np.ndarray, left: np.ndarray, length: int):
        self.bucket = bucket
        s = np.repeat(pick, suffixes)
        j = np.arange(len(s)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
        buf, at = bucket._gathered(bucket.rep[pick])
        begin = np.repeat(at, suffixes) + j
        # suffixes whose first `length` bytes no other has need no sorting; of equal strings the first suffix stands for the rest
        _, inverse, n = np.unique(gram_hashes(buf, begin, length), return_inverse=True, return_counts=True)
        some = (n[inverse] > 1) | (bucket.count[s] > 1) & (j == 0)
        s, j, begin = s[some], j[some], begin[some]
        sa, lcp = suffix_order(buf, begin, begin - j + bucket.size[bucket.rep[s]])
        s, j = s[sa], j[sa]
        self.s, self.j, self.buf, self.begin = s, j, buf, begin[sa]
        before = np.where(j > 0, buf[np.maximum(self.begin - 1, 0)].astype(np.int64), left[s])
        found = np.array(intervals(lcp, length, bucket.low[s]), np.int64).reshape(-1, 4)
        # the occurrences of one suffix, where they are several and none outside has as much in common
        full = bucket.size[bucket.rep[s]] - j
        leaf = np.flatnonzero((bucket.count[s] > 1) & (full > np.maximum(lcp, np.r_[lcp[1:], 0]))) if len(s) else np.empty(0, np.int64)
        self.first, self.last = np.r_[leaf, found[:, 0]], np.r_[leaf, found[:, 1]]
        self.depth, self.smallest = np.r_[full[leaf], found[:, 2]], np.r_[bucket.low[s[leaf]], found[:, 3]]
        if len(self.first):
            # equal windows have equal minimisers, so all of a group begin their strings or none
            keep = left_diverse(before, self.first, self.last) | (j[self.first] == 0)
            self.first, self.last, self.depth, self.smallest = (x[keep] for x in (self.first, self.last, self.depth, self.smallest))

    def _owners(self, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings that own the suffixes, and which suffix each is for."""
        many = self.bucket.count[self.s[suffix]]
        which = np.repeat(np.arange(len(suffix)), many)
        return self.bucket.order[np.repeat(self.bucket.head[self.s[suffix]], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)], which

    def lost(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """chunk, row, first, end: what documents lose, being in a group with a smaller one; of nested groups the longest tells."""
        size = np.zeros(len(self.s), np.int64)  # what a suffix's smallest owner loses
        rest = np.zeros(len(self.s), np.int64)  # what its other owners lose
        least = self.bucket.low[self.s]
        wide = self.last > self.first
        # parents come after their children: going back, longer repeats overwrite shorter ones
        for a, b, d, low in zip(*(x[wide][::-1].tolist() for x in (self.first, self.last, self.depth, self.smallest)), strict=True):
            part = size[a : b + 1]
            part[least[a : b + 1] > low] = d
            part = rest[a : b + 1]
            np.maximum(part, d, out=part)
        leaf = self.first[~wide]
        rest[leaf] = np.maximum(rest[leaf], self.depth[~wide])
        at = np.flatnonzero(np.maximum(size, rest * (self.bucket.count[self.s] > 1)))
        owner, which = self._owners(at)
        at = at[which]
        n = np.where(self.bucket.id[owner] > least[at], np.maximum(rest[at], size[at]), size[at])
        owner, at, n = owner[n > 0], at[n > 0], n[n > 0]
        begin = self.bucket.start[owner] + self.j[at]
        return self.bucket.chunk[owner], self.bucket.row[owner], begin, begin + n

    def rows(self) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
        """Length, text and occurrences (id, start) of each group that two documents or places are in."""
        for a, b, d in zip(self.first.tolist(), self.last.tolist(), self.depth.tolist(), strict=True):
            owner, which = self._owners(np.arange(a, b + 1))
            at = self.bucket.start[owner] + self.j[a + which]
            yield d, self.buf[self.begin[a] :][:d].tobytes(), list(zip(self.bucket.id[owner].tolist(), at.tolist(), strict=True))


# ---- blocks ----------------------------------------------------------------------------------------


def _pack(key, ids, row, start, size, left, text: bytes) -> bytes:
    n = np.array([len(key)], "<i8").tobytes()
    return _zip(n + b"".join(x.astype(t).tobytes() for x, t in ((key & _U(0xFFFFFFFF), "<u4"), (ids, "<i8"), (row, "<i4"), (start, "<i4"), (size, "<i4"), (left, "<i2"))) + text)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = _unzip(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for t, w in (("<u4", 4), ("<i8", 8), ("<i4", 4), ("<i4", 4), ("<i4", 4), ("<i2", 2)):
        x = np.frombuffer(raw, t, n, at)
        out.append(x if w == 8 else x.astype(np.int64))
        at += n * w
    return [*out, np.frombuffer(raw, np.uint8, -1, at)]


def _extra(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return _zip(sink.getvalue().to_pybytes())


def chunked(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """chunk, ids, sizes, digests, text, extra: blocks of about CHUNK_BYTES of documents, stored; extra holds the columns `keep`."""
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"extra_{i}") for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, "text", CHUNK_BYTES):
            raw = part.raw()
            column = part.batch.column(0)
            ids = column.fill_null(np.iinfo(np.int64).min).to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([number], pa.int64()),
                    "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                    "sizes": pa.array([np.diff(part.offs).astype("<i4").tobytes()], pa.binary()),
                    "digests": pa.array([b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in raw)], pa.binary()),
                    "text": pa.array([_zip(part.buf.tobytes())], pa.binary()),
                    "extra": pa.array([_extra(part.batch.select(list(range(2, part.batch.num_columns)))) if keep else None], pa.binary()),
                }
            )
            number += 1

    return stash(arrow_map(src, run, "chunk bigint, ids binary, sizes binary, digests binary, text binary, extra binary"), "chunks", by_partition=True)


def _by_chunk(chunks: DataFrame) -> GroupedData:
    """The chunks for a cogroup: always the same columns, so that Spark shuffles the texts once for all cogroups of one query."""
    return chunks.select("chunk", "ids", "sizes", "text", "extra").groupBy("chunk")


def _null_ids(ids: np.ndarray) -> np.ndarray:
    return ids == np.iinfo(np.int64).min


def copies(chunks: DataFrame, length: int) -> DataFrame:
    """chunk, rows (binary int32): the documents that equal one with a smaller id."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ids, sizes, digests in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i4")
                d = np.frombuffer(digests, "<i8").reshape(-1, 2)
                keep = np.flatnonzero((sizes >= length) & ~_null_ids(ids))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(keep), chunk)), "row": pa.array(keep.astype(np.int32)), "id": pa.array(ids[keep]), "h1": pa.array(d[keep, 0]), "h2": pa.array(d[keep, 1])})

    rows = arrow_map(chunks.select("chunk", "ids", "sizes", "digests"), listed, "chunk bigint, row int, id bigint, h1 bigint, h2 bigint")
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h1", "h2", "low")
    return rows.join(first, ["h1", "h2"]).where("id > low").groupBy("chunk").agg(F.collect_list("row").alias("rows"))


def _texts(sizes: bytes, text: bytes, whole: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a chunk (its compressed text, or its bytes): number of the first row, bytes, offsets."""
    size = np.frombuffer(sizes, "<i4").astype(np.int64)
    buf = np.frombuffer(_unzip(text), np.uint8) if whole is None else whole
    offs = np.r_[0, np.cumsum(size)]
    at = 0
    while at < len(size):
        to = min(len(size), max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE, "right")) - 1))
        yield at, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def _split(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and where each bucket begins and ends in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def shared_minimisers(chunks: DataFrame, length: int, k: int, buckets: int, hot: int = HOT) -> DataFrame:
    """chunk, bucket, keys, hot: per chunk, the minimisers (32 bits within the bucket) that another document has too, and as bits which of them more than `hot` chunks have."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, sizes, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys = []
                for _, buf, offs in _texts(sizes, text):
                    s = Strings(buf, offs, length, k)
                    keys.append(_distinct(s.key, s.row))
                key = np.sort(np.concatenate(keys)) if keys else np.empty(0, _U)
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
                many = np.diff(np.r_[new, len(key)]) > 1
                key = key[new]
                order, edge = _split(_bucket(key, buckets), buckets)
                low = (key & _U(0xFFFFFFFF)).astype("<u4")[order]
                many = many[order]
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(full.astype(np.int32)),
                        "chunk": pa.array(np.full(len(full), chunk)),
                        "keys": pa.array([low[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary()),
                        "many": pa.array([np.packbits(many[edge[i] : edge[i + 1]]).tobytes() for i in full], pa.binary()),
                    }
                )

    def meet(table: pa.Table) -> pa.Table:
        keys = table["keys"]
        every = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in keys]))
        new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        every, chunks_with = every[new], np.diff(np.r_[new, len(every)])
        shared = chunks_with > 1
        for x, m in zip(keys, table["many"], strict=True):
            r = np.frombuffer(x.as_buffer(), "<u4")
            shared[np.searchsorted(every, r[np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=len(r)).astype(bool)])] = True
        often = chunks_with > hot
        out, bits = [], []
        for x in keys:
            r = np.frombuffer(x.as_buffer(), "<u4")
            at = np.searchsorted(every, r)
            at, r = at[shared[at]], r[shared[at]]
            out.append(r.tobytes())
            bits.append(np.packbits(often[at]).tobytes())
        release()
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "keys": pa.array(out, pa.binary()), "hot": pa.array(bits, pa.binary())})

    posted = arrow_map(chunks.select("chunk", "sizes", "text"), post, "bucket int, chunk bigint, keys binary, many binary")
    return posted.groupBy("bucket").applyInArrow(meet, "chunk bigint, bucket int, keys binary, hot binary").where("length(keys) > 0")


def _distinct(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A key once for each row that has it."""
    o = np.lexsort([row, key])
    k, r = key[o], row[o]
    return k[np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]] if len(k) else k


SENT = "bucket int, chunk bigint, blob binary"


def strings_with(chunks: DataFrame, shared: DataFrame, copied: DataFrame, length: int, k: int, buckets: int, every: bool = False) -> DataFrame:
    """SENT: strings for the buckets; negative ones, one for each chunk, have spans that the chunk itself has found. With `every`, equal strings of a chunk all travel."""
    notes = shared.select("chunk", "bucket", "keys", "hot", F.lit(None).cast("array<int>").alias("rows")).union(copied.select("chunk", F.lit(-1), F.lit(None).cast("binary"), F.lit(None).cast("binary"), "rows"))

    def known_of(notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, hot = [], []
        for b, x, h in zip(notes["bucket"].to_pylist(), notes["keys"], notes["hot"], strict=True):
            if b >= 0:
                keys.append((np.uint64(b) << _U(32)) | np.frombuffer(x.as_buffer(), "<u4").astype(_U))
                hot.append(np.unpackbits(np.frombuffer(h.as_buffer(), np.uint8), count=len(keys[-1])).astype(bool))
        if not keys:
            return np.empty(0, _U), np.empty(0, bool)
        key = np.concatenate(keys)
        order = np.argsort(key)
        return key[order], np.concatenate(hot)[order]

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        rows: dict[str, list] = {"bucket": [], "chunk": [], "blob": []}
        known, hot = known_of(right) if left.num_rows else (np.empty(0, _U), None)
        if len(known):
            ids = np.frombuffer(left["ids"][0].as_py(), "<i8")
            out = _null_ids(ids)
            out[[x for y in right["rows"].to_pylist() if y for x in y]] = True
            sizes, raw = left["sizes"][0].as_py(), left["text"][0].as_py()
            whole = np.frombuffer(_unzip(raw), np.uint8)
            begin = np.r_[0, np.cumsum(np.frombuffer(sizes, "<i4").astype(np.int64))]
            got = []
            for first, buf, offs in _texts(sizes, raw, whole):
                s = Strings(buf, offs, length, k)
                mark = (_bucket(s.key, buckets).astype(_U) << _U(32)) | (s.key & _U(0xFFFFFFFF))
                at = np.minimum(np.searchsorted(known, mark), len(known) - 1)
                take = np.flatnonzero((known[at] == mark) & ~out[s.row + first])
                if len(take):
                    s = s.take(take).told_apart(hot[at[take]])
                    got.append((s.key, s.row + first, s.start + begin[first], s.end - s.start, span_hashes(buf, s.start, s.end, fold=False)))
            if got:
                mini, row, at, size, h = (np.concatenate([g[i] for g in got]) for i in range(5))
                del got
                owner, start = ids[row], at - begin[row]
                before = np.where(start > 0, whole[np.maximum(at - 1, 0)].astype(np.int16), np.int16(256))
                later = np.zeros(len(row), bool)
                if not every:
                    text = equal_strings(h, at, size, whole)
                    o = np.lexsort([owner, text])
                    new = np.r_[True, text[o][1:] != text[o][:-1]]
                    later[o] = owner[o] > owner[o][np.flatnonzero(new)][np.cumsum(new) - 1]
                    if later.any():
                        rows["bucket"].append(-1 - (chunk ^ chunk >> 32) % (1 << 30))
                        rows["chunk"].append(chunk)
                        rows["blob"].append(np.c_[row, start, start + size][later].astype("<i4").tobytes())
                keep = np.flatnonzero(~later)
                order, edge = _split(_bucket(mini[keep], buckets), buckets)
                keep = keep[order]
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    p = keep[edge[i] : edge[i + 1]]
                    n = size[p]
                    text = whole[np.repeat(at[p] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                    rows["bucket"].append(i)
                    rows["chunk"].append(chunk)
                    rows["blob"].append(_pack(mini[p], owner[p], row[p], start[p], n, before[p], text.tobytes()))
        release()
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array(rows["chunk"], pa.int64()), "blob": pa.array(rows["blob"], pa.binary())})

    return _by_chunk(chunks).cogroup(notes.groupBy("chunk")).applyInArrow(send, SENT)


def _bucket_spans(sent: DataFrame, length: int) -> DataFrame:
    """chunk, spans: what every bucket's groups of repeats, and every chunk by itself, say to remove."""

    def scan(key, table):
        if key[0].as_py() < 0:
            return pa.table({"chunk": table["chunk"], "spans": table["blob"]})
        bucket = Bucket(table)
        parts = [g.lost() for g in bucket.scan(length)]
        del bucket
        chunk, row, a, b = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(4))
        o = np.argsort(chunk, kind="stable")
        chunk, spans = chunk[o], np.c_[row, a, b][o].astype("<i4")
        cut = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(chunk) else np.zeros(1, np.int64)
        release()
        return pa.table({"chunk": pa.array(chunk[cut[:-1]]), "spans": pa.array([spans[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(scan, "chunk bigint, spans binary")


def merged(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row joined where they overlap or touch, in order."""
    if not len(row):
        return row, a, b
    o = np.lexsort([a, row])
    row, a, b = row[o], a[o], b[o]
    far = row * (1 << 33)  # rows do not touch
    top = np.maximum.accumulate(b + far)
    new = np.flatnonzero(np.r_[True, (a + far)[1:] > top[:-1]])
    last = np.r_[new[1:], len(row)] - 1
    return row[new], a[new], top[last] - far[last]


def _buckets(chunks: DataFrame) -> int:
    return max(8, -(-chunks.count() * CHUNK_BYTES // BUCKET_BYTES))


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, with_text also kept (binary), and the columns `keep`, of every row.

    Every byte is removed that a string of `length` bytes covers which also starts in a document with a smaller id: the
    occurrences, in later documents, of the tree's groups of repeats.
    """
    chunks = chunked(docs, id_col, text_col, keep)
    buckets = _buckets(chunks)
    copied = stash(copies(chunks, length), "copies")
    shared = shared_minimisers(chunks, length, k, buckets)
    sent = strings_with(chunks, shared, copied, length, k, buckets)
    spans = _bucket_spans(sent, length)
    notes = spans.select("chunk", "spans", F.lit(None).cast("array<int>").alias("rows")).union(copied.select("chunk", F.lit(None).cast("binary"), "rows"))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def apply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in names}
        release()
        if left.num_rows:
            ids, size = np.frombuffer(left["ids"][0].as_py(), "<i8"), np.frombuffer(left["sizes"][0].as_py(), "<i4").astype(np.int64)
            text = memoryview(_unzip(left["text"][0].as_py()))
            offs = np.r_[0, np.cumsum(size)]
            own = [np.frombuffer(x, "<i4").reshape(-1, 3).astype(np.int64) for x in right["spans"].to_pylist() if x]
            copy = np.array([x for y in right["rows"].to_pylist() if y for x in y], np.int64)
            own.append(np.c_[copy, np.zeros_like(copy), size[copy]])
            every = np.concatenate(own)
            row, a, b = merged(every[:, 0], every[:, 1], every[:, 2])
            cut = np.searchsorted(row, np.arange(len(ids) + 1))
            for i in range(len(ids)):
                at, base, removed = 0, int(offs[i]), 0
                h, kept = hashlib.sha256(), []
                for x, y in zip(a[cut[i] : cut[i + 1]].tolist(), b[cut[i] : cut[i + 1]].tolist(), strict=True):
                    kept.append(text[base + at : base + x])
                    removed += y - x
                    at = y
                kept.append(text[base + at : base + int(size[i])])
                for piece in kept:
                    h.update(piece)
                out[id_col].append(None if ids[i] == np.iinfo(np.int64).min else int(ids[i]))
                out["n_bytes"].append(int(size[i]))
                out["n_removed"].append(removed)
                out["n_spans"].append(int(cut[i + 1] - cut[i]))
                out["kept_sha256"].append(h.hexdigest())
                if with_text:
                    out["kept"].append(b"".join(kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        table = pa.table({n: pa.array(out[n], t) for n, t in zip(names, types, strict=False)})
        if keep:
            more = pa.ipc.open_stream(_unzip(left["extra"][0].as_py())).read_all() if left.num_rows else extra_schema.empty_table()
            for name, column in zip(keep, more.columns, strict=True):
                table = table.append_column(name, column)
        return table

    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    extra_schema = to_arrow_schema(docs.select(*keep).schema) if keep else None
    return _by_chunk(chunks).cogroup(notes.groupBy("chunk")).applyInArrow(apply, schema)


def maximal_repeats(docs: DataFrame, length: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """size, occurrences array<struct<id, start>> (in order), text (binary): the maximal repeats of `length` bytes and more with all their occurrences.

    Groups of the bucket trees whose occurrences stand at the same distances from each other are parts of one repeat and
    are joined where they overlap. Where a part of a repeat occurs more often than the whole, the repeat is given in
    pieces around it, and the part as a repeat of its own. Occurrences inside whole copies of a document are
    those of its first copy. Rows with a null id give none. The text is that of the first part of up to `length` bytes and
    more; size and the first occurrence give the whole.
    """
    chunks = chunked(docs, id_col, text_col)
    buckets = _buckets(chunks)
    shared = shared_minimisers(chunks, length, k, buckets)
    copied = stash(copies(chunks, length), "copies")
    sent = strings_with(chunks, shared, copied, length, k, buckets, every=True)
    place = pa.struct([("id", pa.int64()), ("start", pa.int64())])

    def scan(table: pa.Table) -> pa.Table:
        rows = [r for g in Bucket(table).scan(length) for r in g.rows()]
        out: dict[str, list] = {"size": [], "occurrences": [], "text": [], "first": [], "shape": []}
        for d, text, found in rows:
            found.sort()
            i0, p0 = found[0]
            # the same documents at the same distances: one shape, whatever the part of the repeat
            shape = hashlib.blake2b(np.array([x for i, p in found for x in (i, p - p0)], "<i8").tobytes(), digest_size=16).digest()
            for name, v in zip(out, (d, [{"id": i, "start": p} for i, p in found], text, i0, shape), strict=True):
                out[name].append(v)
        release()
        types = (pa.int64(), pa.list_(place), pa.binary(), pa.int64(), pa.binary())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types, strict=True)})

    groups = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(scan, "size bigint, occurrences array<struct<id: bigint, start: bigint>>, text binary, first bigint, shape binary")
    start = F.element_at("occurrences", 1)["start"]
    alike = Window.partitionBy("first", "shape").orderBy("at", F.desc("size"))
    reach = F.max(F.col("at") + F.col("size")).over(alike.rowsBetween(Window.unboundedPreceding, -1))
    # parts of one repeat overlap by length - 1 bytes at least: their windows follow each other
    run = groups.withColumn("at", start).withColumn("new", F.when(F.col("at") > reach - length + 1, 1).when(reach.isNull(), 1).otherwise(0)).withColumn("run", F.sum("new").over(alike))
    return run.groupBy("first", "shape", "run").agg((F.max(F.col("at") + F.col("size")) - F.min("at")).alias("size"), F.min_by("occurrences", "at").alias("occurrences"), F.min_by("text", "at").alias("text")).select("size", "occurrences", "text")
