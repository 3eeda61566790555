"""Alignment of two tokenizers' tokens over the bytes that both cover.

A space and the text are encoded by a byte-level BPE vocabulary (A, the tokenizers library) and by a piece vocabulary with
byte fallback (B, the sentencepiece library, which adds that space itself). Both sides' token ends are running sums of
byte lengths; offsets where tokens of both end cut the bytes into groups, and every A token of a group is linked
with every B token of it. A pair of ids counts in how many documents it is linked at all.

Documents are gathered into packs of some MB. A pack knows its distinct pairs, which are summed over the corpus in two
shuffles, by pair and salt and then by pair; each pack gets the sums of its own pairs back, one row for each, so no task and
no broadcast holds the corpus's pairs. The highest sum of each A id is a table bounded by A's vocabulary. Links
that are not expanded (groups of many tokens) are counted by distinct ids, so a run on which the two never agree costs no square.

Null and empty texts, and texts whose tokens' bytes are not the text's (one that holds U+2581, which B turns into a space), have no
tokens: zeros, and '' as digest. Rows are treated one by one: a repeated row is a document of its own, ids may be null
and of any type. A table without rows gives none. Columns other than the id and the text are not read, whatever their names.
Strings of special tokens inside texts are plain text. A long text is worked on in parts that end where both tokenizers cut.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, bounded_memory, record, release, stash, text_slices

#: Bytes of text in a pack, and ids of A that are aligned at once.
PACK_BYTES, PART_IDS = 16 << 20, 1 << 19
#: Links of a group that are expanded one by one; of more, distinct ids are counted.
EXPANDED = 1 << 12
#: Strings whose ids a worker keeps (twice as many at most), and the longest of them.
MOST_STRINGS, LONGEST = 200_000, 48
#: A text of more characters is worked on in parts of so many.
LONG = 1 << 20
#: Shares that the rows of a pair are dealt to before they are summed.
SALTS = 8
#: The mark that stands for a space in B's pieces (fixed value).
MARK = "▁"
#: White space as Unicode has it (fixed values), without space and line feed.
_OTHER = "\t\x0b-\r\x85\xa0  -     　"
_STRINGS = re.compile(f"[ \n{_OTHER}]*[^ \n{_OTHER}]+(?:[{_OTHER}][ \n{_OTHER}]*[^ \n{_OTHER}]*)*|[ \n{_OTHER}]+")
_CROSSES = re.compile(f"[^{MARK}]{MARK}|\n")


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TwoTokenizers(dict):
    """Strings to their ids on both sides (little-endian unsigned 32-bit), or None where their bytes are not the string's.

    A text is cut before a space or line feed that follows something else than white space. A's pattern never joins over such a
    place, and B's merges do not where no piece holds a mark after another character, or a line feed; a vocabulary that has such pieces encodes whole texts.
    """

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        n_a = max(self.a.get_vocab().values(), default=-1) + 1
        self.bytes_a = [b""] * n_a
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n_b = self.b.vocab_size()
        pieces = self.b.id_to_piece(list(range(n_b)))
        as_byte = [self.b.is_byte(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace(MARK, " ").encode() for p, byte in zip(pieces, as_byte, strict=True)]
        self.mark = np.asarray([self.b.piece_to_id(MARK)], "<u4").tobytes()
        real = [p for i, p in enumerate(pieces) if not (as_byte[i] or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = not any(_CROSSES.search(p) for p in real)
        # without a normaliser, and with a letter for every byte, A's ids always have the bytes of the text
        self.true_a = self.a.normalizer is None and set(letters) <= set(self.a.get_vocab())
        self.len_a, self.len_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.older: dict = {}
        self.long: list[str] = []

    def _whole(self, s: str) -> tuple[bytes, bytes] | None:
        return self._checked(s, self.a.encode(s, add_special_tokens=False).ids, self.b.encode(s[1:]))

    def _checked(self, s: str, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        raw = s.encode()
        if b"".join([self.bytes_b[i] for i in b]) != raw or not self.true_a and b"".join([self.bytes_a[i] for i in a]) != raw:
            return None
        return array("I", a).tobytes(), array("I", b).tobytes()

    def _of_b(self, strings: list[str]) -> list[list[int]]:
        """B gives a leading space itself; before a line feed that mark is a token of its own, and goes."""
        ids = self.b.encode([s[1:] if s[0] == " " else s for s in strings], num_threads=1)
        lone = np.frombuffer(self.mark, "<u4").tolist()
        return [lone if s == " " else x if s[0] == " " else x[1:] for s, x in zip(strings, ids, strict=True)]

    def _learn(self, strings: list[str]) -> None:
        """Makes the strings known; those too long to keep go with the next call. Libraries are asked for many at once, as each call costs."""
        for s in self.long:
            self.pop(s, None)
        if len(self) > MOST_STRINGS:
            self.older = dict(self)
            self.clear()
        new = []
        for s in set(strings):
            if s not in self:
                if s in self.older:
                    self[s] = self.older[s]
                else:
                    new.append(s)
        if new:
            of_a = self.a.encode_batch_fast(new, add_special_tokens=False)
            for s, a, b in zip(new, of_a, self._of_b(new), strict=True):
                self[s] = self._checked(s, a.ids, b)
        self.long = [s for s in new if len(s) > LONGEST]

    def texts(self, texts: list[str | None]) -> Iterator[Iterator[tuple[bytes, bytes] | None]]:
        """Each text's ids as parts() gives them; a batch's new strings are learnt together."""
        split = [_STRINGS.findall(" " + t) if t and len(t) < LONG and self._cuttable(t) else None for t in texts]
        self._learn([s for strings in split if strings for s in strings])
        for t, strings in zip(texts, split, strict=True):
            if strings is None:
                yield self.parts(t)
                if t and self._cuttable(t):  # a long text's strings may have pushed out those of the others
                    self._learn([s for strings in split if strings for s in strings])
            else:
                got = list(map(self.__getitem__, strings))
                yield iter([self._whole(" " + t)] if None in got else [self._joined(got)])

    def _cuttable(self, text: str) -> bool:
        return self.cuts and MARK not in text

    @staticmethod
    def _joined(got: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        return b"".join([x[0] for x in got]), b"".join([x[1] for x in got])

    def parts(self, text: str | None) -> Iterator[tuple[bytes, bytes] | None]:
        """The ids of a space and text, in parts that end at a common cut; a single None if the text has no tokens."""
        if not text:
            yield None
            return
        s = " " + text
        if not self._cuttable(text) or not self._true(s):
            yield self._whole(s)
            return
        for strings in self._strings(s):
            self._learn(strings)
            yield self._joined(list(map(self.__getitem__, strings)))

    def _true(self, s: str) -> bool:
        """Whether all strings of a text have their own bytes, so that parts of it can be given out."""
        for strings in self._strings(s):
            self._learn(strings)
            if any(self[x] is None for x in strings):
                return False
        return True

    def _strings(self, s: str) -> Iterator[list[str]]:
        held, size = [], 0
        for m in _STRINGS.finditer(s):
            held.append(m.group())
            size += len(held[-1])
            if size >= LONG:
                yield held
                held, size = [], 0
        if held:
            yield held


_known: dict[tuple[str, str], TwoTokenizers] = {}


def two_tokenizers(a_path: str, b_path: str) -> TwoTokenizers:
    """Of a worker, made once."""
    if (a_path, b_path) not in _known:
        _known[a_path, b_path] = TwoTokenizers(a_path, b_path)
    return _known[a_path, b_path]


def groups(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of token lengths in bytes on both sides of the same bytes: the group of each A and of each B token, and how many groups there are."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    return np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), len(cuts)


def links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """group, A id, B id, times of linked tokens: a row for each pair of occurrences, in groups of over EXPANDED links for each pair of ids."""
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    first_b = np.cumsum(nb) - nb
    wide = na * nb > EXPANDED
    small = ~wide[ga] if wide.any() else slice(None)
    g, ids = ga[small], a[small]
    times = nb[g]
    ib = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b[g], times)
    out = [[np.repeat(g, times)], [np.repeat(ids, times)], [b[ib]], [np.ones(len(ib), np.int64)]]
    first_a = np.cumsum(na) - na
    for w in np.flatnonzero(wide).tolist():
        ua, ca = np.unique(a[first_a[w] : first_a[w] + na[w]], return_counts=True)
        ub, cb = np.unique(b[first_b[w] : first_b[w] + nb[w]], return_counts=True)
        for col, x in zip(out, (np.full(len(ua) * len(ub), w), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.repeat(ca, len(ub)) * np.tile(cb, len(ua))), strict=True):
            col.append(x)
    return tuple(np.concatenate(x) for x in out)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each number below n, left-aligned in a row of bytes, and how many there are."""
    width = len(str(max(0, n - 1)))
    text = np.arange(n).astype(f"S{width}")
    return text.view(np.uint8).reshape(n, width), np.char.str_len(text).astype(np.int64)


class _Spelling:
    """Aligned ids as text: `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, n_a: int, n_b: int):
        n = max(n_a, n_b, 1)
        self.digits, self.size = _decimals(n)

    def text(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, `;` after every group, and how many bytes each group has."""
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        at_a, at_b = np.arange(len(a)) + before_b[ga], np.arange(len(b)) + (before_a + na)[gb]
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        after = np.full(len(ids), ord(","), np.uint8)
        last_a = before_a + na - 1
        after[at_a[last_a]] = ord("|")
        after[at_b[before_b + nb - 1]] = ord(";")
        width = self.digits.shape[1]
        cells = np.zeros((len(ids), width + 1), np.uint8)
        cells[:, :width] = self.digits[ids]
        sizes = self.size[ids]
        cells[np.arange(len(ids)), sizes] = after
        group = np.empty(len(ids), np.int64)
        group[at_a], group[at_b] = ga, gb
        return cells[cells != 0], np.bincount(group, weights=sizes + 1, minlength=n).astype(np.int64)


class _Pack:
    """Documents' numbers, digests and distinct pairs until a pack is full."""

    def __init__(self, coder: TwoTokenizers):
        self.coder, self.n_b = coder, len(coder.bytes_b)
        self.spelling = _Spelling(len(coder.bytes_a), self.n_b)
        self.clear()

    def clear(self) -> None:
        self.numbers: list[list[int]] = []  # n_a, n_b, n_groups, n_links of each document
        self.hashes: list = []
        self.pairs: list[np.ndarray] = []  # document << 32 | A id * B's ids + B id
        self.times: list[np.ndarray] = []
        self.size = 0
        self._part()

    def _part(self) -> None:
        self.held: list[tuple[int, bytes, bytes]] = []
        self.held_ids = 0

    def add(self, text: str | None, parts: Iterator[tuple[bytes, bytes] | None]) -> None:
        doc = len(self.numbers)
        self.numbers.append([0, 0, 0, 0])
        self.hashes.append(None)
        self.size += len(text or "")
        for part in parts:
            if part is not None:
                self.held.append((doc, *part))
                self.held_ids += len(part[0]) // 4
                if self.held_ids >= PART_IDS:
                    self.align()

    def align(self) -> None:
        """What is held, at once: every document's part begins and ends at a cut of its own."""
        if not self.held:
            return
        docs = np.array([d for d, _, _ in self.held])
        a, b = (np.frombuffer(b"".join([h[i] for h in self.held]), "<u4").astype(np.int64) for i in (1, 2))
        size_a, size_b = (np.array([len(h[i]) // 4 for h in self.held]) for i in (1, 2))
        ga, gb, n = groups(self.coder.len_a[a], self.coder.len_b[b])
        last = ga[np.cumsum(size_a) - 1]  # the last group of each part
        n_groups = np.diff(last, prepend=-1)
        doc_of = np.repeat(docs, n_groups)
        group, la, lb, times = links(a, b, ga, gb, n)
        per_group = np.bincount(ga, minlength=n) * np.bincount(gb, minlength=n)
        n_links = np.add.reduceat(per_group, last - n_groups + 1)
        key = doc_of[group] << 32 | (la * self.n_b + lb)
        if len(times) and times.max() > 1:
            o = np.argsort(key, kind="stable")
            key, times = key[o], times[o]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            self.times.append(np.add.reduceat(times, first))
        else:
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            self.times.append(np.diff(first, append=len(key)))
        self.pairs.append(key[first])
        raw, bytes_of = self.spelling.text(a, b, ga, gb, n)
        ends = np.cumsum(bytes_of)[last]
        at = 0
        for k, d in enumerate(docs.tolist()):
            x = self.numbers[d]
            for i, v in enumerate((size_a[k], size_b[k], n_groups[k], n_links[k])):
                x[i] += int(v)
            if self.hashes[d] is None:
                self.hashes[d] = hashlib.sha256()
            else:
                self.hashes[d].update(b";")
            self.hashes[d].update(raw[at : ends[k] - 1].data)
            at = int(ends[k])
        self._part()

    def finish(self) -> tuple[np.ndarray, list[str], bytes, bytes]:
        """Numbers and digests of the documents, their pairs, and the pack's distinct pairs with their documents."""
        self.align()
        numbers = np.array(self.numbers, np.int64).reshape(-1, 4)
        digests = ["" if h is None else h.hexdigest() for h in self.hashes]
        key, times = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.pairs, self.times))
        if len(key) and (np.diff(key) <= 0).any():  # a document in several parts
            o = np.argsort(key, kind="stable")
            key, times = key[o], times[o]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, times = key[first], np.add.reduceat(times, first)
        doc, pair = key >> 32, key & 0xFFFFFFFF
        distinct, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
        per_doc = np.bincount(doc, minlength=len(numbers))
        return numbers, digests, _pack(per_doc, place, times), _pack(distinct, docs)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte by byte in planes so that small ones cost little."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    head = np.array([len(columns), *(len(c) for c in columns)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    sizes = raw[8 : 8 + 8 * n].view("<u8").tolist()
    out, at = [], 8 + 8 * n
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, -1).T).view("<i8").ravel())
        at += 8 * size
    return out


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_SUMS = pa.schema([("pack", pa.int64()), ("pair", pa.int64()), ("docs", pa.int64())])


def packs(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each pack of documents, its columns lists: ids, n_a, n_b, n_groups, n_links, groups_sha256; their links, and the pack's pairs."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    id_type = to_arrow_schema(src.schema).field(0).type
    out = pa.schema([("pack", pa.int64()), ("id", pa.list_(id_type)), *((n, pa.list_(pa.int64())) for n in _NUMBERS), ("groups_sha256", pa.list_(pa.string())), ("links", pa.binary()), ("pairs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        pack, ids = _Pack(two_tokenizers(a_path, b_path)), []

        def full() -> pa.RecordBatch:
            numbers, digests, linked, pairs = pack.finish()
            one = lambda x, t: pa.array([x], pa.list_(t))
            got = record(out, [number], pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), pa.concat_arrays(ids)), *(one(numbers[:, i].tolist(), pa.int64()) for i in range(4)), one(digests, pa.string()), [linked], [pairs])
            pack.clear()
            return got

        for part in text_slices(batches, "text"):
            ids.append(part.batch.column(0).cast(id_type))
            texts = part.batch.column(1).to_pylist()
            for t, found in zip(texts, pack.coder.texts(texts), strict=True):
                pack.add(t, found)
            if pack.size >= PACK_BYTES:
                yield full()
                ids, number = [], number + 1
        if ids:
            yield full()

    return arrow_map(src, run, f"pack bigint, id array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, links binary, pairs binary")


def _pack_pairs(packed: DataFrame) -> DataFrame:
    """pack, pair, docs: how many documents of a pack hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pair, docs = _unpack(data)
                for at in range(0, len(pair), 1 << 16):
                    p = pair[at : at + (1 << 16)]
                    yield record(_SUMS, np.full(len(p), pack), p, docs[at : at + (1 << 16)])

    return arrow_map(packed.select("pack", "pairs"), run, "pack bigint, pair bigint, docs bigint")


def pair_counts(packed: DataFrame) -> DataFrame:
    """pair, docs: in how many documents of the corpus a pair is linked. Summed in two shuffles, so a pair that all packs hold is dealt out."""
    shares = _pack_pairs(packed).withColumn("salt", F.pmod(F.xxhash64("pack"), F.lit(SALTS)))
    return shares.groupBy("pair", "salt").agg(F.sum("docs").alias("docs")).groupBy("pair").agg(F.sum("docs").alias("docs"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    n_best: links whose pair's count is the highest of its A id; count_sum: the counts of all links, summed.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    packed = stash(packs(docs, a_path, b_path, id_col, text_col), "packs", by_partition=True)
    counts = stash(pair_counts(packed), "pairs")
    a_of = F.floor(F.col("pair") / n_b)
    best = counts.groupBy(a_of.alias("a")).agg(F.max("docs").alias("most"))  # a row for each id of A at most
    rated = counts.join(F.broadcast(best), a_of == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    back = _pack_pairs(packed).select("pack", "pair").join(rated, "pair").select("pack", "pair", "docs", "best")
    kind = packed.schema["id"].dataType.elementType.simpleString()
    id_type = to_arrow_schema(packed.schema).field("id").type.value_type
    out = pa.schema([(id_col, id_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        of, order = right["pair"].to_numpy(), None
        order = np.argsort(of)
        docs_of, best_of = right["docs"].to_numpy()[order], right["best"].to_numpy()[order]
        for row in range(left.num_rows):
            lists = {c: left[c].chunk(0) if left[c].num_chunks == 1 else left[c].combine_chunks() for c in ("id", *_NUMBERS, "groups_sha256", "links")}
            per_doc, place, times = _unpack(lists["links"][row].as_py())
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            total, hit = np.zeros((2, len(per_doc)), np.int64)
            np.add.at(total, doc, times * docs_of[place])
            np.add.at(hit, doc, times * best_of[place])
            parts.append(pa.Table.from_arrays([lists["id"][row].values, *(lists[n][row].values for n in _NUMBERS), pa.array(hit), pa.array(total), lists["groups_sha256"][row].values], schema=out))
        release()
        return pa.concat_tables(parts) if parts else out.empty_table()

    bounded_memory(docs.sparkSession)
    return packed.drop("pairs").groupBy("pack").cogroup(back.groupBy("pack")).applyInArrow(run, f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
