"""Byte-level BPE encoding and decoding with the tiktoken library.

Long texts are split by a regular expression at boundaries that no match of the vocabulary's pattern can
cross, so the pieces' ids, joined, are the whole text's ids; pieces that repeat are encoded once.
A null text is an empty text: no ids, zero tokens. Rows are treated one by one: repeated rows repeat. A table without
rows gives none. Ids may be of any type and null. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, record, text_slices

#: Letters, digits, spaces and marks whose classes are plain (fixed values: no letter outside Latin-1, no apostrophe).
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_UNPLAIN = re.compile(f"[^{_LETTERS}0-9 \n{_MARKS}]")
_PIECES = re.compile(f"[ \n]*(?:[{_LETTERS}]+|[0-9]+|[{_MARKS}]+)|[ \n]+")
#: White space beside space and line feed: with it a text is not cut.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_CHUNKS = re.compile("[ \n]*[^ \n]+|[ \n]+")

#: A worker knows at most twice so many pieces (the second number where an encoder is slow); longer ones than LONGEST are not kept.
MOST_PIECES, MANY_PIECES, LONGEST = 80_000, 500_000, 64


def safe_pieces(text: str) -> list[str]:
    """text in pieces that the pattern `'s|'t|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` never joins.

    A piece ends where a letter, digit or mark run meets another kind or white space; white space leads
    the piece after it, so what `\\s+(?!\\S)` looks ahead to stays in sight. Texts with unusual characters
    are cut before white space only, or not at all when they hold white space of other kinds.
    """
    if not _UNPLAIN.search(text):
        return _PIECES.findall(text)
    return [text] if _OTHER_SPACE.search(text) else _CHUNKS.findall(text)


class PieceCoder(dict):
    """Pieces to their ids as little-endian unsigned 32-bit integers, encoded when first asked for.

    Two generations: once this one is full it becomes the older, whose pieces come back when they are asked for.
    """

    def __init__(self, encode_many, most: int = MOST_PIECES):
        self.encode_many, self.older, self.most = encode_many, {}, most

    def ids(self, text: str) -> bytes:
        pieces = safe_pieces(text)
        try:
            return b"".join(map(self.__getitem__, pieces))
        except KeyError:
            pass
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new = []
        for p in set(pieces):
            if p not in self:
                known = self.older.get(p)
                if known is None:
                    new.append(p)
                else:
                    self[p] = known
        once = {}
        for piece, ids in zip(new, self.encode_many(new), strict=True):
            (self if len(piece) <= LONGEST else once)[piece] = np.asarray(ids, "<u4").tobytes()
        if not once:
            return b"".join(map(self.__getitem__, pieces))
        return b"".join([once[p] if p in once else self[p] for p in pieces])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_coders: dict[tuple[str, str], tuple] = {}


def tiktoken_coder(ranks_path: str, pattern: str):
    """(encoding, coder) of a worker, made once."""
    key = (ranks_path, pattern)
    if key not in _coders:
        import tiktoken

        e = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        _coders[key] = e, PieceCoder(lambda pieces: [e.encode_ordinary(p) for p in pieces])
    return _coders[key]


def _empty_safe(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>: the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coder = tiktoken_coder(ranks_path, pattern)
        for part in text_slices(batches, text_col):
            ids = [coder.ids(t) for t in _empty_safe(part.batch, text_col)]
            offs = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=[id_col, "ids"])

    src = docs.select(id_col, text_col)
    return arrow_map(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, bytes binary: the raw bytes that the ids stand for; they need not be valid UTF-8. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, _ = tiktoken_coder(ranks_path, pattern)
        for b in batches:
            out = [None if x is None else e.decode_bytes(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    src = encoded.select(id_col, ids_col)
    return arrow_map(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: encodes each text, decodes its ids and digests both in one pass."""
    src = docs.select(id_col, text_col)
    id_type = to_arrow_schema(src.schema).field(0).type
    out = pa.schema([(id_col, id_type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, coder = tiktoken_coder(ranks_path, pattern)
        for part in text_slices(batches, text_col):
            n, ids_hex, text_hex = [], [], []
            for t in _empty_safe(part.batch, text_col):
                ids = coder.ids(t)
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(e.decode_bytes(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield record(out, part.batch.column(0), n, ids_hex, text_hex)

    return arrow_map(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
