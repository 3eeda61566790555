"""Language identification by prediction by partial matching.

For every language a variable-order context tree over bytes counts which byte follows each context of 0 to
`order` bytes. Escape probabilities are those of method C (distinct followers over total plus distinct, no
exclusions); contexts of all orders are frozen after training. The code length of a text under a language is
the exact sum of -log2 of the coder's probabilities, found for all languages at once: tables hold, for each
byte string that any language has seen, every language's cost of its last byte after the bytes before it,
escapes included. The language with the shortest code wins.

Nulls and texts without a letter give `und` and score 0. The score is the winner's posterior under equal
priors, of the code lengths per SCALE_BYTES bytes at most. Rows are judged one by one; repeated rows repeat. Ties go to the
first language in code point order. Training takes rows with a language and a text; with none at all every text is `und`. A
table without rows gives none. Of other columns only those named in `keep` are read, and they come back unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, _U, arrow_map, record, text_slices

UNDETERMINED = "und"
#: Unicode category L: no digits, fractions or numerals.
_LETTER = regex.compile(r"\p{L}")
#: Code length differences count as those of a text of this length at most, so that scores of long texts differ.
SCALE_BYTES = 200
#: Bytes of a long text that are worked on at once.
BLOCK = 1 << 20


def _grams(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each string of n bytes inside a row, as an integer with the length above it, and where it ends."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    key = np.full(m, n, _U)
    for j in range(n):
        key = (key << _U(8)) | buf[j : j + m]
    inside = np.ones(m, bool)
    for j in range(1, n):  # strings that start up to n - 1 bytes before a row's first byte
        at = offs[1:-1] - j
        inside[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(inside)
    return key[at], at + n - 1


class Model:
    """The frozen trees of all languages. levels[n - 1]: index of the strings of n bytes, cost of the last byte, and cost of an escape from the string as a context."""

    def __init__(self, langs: list[str], counts: list[list[dict[int, int]]]):
        self.langs = langs
        L, self.order = len(langs), len(counts) - 1
        self.levels, below = [], None
        for n, per_lang in enumerate(counts, 1):
            keys = np.array(sorted(set().union(*per_lang)), dtype=_U)
            index = HashIndex(keys)
            c = np.zeros((len(keys), L))
            for i, d in enumerate(per_lang):
                c[index.find(np.fromiter(d.keys(), _U, len(d))), i] = list(d.values())
            # contexts: the string without its last byte
            head = (keys & _U((1 << (8 * n)) - 1)) >> _U(8) | (_U(n - 1) << _U(8 * (n - 1)))
            if n == 1:
                total, kinds = np.tile(c.sum(0), (len(keys), 1)), np.tile((c > 0).sum(0), (len(keys), 1))
                lower = np.full((len(keys), L), 8.0)
                self.escape0 = -np.log2((c > 0).sum(0) / np.maximum(1, c.sum(0) + (c > 0).sum(0)) + (c.sum(0) == 0))
            else:
                own, place = np.unique(head, return_inverse=True)
                t, d = np.zeros((len(own), L)), np.zeros((len(own), L))
                np.add.at(t, place, c)
                np.add.at(d, place, c > 0)
                total, kinds = t[place], d[place]
                tail = (keys & _U((1 << (8 * (n - 1))) - 1)) | (_U(n - 1) << _U(8 * (n - 1)))
                lower = below[1][below[0].find(tail)]
                esc = np.zeros((len(below[2]), L))
                at = below[0].find(own)
                esc[at] = np.where(t > 0, -np.log2(np.where(t > 0, d / np.maximum(1, t + d), 1)), 0)
                self.levels[-1][2][:] = esc
            away = np.where(total > 0, -np.log2(np.where(total > 0, kinds / np.maximum(1, total + kinds), 1)), 0)
            cost = np.where(c > 0, -np.log2(np.maximum(c, 1) / np.maximum(1, total + kinds)), away + lower)
            below = (index, cost, np.zeros((len(keys), L)))
            self.levels.append([index, cost.astype(np.float32), below[2]])
        self.levels = [(a, b, e.astype(np.float32)) for a, b, e in self.levels]

    def code_lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each row under each language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        if len(offs) == 2 and len(buf) > BLOCK:  # one long text, a block at a time, with what precedes the block as context
            for a in range(0, len(buf), BLOCK):
                out += self._bits(buf[max(0, a - self.order) : a + BLOCK], np.array([0, min(len(buf), a + BLOCK) - max(0, a - self.order)]))[min(a, self.order) :].sum(0, dtype=np.float64)
            return out
        if not len(buf):
            return out
        bits = self._bits(buf, offs)
        full = np.flatnonzero(offs[:-1] < offs[1:])
        out[full] = np.add.reduceat(bits, offs[full], axis=0, dtype=np.float64)
        return out

    def _bits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each byte."""
        bits = np.empty((len(buf), len(self.langs)), np.float32)
        left = None  # the bytes not coded yet, and what escapes have cost them
        lost = np.zeros((len(buf), len(self.langs)), np.float32)
        for n in range(self.order + 1, 0, -1):
            index, cost, escape = self.levels[n - 1]
            keys, at = _grams(buf, offs, n)
            if left is not None:
                keep = left[at]
                keys, at = keys[keep], at[keep]
            else:
                left = np.ones(len(buf), bool)
            got = index.find(keys)
            hit = got >= 0
            bits[at[hit]] = cost[got[hit]]
            left[at[hit]] = False
            if n > 1:
                miss = at[~hit]
                if len(miss):
                    context = (keys[~hit] & _U((1 << (8 * n)) - 1)) >> _U(8) | (_U(n - 1) << _U(8 * (n - 1)))
                    below = self.levels[n - 2]
                    c = below[0].find(context)
                    known = c >= 0
                    lost[miss[known]] += below[2][c[known]]
        at = np.flatnonzero(left)
        bits[at] = 8 + self.escape0
        bits += lost
        return bits


def train(docs: DataFrame, where: Column, order: int = 3, docs_per_lang: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Trees from about docs_per_lang whole rows of each language among the rows for which `where` holds.

    docs_per_lang is the bound of the training sample: rows are chosen by a hash of their id at a rate found
    by counting, so the sample, the counts brought to the driver and the model do not grow with the input.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    rate = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, docs_per_lang / v))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("ppm"), F.col(id_col)), F.lit(1 << 20)) < rate[F.col(lang_col)] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, 1 << 19):
            lang = part.batch.column(0).to_numpy(zero_copy_only=False)
            for one in sorted(set(lang)):
                texts = [t for t, x in zip(part.raw(), lang, strict=True) if x == one]
                offs = np.cumsum([0, *map(len, texts)])
                buf = np.frombuffer(b"".join(texts), np.uint8)
                for n in range(1, order + 2):
                    k, c = np.unique(_grams(buf, offs, n)[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([one] * len(k)), "gram": pa.array(k.astype(np.int64)), "n": pa.array(c.astype(np.int64))})

    grams = arrow_map(chosen.select(lang_col, text_col), count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = grams["lang"].to_numpy(), grams["gram"].to_numpy(), grams["n"].to_numpy()
    size = np.floor(np.log2(np.maximum(gram, 1)) / 8).astype(int)  # the length stands above the bytes
    counts: list[list[dict[int, int]]] = [[{} for _ in langs] for _ in range(order + 1)]
    for k in range(1, order + 2):
        for i, one in enumerate(langs):
            m = (size == k) & (lang == one)
            counts[k - 1][i] = dict(zip(gram[m].tolist(), n[m].tolist(), strict=True))
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """keep (default: id_col), lang_pred, score of every row; all of `keep` comes back unchanged."""
    keep = keep or [id_col]
    src = docs.select(*keep, *([] if text_col in keep else [text_col]))
    shared = src.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches, text_col, 1 << 20):
            has = np.array([bool(t) and bool(_LETTER.search(t)) for t in part.batch.column(part.batch.schema.get_field_index(text_col)).to_pylist()])
            if m is None:
                best, score = np.full(len(has), UNDETERMINED, object), np.zeros(len(has))
            else:
                bits = m.code_lengths(part.buf, part.offs)
                size = np.maximum(1, np.diff(part.offs))
                nats = (bits - bits.min(1, keepdims=True)) * np.log(2) * (np.minimum(size, SCALE_BYTES) / size)[:, None]
                score = np.where(has, 1 / np.exp(-nats).sum(1), 0.0)
                best = np.where(has, np.array(m.langs, object)[bits.argmin(1)], UNDETERMINED)
            columns = [part.batch.column(part.batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep)
    return arrow_map(src, run, f"{schema}, lang_pred string, score double")
