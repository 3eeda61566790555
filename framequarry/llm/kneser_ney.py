"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, give each byte's probability after the bytes before it (A-Z
lower-cased), from strings of up to `order` bytes: absolute discounting, and continuation counts below the
highest order (how many different bytes a string follows). The lowest two orders are shared: their continuation counts
are taken over every document of the corpus, labelled or not. Rare expressions, such as a stem under an ending never
seen, back off to the counts of their parts, and where neither class knows better, both back off to the same
shared counts and the difference is nil. A text's log-likelihoods under both models are compared, normalised by its
length, and a logistic curve turns the differences into a probability. It is fitted on a quarter of the rows, by models that have not counted those;
the models that score have counted all.

Enter the curve: the difference per byte; per square root of bytes (its size in units of the chance spread, which stays
comparable from short to long texts); and those of the words (runs of letters, digits and anything beyond ASCII), as a few words may say it all: the largest word's, and
the mean of the three largest, beside the logarithm of how many words there are, since more words have larger ones by chance.

Null and empty texts have the difference 0, and the score of a text nothing is known about. Rows are scored one by
one; repeated rows repeat. Labels that are null, or whose id no document has, are not used; a label row and a document
row of one id that are repeated count as often as they meet, conflicting labels once for each class. Without
labels of both classes every score is 0. A table without rows gives none. Columns other than the id, the text and the label are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, FOLD as _FOLD, HashIndex, _U, arrow_map, drop, stash, text_slices, word_spans
from .ppm import _grams

#: The discount of every count.
DISCOUNT = 0.75
#: How many of the largest words count, and columns that enter the curve.
TOP, N_FEATURES = 3, 6
#: Bytes of a long text that are worked on at once, and of a bitmap as Spark's bitmap functions have them.
BLOCK, _BITMAP = 1 << 20, 4096


def bounded_labels(labels: DataFrame, where: Column, label_col: str, per_class: int, id_col: str, most: int | None = None, parts: int = 2) -> DataFrame:
    """id_col, label, `part` (below `parts`, by a hash of the id) and weight: about per_class rows of each class; with fewer, all.

    The weight is how many rows of its class a row stands for, 1 where all are taken. With `most`, the smallest class
    gives per_class rows and another at most `most` times as many as that one does, so the mix of large classes is the same at any size.
    """
    rows = labels.where(where & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {int(r[0]): r[1] for r in rows.groupBy(label_col).count().collect()}
    smallest = min(per_class, *sizes.values()) if sizes else 0
    take = {k: smallest if most and v == min(sizes.values()) else most * smallest if most else per_class for k, v in sizes.items()}
    limit, weight = F.lit(0), F.lit(1.0)
    for k, v in sizes.items():
        n = math.ceil(min(1.0, take[k] / v) * (1 << 20))  # of 2**20 hashes, those that are chosen
        limit = F.when(F.col(label_col) == k, F.lit(n)).otherwise(limit)
        weight = F.when(F.col(label_col) == k, F.lit((1 << 20) / n)).otherwise(weight)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("label"), F.col(id_col)), F.lit(1 << 20)) < limit)
    return chosen.select(F.col(id_col), F.col(label_col).cast("int").alias("label"), F.pmod(F.xxhash64(F.lit("part"), F.col(id_col)), F.lit(parts)).cast("int").alias("part"), weight.alias("weight"))


def _tail(keys: np.ndarray, n: int) -> np.ndarray:
    """Strings of n bytes without their first byte."""
    return (keys & _U((1 << (8 * (n - 1))) - 1)) | (_U(n - 1) << _U(8 * (n - 1)))


def _head(keys: np.ndarray, n: int) -> np.ndarray:
    """Strings of n bytes without their last byte."""
    return ((keys & _U((1 << (8 * n)) - 1)) >> _U(8)) | (_U(n - 1) << _U(8 * (n - 1)))


def _continuations(corpus: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of strings of one byte and of two: keys, and how many different bytes come before each in the corpus, alike for both classes."""
    before = corpus.reshape(256, 65536).sum(0)
    pairs = np.flatnonzero(before)
    singles = np.bincount(pairs & 255, minlength=256)
    one = np.flatnonzero(singles)
    return [(one.astype(_U) | _U(1 << 8), np.tile(singles[one][:, None], (1, 2)).astype(float)), (pairs.astype(_U) | _U(2 << 16), np.tile(before[pairs][:, None], (1, 2)).astype(float))]


def corpus_strings(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Which strings of three bytes (A-Z lower-cased) all documents hold: 2**24 flags, in bitmaps of 4 KB that tasks send and Spark joins.

    A text's first two bytes count as after a zero byte, so no string of two bytes is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 24, bool)
        for part in text_slices(batches, text_col, BLOCK):
            for a in range(0, max(1, len(part.buf)), BLOCK if len(part) == 1 else 1 << 62):
                lead = min(a, 2)
                b = _FOLD[part.buf[a - lead : a + BLOCK] if len(part) == 1 else part.buf].astype(np.int32)
                first = np.zeros(len(b), bool)  # the first bytes of texts
                if not a:
                    first[part.offs[:-1][part.offs[:-1] < part.offs[1:]]] = True
                i = np.flatnonzero(~first)
                i = i[i >= (lead or 1)]
                seen[(np.where(first[i - 1], 0, b[np.maximum(i - 2, 0)]) << 16) | (b[i - 1] << 8) | b[i]] = True
        bits = np.packbits(seen).reshape(-1, _BITMAP)
        some = np.flatnonzero(bits.any(1))
        yield pa.RecordBatch.from_pydict({"k": pa.array(some.astype(np.int32)), "bits": pa.array([bits[k].tobytes() for k in some], pa.binary())})

    got = arrow_map(docs.select(text_col), run, "k int, bits binary").groupBy("k").agg(F.expr("bitmap_or_agg(bits)").alias("bits")).collect()  # 512 rows at most
    out = np.zeros((512, _BITMAP), np.uint8)
    for r in got:
        out[r.k] = np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(out).astype(bool)


class Model:
    """Log-likelihood ratios (toxic over ordinary) of a byte after the bytes before it.

    P_n(b | h) = max(c(hb) - D, 0) / c(h.) + D * kinds(h.) / c(h.) * P_{n-1}(b | h without its first byte)

    levels[n - 1] holds, for every string of n bytes that a class has seen, the ratio of its last byte, and the
    ratio of the two classes' backoff weights after the string as a history; a byte whose string is unknown
    costs its history's weights and is looked up one byte shorter. A history that is new to a class has weight 1.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int, corpus: np.ndarray):
        """keys: strings of `order` bytes; n: their counts in the two classes; corpus: the strings of three bytes that the corpus has, as a table of flags."""
        self.order = order
        counts = [(keys, n.astype(float))]
        for size in range(order, 1, -1):  # continuation counts: different first bytes
            k, c = counts[0]
            tail, place = np.unique(_tail(k, size), return_inverse=True)
            low = np.zeros((len(tail), 2))
            np.add.at(low, place, (c > 0).astype(float))
            counts.insert(0, (tail, low))
        counts[:2] = _continuations(corpus)
        self.levels = []
        below = P = None
        for size, (k, c) in enumerate(counts, 1):
            own, place = np.unique(_head(k, size), return_inverse=True)
            total, kinds = np.zeros((len(own), 2)), np.zeros((len(own), 2))
            np.add.at(total, place, c)
            np.add.at(kinds, place, c > 0)
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
            lower = np.full((len(k), 2), 1 / 256) if size == 1 else P[below.find(_tail(k, size))]
            P = np.where(total[place] > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(total[place], 1e-9), 0) + weight[place] * lower
            ratio = np.log(weight[:, 1]) - np.log(weight[:, 0])
            if size > 1:
                at = below.find(own)
                self.levels[-1][2][at[at >= 0]] = ratio[at >= 0]
            below = HashIndex(k)
            self.levels.append((below, (np.log(P[:, 1]) - np.log(P[:, 0])).astype(np.float32), np.zeros(len(k), np.float32)))
        self.curve = np.zeros(N_FEATURES)

    def features(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """What enters the curve, a row for each text."""
        n = len(offs) - 1
        total, words, top = np.zeros(n), np.zeros(n), np.full((n, TOP), -np.inf)
        long = n == 1 and len(buf) > BLOCK
        at = 0
        while at < len(buf):  # one long text in blocks that end between words, with what precedes a block as history
            end = _between_words(buf, at, at + BLOCK) if long else len(buf)
            lead = min(at, self.order - 1)
            own = np.array([0, end - at + lead]) if long else offs
            r = self._ratios(buf[at - lead : end] if long else buf, own)
            r[:lead] = 0
            sums = np.r_[0.0, np.cumsum(r)]
            total += sums[own[1:]] - sums[own[:-1]]
            start, stop, row = word_spans(buf[at:end], np.array([0, end - at]) if long else offs, ALNUM)
            w = sums[stop + lead] - sums[start + lead]
            words += np.bincount(row, minlength=n)
            o = np.lexsort((-w, row))
            place = np.arange(len(o)) - np.searchsorted(row, row)[: len(o)] if len(o) else o
            best = place < TOP
            block = np.full((n, TOP), -np.inf)
            block[row[o][best], place[best]] = w[o][best]
            top = -np.sort(-np.c_[top, block], axis=1)[:, :TOP]
            at = end
        top = np.where(np.isfinite(top), top, 0.0)
        size = np.maximum(np.diff(offs), 1)
        return np.c_[total / size, total / np.sqrt(size), top[:, 0], top.sum(1) / np.clip(words, 1, TOP), np.log1p(words), np.ones(n)]

    def sums(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The ratio of each row's whole text."""
        out = np.zeros(len(offs) - 1)
        if len(offs) == 2 and len(buf) > BLOCK:  # one long text, a block at a time, with what precedes the block as history
            for a in range(0, len(buf), BLOCK):
                lead = min(a, self.order - 1)
                out += self._ratios(buf[a - lead : a + BLOCK], np.array([0, min(len(buf), a + BLOCK) - a + lead]))[lead:].sum()
            return out
        full = np.flatnonzero(offs[:-1] < offs[1:])
        if len(full):
            out[full] = np.add.reduceat(self._ratios(buf, offs), offs[full])
        return out

    def _ratios(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The ratio of each byte."""
        buf = _FOLD[buf]
        r = np.zeros(len(buf))
        left = np.ones(len(buf), bool)
        for n in range(self.order, 0, -1):
            index, ratio, _ = self.levels[n - 1]
            keys, at = _grams(buf, offs, n)
            keep = left[at]
            keys, at = keys[keep], at[keep]
            got = index.find(keys)
            hit = got >= 0
            r[at[hit]] += ratio[got[hit]]
            left[at[hit]] = False
            if n > 1 and not hit.all():
                below, _, away = self.levels[n - 2]
                c = below.find(_head(keys[~hit], n))
                known = c >= 0
                r[at[~hit][known]] += away[c[known]]
        return r

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve, -40, 40)))


def _between_words(buf: np.ndarray, at: int, end: int) -> int:
    """The last place before `end` where no word goes on, or `end` where there is none."""
    if end >= len(buf):
        return len(buf)
    outside = np.flatnonzero(~ALNUM[buf[at:end]])
    return at + int(outside[-1]) + 1 if len(outside) else end


def _logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge and halved steps; classes count alike."""
    scale = np.maximum(1e-9, np.r_[z[:, :-1].std(0), 1.0])
    z = z / scale
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(z.shape[1])
    ridge = np.diag(np.r_[np.full(len(b) - 1, 1e-2), 1e-3])

    def loss(b: np.ndarray) -> float:
        return float(w @ np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ b)) + b @ ridge @ b / 2)

    at = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
        # where classes are far apart a whole step goes too far: it is halved until it gains something
        while np.abs(step).max() >= 1e-8 and not loss(b - step) < at:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        b, at = b - step, loss(b - step)
    return b / scale


def train(docs: DataFrame, labels: DataFrame, where: Column, label_col: str = "toxic", per_class: int = 6000, most: int = 4, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Models of the sampled rows, with a logistic curve that models of three quarters of them earn on the rest; there, classes weigh alike.

    per_class and most bound the labelled rows that are used (the rarer class has per_class rows, the commoner most
    times as many), and with them what comes to the driver. The shared orders are counted over all of docs.
    """
    sample = bounded_labels(labels, where, label_col, per_class, id_col, most=most, parts=4)
    rows = stash(docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(text_col, "label", "part"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, 1 << 20):
            label, half = (np.asarray(part.batch.column(k).to_numpy(zero_copy_only=False)) for k in (1, 2))
            raw = part.raw()
            for c, last in ((0, False), (1, False), (0, True), (1, True)):
                texts = [t for t, m in zip(raw, (label == c) & ((half == 3) == last), strict=True) if m]
                offs = np.cumsum([0, *map(len, texts)])
                k, n = np.unique(_grams(_FOLD[np.frombuffer(b"".join(texts), np.uint8)], offs, order)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"k": pa.array(k.view(np.int64)), "kind": pa.array(np.full(len(k), c + 2 * last, np.int32)), "n": pa.array(n.astype(np.int64))})

    of = lambda c: F.sum(F.when(F.col("kind") == c, F.col("n")).otherwise(0)).alias(f"n{c}")
    got = arrow_map(rows, count, "k bigint, kind int, n bigint").groupBy("k").agg(*map(of, range(4))).toArrow()
    keys, n = got["k"].to_numpy().view(_U), np.c_[*(got[f"n{c}"].to_numpy() for c in range(4))]
    del got
    if not len(n) or not (n[:, :2] + n[:, 2:]).sum(0).all():
        drop(rows)
        return None
    corpus = corpus_strings(docs, text_col)
    curve = np.eye(1, N_FEATURES).ravel()
    if n[:, :2].sum(0).all():
        first = n[:, :2].any(1)
        held = docs.sparkSession.sparkContext.broadcast(Model(keys[first], n[first, :2], order, corpus))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, text_col, 1 << 20):
                yield pa.RecordBatch.from_pydict({"f": pa.array(held.value.features(part.buf, part.offs).tolist(), pa.list_(pa.float64())), "label": part.batch.column(1)})

        seen = arrow_map(rows.where("part = 3"), measure, "f array<double>, label int").toArrow()
        y = seen["label"].to_numpy().astype(float)
        if len(y) and 0 < y.sum() < len(y):
            curve = _logistic(np.array(seen["f"].to_pylist()), y)
        held.destroy()
    drop(rows)
    model = Model(keys, n[:, :2] + n[:, 2:], order, corpus)
    model.curve = curve
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ratio (log-likelihood ratio per byte), score of every row."""
    src = docs.select(id_col, text_col)
    held = src.sparkSession.sparkContext.broadcast(model)  # bounded by per_class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part in text_slices(batches, text_col, 1 << 20):
            f = m.features(part.buf, part.offs) if m else np.zeros((len(part), N_FEATURES))
            p = m.probability(f) if m else np.zeros(len(part))
            yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.array(f[:, 0]), pa.array(p)], names=[id_col, "ratio", "score"])

    return arrow_map(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ratio double, score double")
