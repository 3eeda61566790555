"""Document quality by random Fourier features of document statistics.

A document is described by a few dozen statistics (lengths, shares of character kinds, repetition of words and
lines). Standardised, they are mapped to `width` random cosines whose inner products approximate a Gaussian
kernel; ridge regression on the labels is solved from normal equations that every partition sums over
its rows; isotonic regression turns ridge values into probabilities.

Null and empty texts have statistics (all 0) and so a score. Rows are scored one by one; repeated rows repeat.
Labels that are null, or whose id no document has, are not used; a label row and a document row of one id that are repeated
count as often as they meet, conflicting labels once for each. Without any label the score is 0. A table without rows
gives none. Columns other than the id, the text and the label are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, arrow_map, class_table, scratch, span_hashes, stash, text_slices, word_spans
from .kneser_ney import bounded_labels

_KINDS = [
    class_table(lambda b: 65 <= b <= 90),
    class_table(lambda b: 97 <= b <= 122),
    class_table(lambda b: 48 <= b <= 57),
    class_table(lambda b: b >= 128),
    class_table(lambda b: b in b" \t\r\x0b\x0c"),
    class_table(lambda b: b == 10),
    class_table(lambda b: b in b".,;:?'\"()-"),
    class_table(lambda b: b == 33),
    class_table(lambda b: b in b"#$%&*+/<=>@[\\]^_`{|}~"),
    class_table(lambda b: b < 9 or 13 < b < 32 or b == 127),
]
_KIND_OF = np.zeros(256, np.uint8)
for _i, _t in enumerate(_KINDS, 1):
    _KIND_OF[_t] = _i
_NOT_LINE = class_table(lambda b: b != 10)
N_STATS = 23


def _repetition(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: number of items, share of different ones, share of the most frequent one."""
    n = np.bincount(row, minlength=rows)
    distinct, most = np.zeros(rows), np.zeros(rows)
    ends = np.cumsum(n)
    for i in np.flatnonzero(n).tolist():
        s = np.sort(h[ends[i] - n[i] : ends[i]])
        cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
        distinct[i], most[i] = len(cut) - 1, np.diff(cut).max()
    return n, distinct / np.maximum(n, 1), most / np.maximum(n, 1)


def statistics(part) -> np.ndarray:
    """One row of N_STATS numbers for each text."""
    rows, buf, offs = len(part), part.buf, part.offs
    size = np.diff(offs)
    row_of = np.repeat(np.arange(rows), size)
    kinds = np.bincount(row_of * 11 + _KIND_OF[buf], minlength=rows * 11).reshape(rows, 11)[:, 1:]
    share = kinds / np.maximum(size, 1)[:, None]
    start, end, row = word_spans(buf, offs, NOT_SPACE)
    h = span_hashes(buf, start, end, fold=True)
    n, distinct, most = _repetition(h, row, rows)
    length = (end - start).astype(float)
    mean = np.bincount(row, length, minlength=rows) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(0, np.bincount(row, length**2, minlength=rows) / np.maximum(n, 1) - mean**2))
    twice = np.zeros(len(h), bool)
    if len(h):
        twice[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again = np.bincount(row, twice, minlength=rows) / np.maximum(n, 1)
    if len(start):  # words whose first letter, or last byte, tells: capitals and marks at the end
        cap = np.bincount(row, (_KIND_OF[buf[start]] == 1) & (_KIND_OF[buf[np.minimum(start + 1, end - 1)]] == 1), minlength=rows) / np.maximum(n, 1)
        odd = np.bincount(row, np.isin(_KIND_OF[buf[end - 1]], (8, 9)), minlength=rows) / np.maximum(n, 1)
    else:
        cap = odd = np.zeros(rows)
    ls, le, lrow = word_spans(buf, offs, _NOT_LINE)
    lines, ldistinct, lmost = _repetition(span_hashes(buf, ls, le, fold=False), lrow, rows)
    out = np.c_[share, np.log1p(size), np.log1p(n), np.log1p(lines), mean / 10, spread / 10, distinct, most, again, cap, odd, ldistinct, lmost, n / np.maximum(lines, 1) / 50]
    return out.astype(np.float64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, stats array<double> of every row."""
    src = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, 1 << 20):
            s = statistics(part)
            yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))], names=[id_col, "stats"])

    return arrow_map(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, stats array<double>")


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising x: where blocks begin and end, and their rising means."""
    begin: list[float] = []
    end: list[float] = []
    mean: list[float] = []
    weight: list[float] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        begin.append(a)
        end.append(a)
        mean.append(b)
        weight.append(c)
        while len(mean) > 1 and mean[-2] >= mean[-1]:
            m, k, to = mean.pop(), weight.pop(), end.pop()
            begin.pop()
            mean[-1] = (mean[-1] * weight[-1] + m * k) / (weight[-1] + k)
            weight[-1] += k
            end[-1] = to
    return np.array(begin), np.array(end), np.array(mean)


class Model:
    """Standardisation, random cosines, ridge weights and calibration; a few hundred KB whatever the input."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.W = rng.normal(0, np.sqrt(2 * gamma), (len(mean), width))
        self.b = rng.uniform(0, 2 * np.pi, width)
        self.beta: np.ndarray | None = None
        self.at = self.value = np.empty(0)

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.c_[np.sqrt(2 / len(self.b)) * np.cos(z @ self.W + self.b), np.ones(len(z))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        """A calibration block's value inside it, interpolated between blocks."""
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def _stats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), N_STATS)


def train(feats: DataFrame, labels: DataFrame, where: Column, label_col: str = "quality", per_class: int = 20000, width: int = 256, gamma: float = 0.03, ridge: float = 1.0, seed: int = 20240501, id_col: str = "doc_id") -> Model | None:
    """per_class bounds the labelled rows: half the sample fits the regression, the other half the calibration.

    A class that is thinned counts by its rows' weights everywhere, so the labels' natural shares hold at any size.

    Every partition sums its rows' outer products; the sums of at most `parts` partitions meet on the driver,
    width**2 numbers each.
    """
    with scratch():
        return _fitted(feats, bounded_labels(labels, where, label_col, per_class, id_col), width, gamma, ridge, seed, id_col)


def _fitted(feats: DataFrame, sample: DataFrame, width: int, gamma: float, ridge: float, seed: int, id_col: str) -> Model | None:
    parts = 8
    rows = stash(feats.join(F.broadcast(sample), id_col).select("stats", "label", "part", "weight").repartition(parts), "quality-sample")
    spark = rows.sparkSession

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0.0, np.zeros(N_STATS), np.zeros(N_STATS)
        for b in batches:
            x, w = _stats(b.column(0)), b.column(3).to_numpy()
            n, s, q = n + float(w.sum()), s + w @ x, q + w @ (x * x)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "s": pa.array([s.tolist()]), "q": pa.array([q.tolist()])})

    got = arrow_map(rows, moments, "n double, s array<double>, q array<double>").collect()
    n = sum(r.n for r in got)
    if not n:
        return None
    mean = sum(np.array(r.s) for r in got) / n
    scale = np.sqrt(np.maximum(1e-12, sum(np.array(r.q) for r in got) / n - mean**2))
    scale[scale < 1e-5] = 1.0
    model = Model(mean, scale, width, gamma, seed)
    held = spark.sparkContext.broadcast(model)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        A, c = np.zeros((width + 1, width + 1)), np.zeros(width + 1)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x, y = _stats(b.column(0).slice(at, 4096)), b.column(1).slice(at, 4096).to_numpy().astype(float)
                z = held.value.cosines(x)
                wz = z * b.column(3).slice(at, 4096).to_numpy()[:, None]
                A += wz.T @ z
                c += wz.T @ y
        yield pa.RecordBatch.from_pydict({"a": pa.array([A.tobytes()]), "c": pa.array([c.tobytes()])})

    got = arrow_map(rows.where("part = 0"), normal, "a binary, c binary").collect()
    A = sum(np.frombuffer(r.a) for r in got).reshape(width + 1, width + 1)
    c = sum(np.frombuffer(r.c) for r in got)
    model.beta = np.linalg.solve(A + ridge * np.eye(width + 1), c)
    fitted = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array(fitted.value.raw(_stats(b.column(0)))), "label": b.column(1), "weight": b.column(3)})

    # a bounded sample in full: per_class rows of each class at most
    seen = arrow_map(rows.where("part = 1"), measure, "x double, label int, weight double").toArrow()
    x, y, w = seen["x"].to_numpy(), seen["label"].to_numpy().astype(float), seen["weight"].to_numpy()
    if not len(x):
        model.at = model.value = np.array([0.0, 1.0])
        return model
    order = np.argsort(x, kind="stable")
    x, first, place = np.unique(x[order], return_index=True, return_inverse=True)
    # the sample holds classes at its own rates; weights undo them
    k = np.bincount(place, w[order])
    begin, end, mean = isotonic(x, np.bincount(place, (w * y)[order]) / k, k)
    model.at, model.value = np.c_[begin, end].ravel(), np.repeat(mean, 2)
    return model


def score(feats: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """id_col, score of every row of features()."""
    held = feats.sparkSession.sparkContext.broadcast(model)
    src = feats.select(id_col, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                s = held.value.score(_stats(part.column(1))) if held.value else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=[id_col, "score"])

    return arrow_map(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double")
