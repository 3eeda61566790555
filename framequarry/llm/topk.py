"""Exact top-k search by inner product with the threshold algorithm (Fagin, Lotem and Naor).

Candidates are dealt into blocks. A block holds, for every dimension, the list of its vectors sorted by that
component. A query reads the lists from their best ends in step (descending where its own component is
positive, ascending where negative); each vector met for the first time is looked up and scored in full. After each
round, no unseen vector can score more than the sum over dimensions of the query's component times the
value last read; when the kth score is above that bound the block is done. A query's results of all blocks are
merged. Rounds double in depth, and a round's vectors are scored together.

Queries meet candidate blocks by an equi-join on the block of queries, so the work is that of a stated query set
against all rows, in blocks of bounded size. Vectors that are null, or hold null or non-finite components, take no part,
and a query meets candidates of its own length only. An id's own vectors are no candidates for it; vectors of one id
are distinct candidates, and the results of queries with one id are ranked together. Ties go to the smaller id. Repeated
rows repeat as candidates. A table without rows gives none. Columns other than the id and the vector are not read, whatever
their names. Components beyond a 64-bit integer's range saturate.

Where vectors have many dimensions of like spread, as random embeddings of 64 do, the bound stays above the kth score
until most of a block has been met, and the algorithm does little less than a scan; its gain is in skewed or few
dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, stash

#: Vectors in a block of candidates and of queries.
BLOCK, QUERIES = 4096, 512


class SortedLists:
    """A block's vectors with every dimension's order. Scores are exact: in doubles where no sum can reach 2**53, else in 64-bit integers (modulo 2**64 beyond those)."""

    def __init__(self, ids: np.ndarray, X: np.ndarray):
        o = np.argsort(ids, kind="stable")
        self.ids, self.X = ids[o], X[o].astype(np.float64)
        self.whole = X[o].astype(np.int64)
        self.most = float(np.abs(self.X).max(initial=0)) * X.shape[1]
        self.order = np.argsort(self.X, axis=0, kind="stable").T.astype(np.int32)  # a list for each dimension
        self.value = np.take_along_axis(self.X, self.order.T, axis=0).T.copy()

    def search(self, q: np.ndarray, own: int, k: int, depth: int = 32) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the k best, best first, and how deep the lists were read."""
        n, dims = self.X.shape
        exact = self.most * float(np.abs(q).max(initial=0)) < 1 << 53
        X, q, kind_of = (self.X, q.astype(np.float64), np.float64) if exact else (self.whole, q.astype(np.int64), np.int64)
        never = -np.inf if exact else np.iinfo(np.int64).min
        up, used = q < 0, q != 0
        seen = np.zeros(n, bool)
        scores = np.full(n, never, kind_of)
        d = 0
        while True:
            depth = min(depth, n)
            new = np.zeros(n, bool)
            new[self.order[:, d:depth][up].ravel()] = True
            new[self.order[:, n - depth : n - d][used & ~up].ravel()] = True
            if not used.any():
                new[:] = True
            new &= ~seen
            at = np.flatnonzero(new)
            scores[at] = (X @ q)[at] if 4 * len(at) > n else X[at] @ q  # many rows cost more to gather than to multiply
            scores[at[self.ids[at] == own]] = never
            seen |= new
            d = depth
            edge = np.where(up, self.value[:, d - 1], self.value[:, n - d])
            # beyond 2**53 a double's bound may fall short of the sum: its rounding is added
            bound = float(edge[used] @ q[used].astype(np.float64)) + (0 if exact else 1e-12 * float(np.abs(edge[used]) @ np.abs(q[used].astype(np.float64))))
            best = np.flatnonzero(scores > never)
            if len(best) > k:
                kth = np.partition(scores[best], len(best) - k)[len(best) - k]
                best = best[scores[best] >= kth]
            elif len(best) == k:
                kth = scores[best].min()
            else:
                kth = -np.inf
            if d == n or seen.all() or kth > bound:
                best = best[np.lexsort((self.ids[best], -scores[best]))][:k]
                return best, scores[best], d
            depth *= 4


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v array<bigint>: floor(scale * x) of every whole vector that can be compared."""
    x = F.col("__v")
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("__v"))
        .where(usable & F.col("id").isNotNull())
        .select("id", F.transform("__v", lambda a: F.floor(a * scale).cast("bigint")).alias("v"))
    )


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """dims, name (a block's number), n, ids binary, values binary: at most about 2 * size vectors a block."""
    counts = {r[0]: r[1] for r in rows.groupBy(F.size("v").alias("dims")).count().collect()}  # a row for each length of vectors
    if not counts:
        return rows.sparkSession.createDataFrame([], f"dims int, {name} bigint, ids binary, xs binary")
    blocks = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, max(1, -(-n // size)))])
    dealt = rows.select(F.size("v").alias("dims"), F.pmod(F.xxhash64(F.lit(name), "id", F.monotonically_increasing_id()), blocks[F.size("v")]).cast("bigint").alias(name), "id", "v")

    def pack(key, batches):
        b = batches if isinstance(batches, pa.Table) else pa.Table.from_batches(list(batches))
        ids = b["id"].to_numpy().astype("<i8")
        xs = b["v"].combine_chunks().flatten().to_numpy().astype("<i8")
        if len(xs) and np.abs(xs).max() < 32768:
            raw = b"s" + xs.astype("<i2").tobytes()
        else:
            raw = b"l" + xs.tobytes()
        return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "xs": pa.array([raw], pa.binary())})

    return dealt.groupBy("dims", name).applyInArrow(lambda key, t: pack(key, t), f"dims int, {name} bigint, ids binary, xs binary")


def _matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw[1:], "<i2" if raw[:1] == b"s" else "<i8").reshape(-1, dims)


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (bigint): is_query is a Column over `id` that marks the queries."""
    rows = quantised(vectors, id_col, vec_col, scale)
    candidates = stash(_blocks(rows, BLOCK, "cb"), "candidates")
    queries = stash(_blocks(rows.where(is_query), QUERIES, "qb"), "queries")
    numbers = queries.select("dims", "qb")
    pairs = candidates.join(numbers, "dims").join(queries.select("dims", "qb", F.col("ids").alias("qids"), F.col("xs").alias("qxs")), ["dims", "qb"]).select("dims", "ids", "xs", "qids", "qxs")
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lists = None, None
        for b in batches:
            for dims, ids, xs, qids, qxs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (ids, xs) != last:
                    last, lists = (ids, xs), SortedLists(np.frombuffer(ids, "<i8"), _matrix(xs, dims))
                q_of, v_of, s_of = [], [], []
                for own, q in zip(np.frombuffer(qids, "<i8").tolist(), _matrix(qxs, dims), strict=True):
                    best, scores, _ = lists.search(q, own, k)
                    q_of.append(np.full(len(best), own))
                    v_of.append(lists.ids[best])
                    s_of.append(scores.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (q_of, v_of, s_of)], schema=out)

    found = arrow_map(pairs, run, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
