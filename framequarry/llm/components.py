"""Connected components by alternating large-star and small-star steps (Kiveris and others, 2014), as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop, is_small, stash_measured

#: Edges of at most so many bytes on disk have their minima broadcast instead of joined by a shuffle.
BROADCAST_BYTES = 4 << 20
#: Up to so many edges are joined by one task, whose arrays then take some ten MB; more go through the steps.
ONE_TASK = 1 << 18


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        nodes, low = _roots(*(np.concatenate([p[i] for p in parts]) for i in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "component"])


def _mins(edges: DataFrame, around: DataFrame) -> DataFrame:
    """a, m: the smallest b of each a; `around` bounds its size."""
    m = edges.groupBy("a").agg(F.min("b").alias("m"))
    return F.broadcast(m) if is_small(around, BROADCAST_BYTES) else m


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it reaches) of every node of an edge.

    Null ends and loops are ignored; edges may repeat and go either way. No edge gives no row. Up to ONE_TASK edges
    of bigint ids, a few MB, are joined by one task: steps would cost the driver some ten jobs for them. Of more, each step
    reduces by partial minima, joins them back and cuts its lineage, so a hub is only a skewed join; it ends when the
    edges' number and checksum, observed as they are written, stay the same.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    mark = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("a", "b"))}
    e, now = stash_measured(e.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a")).distinct(), "edges", mark)
    if now["n"] <= ONE_TASK and {kind for _, kind in e.dtypes} == {"bigint"}:
        return arrow_map(e.select("a", "b").coalesce(1), _in_one_task, "node bigint, component bigint")
    before = None
    while now["n"] and now != before:
        before = now
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = _mins(both, e).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = _mins(low, e)
        star = low.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b")))
        old = e
        e, now = stash_measured(star.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars", mark)
        drop(old)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))
