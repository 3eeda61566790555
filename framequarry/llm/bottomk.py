"""Near-duplicate detection with bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct shingles of five words. Equal sets form a class; only one
member of a class goes on. Its sketch is the `k` smallest hashes.

1. Inverted lists. Each of a class's `index` smallest hashes is posted. Two sets whose similarity reaches the
   threshold t have an element among the smallest of their union in common but with a chance of
   (1 - t) ** index (10**-13 at 85 %, 10**-11 at 80 %; never missed in sets of up to `index` elements).
2. In every list each class is first compared with one pivot, the list's smallest id. So a group of copies costs about
   its size, not its square. Then lists of up to `hot` classes that are not one component yet yield their other pairs.
3. Longer lists (a passage that many texts share, a text with thousands of edited copies) yield no pairs. Only their
   classes go on: their whole sketches are posted, and a list is again compared with a pivot, then, if short, in pairs.
   Two linked sets share nearly t * k values of their sketches, all of which now stand in lists too long for pairs,
   so a class with fewer such values (`_least_shared`, a chance of 10**-10 by the hypergeometric tail) is done.
4. The few classes left (templates) are indexed by their whole sets, rarest shingles first: classes within
   the threshold share one of their first |A| - ceil(t |A|) + 1 shingles, at places that leave room for the overlap
   they need. Of pairs there, only those that are not connected and have room are compared.
5. Pairs are filtered by size and by the similarity that the union of the two sketches estimates, six standard
   deviations below the threshold (exactly, where two whole sets fit their sketches); every link is then confirmed on
   the two whole sets. Components follow.

Elements are 64-bit hashes without structure that texts could exploit, so two sets of n elements take a false common
element with a chance of n**2 / 2**64.

Rows with a null id get the component of their set's other rows, if any has an id, and else null. Null and empty
texts have an empty set and stand alone. Rows with the same id are rows of their own. Repeated rows repeat. An empty table
gives no rows. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_SPACE, arrow_map, drop, is_small, mix, scratch, sequence_hashes, small, span_hashes, stash, stash_measured, text_slices, word_spans
from .components import connected_components

#: A list of ids is broadcast to pick their texts if it is at most so large on disk; larger ones are joined by a shuffle.
BROADCAST_BYTES = 4 << 20
#: So are sketches, and whole sets, that pairs are compared by.
SKETCH_BYTES = 8 << 20
#: How many elements a set of up to k may seem to lack because others agree with them in their upper 32 bits.
EQUAL_HALVES = 2


def shingle_sets(part, words_in: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (signed) of each text."""
    start, end, row = word_spans(part.buf, part.offs, NOT_SPACE)
    w = span_hashes(part.buf, start, end, fold=True)
    s = sequence_hashes(w, words_in).view(np.int64)
    n = np.bincount(row, minlength=len(part))
    ends = np.cumsum(n)
    out = []
    for i, (m, to) in enumerate(zip(n.tolist(), ends.tolist(), strict=True)):
        at = to - m
        if m >= words_in:
            x = np.sort(s[at : to - words_in + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif m:  # the whole sequence is the one shingle
            out.append(mix(sequence_hashes(w[at:to], m) + np.uint64(m)).view(np.int64))
        else:
            out.append(s[:0])
    return out


def _list_array(parts: list[np.ndarray]) -> pa.ListArray:
    offs = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def signatures(docs: DataFrame, words: int = 5, k: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash (tells rows with one id apart), n (set size), f1 and f2 (the set's fingerprint), sketch (its k smallest hashes)."""
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 20):
            sets = shingle_sets(part, words)
            u = [x.view(np.uint64) for x in sets]
            f1 = [int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in u]
            f2 = [int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in u]
            yield pa.RecordBatch.from_arrays([part.batch.column(0), part.batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _list_array([x[:k] for x in sets])], names=["id", "text_hash", "n", "f1", "f2", "sketch"])

    return arrow_map(src, run, "id bigint, text_hash bigint, n bigint, f1 bigint, f2 bigint, sketch array<bigint>")


def _counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """stash(), and the number of rows."""
    df, seen = stash_measured(df, label, {"rows": F.count(F.lit(1))})
    return df, seen["rows"]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _enough(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return inter * 100 >= (a + b - inter) * percent


def _sizes_allow(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _least_shared(k: int, percent: int) -> int:
    """How many of k smallest elements of a union two sets within the threshold share at least, but with a chance of about 10**-10."""
    t = percent / 100
    return max(1, math.floor(t * k - 6.4 * math.sqrt(t * (1 - t) * k)))


class _Matcher:
    """The classes of one run, and how pairs of them become links."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int, k: int, id_col: str, text_col: str):
        self.src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        self.reps, self.words, self.percent, self.k = reps, words, percent, k
        self.links: list[DataFrame] = []
        self.joined = 0
        self.spent: list[DataFrame] = []
        self.comps = docs.sparkSession.createDataFrame([], "id bigint, component bigint")

    def whole_sets(self, ids: DataFrame) -> DataFrame:
        """id, n, hashes of the classes in `ids`, from their representatives' texts; an id as often as its row repeats."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, "text", 1 << 20):
                sets = shingle_sets(part, words)
                f1 = [int(x.view(np.uint64).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in sets]
                yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.array(f1, pa.int64()), _list_array(sets)], names=["id", "f1", "hashes"])

        got = arrow_map(self.src.join(small(ids, BROADCAST_BYTES), "id", "left_semi"), run, "id bigint, f1 bigint, hashes array<bigint>")
        # an id that several texts bear: the one that the class is of
        own = self.reps.join(small(ids, BROADCAST_BYTES), "id", "left_semi").select("id", "f1")
        got = got.join(F.broadcast(own) if is_small(ids, BROADCAST_BYTES) else own, ["id", "f1"], "left_semi")
        return got.select("id", F.size("hashes").cast("bigint").alias("n"), "hashes")

    def stored_sets(self, pairs: DataFrame) -> DataFrame:
        """The whole sets of the pairs' classes, stored, each id once; they are only shuffled for that if rows repeat."""
        ids, n = _counted(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        sets, rows = _counted(self.whole_sets(ids), "sets")
        if rows > n:
            several, sets = sets, stash(sets.dropDuplicates(["id"]), "sets")
            drop(several)
        drop(ids)
        return sets

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the sizes and the bottom k of the two sketches' union do not rule out.

        The hashes' upper 32 bits do for that, in order: hashes that agree in them by chance only raise what two sketches seem to share,
        or lower it by one where both are shared. Of whole sets EQUAL_HALVES such cases are allowed for, beyond which a chance of 10**-19 is.
        """
        k, t = self.k, self.percent / 100
        margin = 6 * math.sqrt(t * (1 - t) / k)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # only what the pairs need is shuffled, or broadcast if it is small
        need = stash(self.reps.join(small(ids, BROADCAST_BYTES), "id", "left_semi").select("id", "n", F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")).alias("sketch")), "sketches")
        self.spent.append(need)
        reps = small(need, SKETCH_BYTES)
        A = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        B = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        u = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        p = pairs.join(A, "a").join(B, "b").where(_sizes_allow(F.col("na"), F.col("nb"), self.percent)).withColumn("u", u)
        common = F.size(F.array_intersect(F.array_intersect("u", "sa"), F.col("sb"))) / F.size("u")
        exact = _enough(F.size(F.array_intersect("sa", "sb")) + EQUAL_HALVES, F.col("na"), F.col("nb"), self.percent)
        return p.where(F.when((F.col("na") <= k) & (F.col("nb") <= k), exact).otherwise(common >= t - margin)).select("a", "b")

    def add(self, pairs: DataFrame) -> None:
        """Confirms pairs (a, b) on their whole sets; links grow."""
        candidates, n = _counted(pairs, "candidates")
        if not n:
            return drop(candidates)
        pairs, n = _counted(self.estimated(candidates), "pairs")
        if n:
            sets = self.stored_sets(pairs)
            these = small(sets, SKETCH_BYTES)
            A = these.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
            B = these.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
            both = pairs.join(A, "a").join(B, "b").withColumn("i", F.size(F.array_intersect("ha", "hb")))
            new, n = _counted(both.where(_enough(F.col("i"), F.col("na"), F.col("nb"), self.percent)).select("a", "b"), "links")
            drop(sets)
            if n:
                self.links.append(new)
            else:
                drop(new)
        drop(candidates, pairs, *self.spent)
        self.spent = []

    def join_links(self) -> None:
        """Brings the components up to date with the links, if there are new ones."""
        if len(self.links) > self.joined:
            links = self.links[0]
            for more in self.links[1:]:
                links = links.union(more)
            old, self.comps = self.comps, stash(connected_components(links).withColumnRenamed("node", "id"), "components")
            if hasattr(old, "_fq_stash"):
                drop(old)
        self.joined = len(self.links)

    def mixed(self, entries: DataFrame) -> DataFrame:
        """entries (v, id, ...) with their component, of lists v that hold more than one component."""
        placed = entries.join(self.comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = placed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("v")
        return placed.join(several, "v", "left_semi")

    def star(self, entries: DataFrame) -> DataFrame:
        """Each class of a list with the list's smallest id."""
        pivots = entries.groupBy("v").agg(F.min_by(F.struct("id", "n"), "id").alias("p"))
        near = entries.join(pivots, "v").where((F.col("id") != F.col("p.id")) & _sizes_allow(F.col("n"), F.col("p.n"), self.percent))
        return near.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()

    def pairs(self, entries: DataFrame, room: Column | None = None) -> DataFrame:
        """The pairs of a list's classes that are of different components."""
        L, R = (entries.select("v", *(F.col(c).alias(c + x) for c in entries.columns if c != "v")) for x in "ab")
        apart = (F.col("componenta") != F.col("componentb")) & (F.col("ida") < F.col("idb")) & _sizes_allow(F.col("na"), F.col("nb"), self.percent)
        return L.join(R, "v").where(apart if room is None else apart & room).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()


def _lists(posted: DataFrame) -> DataFrame:
    """posted (v, id, n) with c, the length of its list; lists of one are left out."""
    return posted.join(posted.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "v")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 64, index: int = 16, hot: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n, component of every row: links are pairs with 100 * |A & B| >= percent * |A | B|.

    The result is a work table; those that led to it, sketches and all, are deleted.
    """
    with scratch() as made:
        # by partition: hashed joins give their memory back when a task ends, so one task must not run many of them
        got = stash(_components(docs, words, percent, k, index, hot, id_col, text_col), "near-duplicates", by_partition=True)
        made.remove(got)
    return got


def _components(docs: DataFrame, words: int, percent: int, k: int, index: int, hot: int, id_col: str, text_col: str) -> DataFrame:
    sig = stash(signatures(docs, words, k, id_col, text_col), "signatures")
    classes = stash(sig.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "classes")
    reps = classes.where(F.col("id").isNotNull())
    m = _Matcher(docs, reps, words, percent, k, id_col, text_col)

    posted = stash(reps.select("id", "n", F.explode(F.slice("sketch", 1, index)).alias("v")), "posted")
    entries = stash(_lists(posted), "lists")
    drop(posted)
    m.add(m.star(entries))
    m.join_links()
    m.add(m.pairs(m.mixed(entries.where(F.col("c") <= hot).drop("c"))))
    long, n = _counted(m.mixed(entries.where(F.col("c") > hot)).select("id").distinct(), "crowded")
    drop(entries)
    if n:
        _sketches_of(m, long, index, hot)
    m.join_links()
    drop(long, *m.links)
    label = classes.select("n", "f1", "f2", "id").join(m.comps, "id", "left").select("n", "f1", "f2", F.coalesce("component", "id").alias("component"))
    return sig.select("id", "text_hash", "n", "f1", "f2").join(label, ["n", "f1", "f2"], "left").select("id", "text_hash", "n", F.coalesce("component", "id").alias("component"))


def _sketches_of(m: _Matcher, ids: DataFrame, index: int, hot: int) -> None:
    """Step 3: links among the classes `ids` by their whole sketches."""
    these = m.reps.join(small(ids, BROADCAST_BYTES), "id", "left_semi").select("id", "n", "sketch")
    if not is_small(ids, BROADCAST_BYTES):  # shuffled once, not for each use
        these = stash(these, "crowded-sketches")
    entries = stash(_lists(these.select("id", "n", F.explode("sketch").alias("v"))), "sketch-lists")
    if hasattr(these, "_fq_stash"):
        drop(these)
    m.add(m.star(entries).union(m.pairs(m.mixed(entries.where(F.col("c") <= hot).drop("c")))).distinct())
    m.join_links()
    held = m.mixed(entries.where(F.col("c") > hot)).groupBy("id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    need = F.least(F.lit(_least_shared(m.k, m.percent)), F.ceil(F.col("n") * m.percent / 100))
    left, n = _counted(held.where(F.col("shared") >= need).select("id"), "templates")
    drop(entries)
    if n:
        _prefixes_of(m, left)
    drop(left)


def _prefixes_of(m: _Matcher, ids: DataFrame) -> None:
    """Step 4: links among the classes `ids` by the rarest shingles of their whole sets."""
    percent = m.percent
    each = stash(m.whole_sets(ids).dropDuplicates(["id"]).select("id", "n", F.explode("hashes").alias("v")), "shingles")
    known = stash(_lists(each), "shared-shingles")  # shingles of one class only can join nothing; how many precede matters alone
    drop(each)
    single = known.groupBy("id").agg(F.count("*").alias("shared"))
    place = Window.partitionBy("id").orderBy("c", "v")
    ranked = known.withColumn("i", F.row_number().over(place)).join(single, "id").withColumn("i", F.col("i") - 1 + F.col("n") - F.col("shared"))
    prefix = stash(ranked.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("v", "id", "n", "i"), "prefix")
    drop(known)
    m.add(m.star(prefix))
    m.join_links()
    overlap = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    m.add(m.pairs(m.mixed(prefix), F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= overlap))
    drop(prefix)
