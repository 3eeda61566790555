"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Postings (term, document, position) are stored for the terms a query needs. A phrase is found by intersecting the
offset-adjusted lists of its terms, rarest first: a posting of a term at offset o of an item puts the item at
position - o of the document; places that enough rare terms agree on are candidates, and a candidate counts
when the words there are the phrase. Proximity matches intersect the same postings within a distance.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Null and empty texts have none.
An item without words never matches; items with null ids match but are not listed. Documents are rows: rows with
the same id and text have the same result, rows with the same id and other texts their own. An empty benchmark
or corpus gives no hits or no rows. Columns other than the ids and the texts are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, small, stash

#: What ends a word, before A-Z are lower-cased (they belong to words then).
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A side is broadcast if it is at most so large on disk, as its files or the optimiser's bound say; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def _lower(w: Column) -> Column:
    """A-Z only: lower() would also change letters beyond ASCII, so words with those are translated."""
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def raw_words(text: Column) -> Column:
    """Words in order, not lower-cased; the first or last entry may be empty, as split() leaves them."""
    return F.split(F.coalesce(text, F.lit("")), _NOT_WORD)


def count_words(raw: Column) -> Column:
    last = F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), 1).otherwise(0)
    return (F.size(raw) - F.when(F.element_at(raw, 1) == "", 1).otherwise(0) - last).cast("bigint")


def _small(df: DataFrame) -> DataFrame:
    return small(df, BROADCAST_BYTES)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d (id), h (a hash of the text, which tells rows with one id apart), text."""
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))


def tokens(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, pos, term of every word of rows.text."""
    each = rows.select(*keep, F.posexplode(raw_words(F.col("text"))).alias("pos", "w")).where("w != ''")
    return each.select(*keep, "pos", _lower(F.col("w")).alias("term"))


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: term, d, h, pos for the given distinct terms."""
    return stash(tokens(rows, "d", "h").join(_small(stash(terms, "terms")), "term"), "postings")


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item (a number for the row), item_id, words of every item with words."""
    words = F.transform(F.filter(raw_words(F.col(text_col)), lambda w: w != ""), _lower)
    return stash(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), words.alias("words")).where(F.size("words") > 0), "items")


def frequencies(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term, f: how often each of the distinct terms occurs."""
    return stash(tokens(rows).join(_small(stash(terms, "terms")), "term").groupBy("term").agg(F.count("*").alias("f")), "frequencies")


def _bit(o: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (o % 64).cast("int"))


def _phrases(items: DataFrame, freq: DataFrame, length: int, rare: int) -> DataFrame:
    """item, item_id, words, n (phrase length), windows: array of (s: start, need: offsets of its `rare` rarest terms, mask: their bits modulo 64); only phrases whose terms all occur."""
    each = items.select("item", F.posexplode("words").alias("o", "term")).join(_small(freq), "term", "left")
    listed = each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("o", F.coalesce("f", F.lit(0)).alias("f")))).alias("fs"))
    rows = items.join(listed, "item").withColumn("n", F.least(F.lit(length), F.size("words")))
    window = lambda s: F.slice(F.col("fs"), s + 1, F.col("n"))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda s: F.forall(window(s), lambda x: x["f"] > 0))
    rarest = lambda s: F.transform(F.slice(F.array_sort(F.transform(window(s), lambda x: F.struct(x["f"].alias("f"), x["o"].alias("o")))), 1, rare), lambda x: x["o"])
    out = rows.withColumn("windows", F.transform(starts, lambda s: F.struct(s.alias("s"), rarest(s).alias("need"))))
    mask = lambda need: F.aggregate(need, F.lit(0).cast("bigint"), lambda m, o: m.bitwiseOR(_bit(o)))
    out = out.withColumn("windows", F.transform("windows", lambda w: F.struct(w["s"].alias("s"), w["need"].alias("need"), mask(w["need"]).alias("mask"))))
    return stash(out.where(F.size("windows") > 0).select("item", "item_id", "words", "n", "windows"), "phrases")


def phrase_candidates(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """d, h, item, shift, starts: places where a phrase's rare terms all stand at their offsets.

    Postings become places (document, item, position - offset); a place gathers the offsets that agree on it as bits
    modulo 64, which no two offsets of one window share, so no window whose terms all agree is missed.
    """
    least = F.array_min(F.transform("windows", lambda w: F.size(w["need"])))
    needed = phrases.select("item", least.alias("k"), F.explode(F.array_distinct(F.flatten(F.transform("windows", lambda w: w["need"])))).alias("o"), "words")
    offsets = stash(needed.select("item", "k", _bit(F.col("o")).alias("bit"), "o", F.element_at("words", F.col("o") + 1).alias("term")), "offsets")
    index = postings(rows, offsets.select("term").distinct())
    at = index.join(_small(offsets), "term").select("d", "h", "item", (F.col("pos") - F.col("o")).alias("shift"), "bit", "k")
    met = at.groupBy("d", "h", "item", "shift").agg(F.bit_or("bit").alias("hits"), F.min("k").alias("k")).where(F.bit_count("hits") >= F.col("k"))
    met = met.join(_small(phrases.select("item", "windows")), "item")
    whole = F.transform(F.filter("windows", lambda w: w["mask"].bitwiseAND(F.col("hits")) == w["mask"]), lambda w: w["s"])
    return stash(met.withColumn("starts", whole).where(F.size("starts") > 0).select("d", "h", "item", "shift", "starts"), "candidates")


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = 10, rare: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc id, text_hash, n_words, matches of every document.

    matches: array of (item_id, n: words, first: numbers of the first words) for every item of whose phrases of
    `length` consecutive words (a shorter item is one phrase) the document holds any.
    """
    rows = keyed(docs, id_col, text_col)
    with scratch() as made:
        items = item_words(items, item_col, item_text_col)
        freq = frequencies(rows, items.select(F.explode("words").alias("term")).distinct())
        phrases = _phrases(items, freq, length, rare)
        places = phrase_candidates(rows, phrases).select("d", "h", "item", F.explode("starts").alias("s"), "shift")
        # an item's words once for each document, beside the places to compare; then one row for each document
        by_item = places.groupBy("d", "h", "item").agg(F.collect_list(F.struct((F.col("shift") + F.col("s")).cast("int").alias("p"), F.col("s").cast("int").alias("s"))).alias("at"))
        found = by_item.join(_small(phrases.select("item", "item_id", "words", "n")), "item")
        grouped = stash(found.groupBy("d", "h").agg(F.collect_list(F.struct("item_id", "words", "n", "at")).alias("c")), "candidates-by-document")
        made.remove(grouped)
    both = rows.withColumn("raw", raw_words(F.col("text"))).join(_small(grouped).withColumnRenamed("d", "cd").withColumnRenamed("h", "ch"), F.col("d").eqNullSafe(F.col("cd")) & (F.col("h") == F.col("ch")), "left")
    words = F.transform("raw", _lower)
    lead = F.when(F.element_at("raw", 1) == "", 1).otherwise(0)
    both = both.select("d", "h", count_words(F.col("raw")).alias("n_words"), F.when(F.col("c").isNotNull(), words).alias("w"), lead.alias("lead"), "c")
    there = lambda c, x: (x["p"] >= 0) & (F.slice(F.col("w"), F.greatest(F.lit(1), x["p"] + 1), c["n"]) == F.slice(c["words"], x["s"] + 1, c["n"]))
    match = lambda c: F.struct(c["item_id"].alias("item_id"), c["n"].alias("n"), F.transform(F.filter(c["at"], lambda x: there(c, x)), lambda x: (x["p"] - F.col("lead")).cast("bigint")).alias("first"))
    matches = F.filter(F.transform("c", match), lambda m: F.size(m["first"]) > 0)
    return both.select(F.col("d").alias(id_col), F.col("h").alias("text_hash"), "n_words", matches.alias("matches"))


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, rare: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_hash: bool = False) -> DataFrame:
    """id_col, with keep_hash also text_hash, n_words, n_hit (words inside any match), items (matching item ids as strings, sorted) of every document."""
    m = phrase_matches(docs, items, length, rare, id_col, text_col, item_col, item_text_col)
    none = F.array().cast("array<string>")
    # words in the union of the matches' spans, in order: what each adds beyond the end so far
    spans = F.array_sort(F.flatten(F.transform("matches", lambda m: F.transform(m["first"], lambda x: F.struct(x.alias("a"), (x + m["n"]).alias("b"))))))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    words = F.aggregate(spans, zero, lambda t, x: F.struct(F.greatest(t["end"], x["b"]).alias("end"), (t["n"] + F.greatest(F.lit(0).cast("bigint"), x["b"] - F.greatest(t["end"], x["a"]))).alias("n")), lambda t: t["n"])
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda x: x["item_id"].cast("string")), lambda x: x.isNotNull())))
    has = F.size(F.coalesce("matches", F.array())) > 0
    return m.select(id_col, *(["text_hash"] if keep_hash else []), "n_words", F.when(has, words).otherwise(0).cast("bigint").alias("n_hit"), F.when(has, ids).otherwise(none).alias("items"))


def proximity_matches(docs: DataFrame, queries: DataFrame, distance: int, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text_col: str = "text") -> DataFrame:
    """query_col, id_col, first, last: the places where all of a query's distinct words stand within `distance` words.

    Around each posting of the query's rarest word, a window slides over the postings at most `distance` away; first and
    last bound every window that holds that posting and all words and could not start later or end earlier. Each
    place is given once. Queries without words match nothing.
    """
    rows = keyed(docs, id_col, text_col)
    q = item_words(queries, query_col, query_text_col).select("item", F.col("item_id").alias("q"), F.explode(F.array_distinct("words")).alias("term"))
    q = stash(q, "query-terms")
    freq = frequencies(rows, q.select("term").distinct())
    ranked = q.join(_small(freq), "term").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("f", "term")))
    sizes = q.groupBy("item").agg(F.count("*").alias("k"))
    index = postings(rows, q.select("term").distinct()).join(_small(ranked), "term")
    rarest = index.where("r = 1").select("item", "d", "h", F.col("pos").alias("p0"), F.explode(F.array(F.expr(f"cast(floor(pos / {distance + 1}) - 1 as bigint)"), F.expr(f"cast(floor(pos / {distance + 1}) as bigint)"), F.expr(f"cast(floor(pos / {distance + 1}) + 1 as bigint)"))).alias("cell"))
    near = index.select("item", "q", "d", "h", "term", "pos", F.expr(f"cast(floor(pos / {distance + 1}) as bigint)").alias("cell"))
    met = rarest.join(near, ["item", "d", "h", "cell"]).where(F.abs(F.col("pos") - F.col("p0")) <= distance)
    around = met.groupBy("item", "q", "d", "h", "p0").agg(F.collect_set(F.struct("pos", "term")).alias("near"))
    starts = around.withColumn("first", F.explode(F.filter("near", lambda x: x["pos"] <= F.col("p0"))["pos"]))
    ahead = starts.withColumn("x", F.explode("near")).where((F.col("x.pos") >= F.col("first")) & (F.col("x.pos") <= F.col("first") + distance))
    ends = ahead.groupBy("item", "q", "d", "h", "p0", "first", "x.term").agg(F.min("x.pos").alias("pos"))
    windows = ends.groupBy("item", "q", "d", "h", "p0", "first").agg(F.count("*").alias("m"), F.greatest("p0", F.max("pos")).alias("last")).join(_small(sizes), "item")
    whole = windows.where((F.col("m") == F.col("k")) & (F.col("last") - F.col("first") <= distance))
    places = whole.groupBy("item", "q", "d", "h", "p0", "last").agg(F.max("first").alias("first")).select("item", "q", "d", "h", "first", "last").distinct()
    return places.select(F.col("q").alias(query_col), F.col("d").alias(id_col), "first", "last")
