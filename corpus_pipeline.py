"""A corpus pipeline: language ID, near-duplicate removal, repeat removal, decontamination, token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of `documents`.

A null text has no language and goes in the first stage, as do empty texts and those without a letter; later stages take nulls
too (no words, no bytes, no ids). Rows are judged by id and text, so repeated rows share a fate and another text under a
dropped row's id stays. Empty tables give empty tables. Columns beside those of `documents` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import bottomk, bpe, decontaminate, ppm, repeats
from framequarry.llm.common import held_out, small, stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be determined go; a missing lang is filled with the prediction."""
    model = ppm.train(docs, ~held_out("doc_id"))
    got = ppm.predict(docs, model, keep=COLUMNS)
    return got.where(F.col("lang_pred") != ppm.UNDETERMINED).withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays.

    Rows go by their id and text: another text that bears a dropped row's id stays. Rows without an id stay.
    """
    got = bottomk.near_duplicates(docs, words=5, percent=80)
    return _without(docs, got.where("id != component").select(F.col("id").alias("doc_id"), "text_hash"), "dropped")


def _without(docs: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """docs without the rows (doc_id, text_hash), which are broadcast if their table is small, and else joined by a shuffle."""
    gone = stash(rows.distinct().select(F.col("doc_id").alias("gone_id"), "text_hash"), label)
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (bottomk.text_hash(F.col("text")) == F.col("text_hash"))
    return docs.select(COLUMNS).join(small(gone, bottomk.BROADCAST_BYTES), same, "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out of the later ones; characters cut in two go whole."""
    rest = ["lang", "source", "n_chars"]
    got = repeats.remove_repeats(docs.withColumn("no_text", F.col("text").isNull()), with_text=True, keep=(*rest, "no_text"))
    text = F.when(F.col("no_text"), None).otherwise(_valid(F.col("kept")))
    got = got.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return got.select(COLUMNS)


def _valid(kept: Column) -> Column:
    """Bytes as text without the pieces of characters that a cut has left."""
    plain = kept.cast("string")
    return F.when(F.is_valid_utf8(plain), plain).otherwise(F.replace(F.make_valid_utf8(plain), F.lit("\ufffd"), F.lit("")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's words go, by their id and text; rows without an id are judged by their text alone."""
    got = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep_hash=True)
    return _without(docs, got.where("n_hit > 0").select("doc_id", "text_hash"), "contaminated")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every document."""
    import public_tokenizers

    got = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", token_ids),
]

#: SQL cannot say the language model, the components or the repeats; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
