"""A training corpus from raw documents: quality, language, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwork.llm import bagminhash, language, packing, quality, suffix_dedup
from shoalwork.llm._common import materialize, read_table, release
from shoalwork.llm.queries import tokenizer_path

LEAST_QUALITY = 0.3
LEAST_LANGUAGE = 0.2  # a score under this is a toss-up among the languages learnt; with two families of two it is never lower
MOST_UNLIKE = 1.0  # above this a text is in no language that was learnt


def whole(docs: DataFrame, *more) -> DataFrame:
    """Every row in one column, beside its text and more, so that no name of its columns can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", *more)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is 0.3 or more."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(whole(docs), model).filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in a language: with letters, and like one of those learnt."""
    told = language.predict(whole(docs), language.train(docs), ("row",))
    return told.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE) & (F.col("lang_unlike") <= MOST_UNLIKE)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, that of the least doc_id (and text hash, where texts share it); of equal rows one."""
    first = bagminhash.near_duplicates(docs).filter("leads").select(F.col("doc_id").alias("_first"), F.col("text_hash").alias("_hash")).distinct()
    rows = whole(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_own"))
    kept = rows.join(first, F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_own") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_id", "_own"]).select("row.*")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out strings of 200 bytes that occur more than once; n_chars follows the text."""
    rows = suffix_dedup.without_repeats(docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeated passages", repeats_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next, after which it is deleted there."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, *before)
        before = [docs]
    return docs
