"""The corpus pipeline: five stages, each of which applies one operator to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and rereads for the next.
No documents give none; further columns go through all stages but the last, whatever their names.
Stages may repeat doc_id from the mixing on. None of this is expressed in SQL (ORACLE_SQL): the tests hold the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import language, mixing, packing, quality, simhash
from folioscan.llm.common import fresh, materialize, read_table, unsent

#: A language's least score; the und of texts without a letter has 0.
LEAST_SCORE = 0.5
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) or without a language that stands out. The model
    learns from docs; without any stated language it predicts nothing, and no document stays. Equal texts share one
    decision; repeated rows stay repeated."""
    key = fresh("_key", docs)
    d = docs.withColumn(key, language.text_key(F.col("text")))
    p = language.predictions(d.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), language.train(docs))
    chosen = p.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(F.col("key").alias(key)).distinct()
    return d.join(unsent(chosen), key, "left_semi").select(*columns(docs))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents more perplexing than the trusted ones of their language, and those without symbols (null and
    empty texts). Without trusted documents all others stay. Repeated rows stay repeated."""
    judged = quality.judge(docs, read_table(spark, sf_dir, "labels"))
    return keep(docs, judged.where("keep"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near duplicates (null is the least), of ties that with
    the least hash of its text, and one of equal rows."""
    return keep(docs, simhash.near_duplicates(docs).where("first"), once=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their source's rate, in the global order of the copies; a null source is one of its own."""
    return mixing.shuffled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is an empty document of one id."""
    return packing.pack(docs)


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep(docs: DataFrame, chosen: DataFrame, once: bool = False) -> DataFrame:
    """The documents whose doc_id (null is a value) and text_hash were chosen. once: of rows equal in these, one. The
    columns are those of docs, whatever their names."""
    key, own, its = fresh("_hash", docs), fresh("_id", docs), fresh("_chosen", docs)
    c = chosen.select(F.col("doc_id").alias(own), F.col("text_hash").alias(its)).distinct()
    d = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    d = d.join(unsent(c), d.doc_id.cast("bigint").eqNullSafe(c[own]) & (d[key] == c[its]), "left_semi")
    return (d.dropDuplicates(["doc_id", key]) if once else d).select(*columns(docs))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", judge_quality),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
