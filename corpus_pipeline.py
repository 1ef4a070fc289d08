"""Corpus cleaning pipeline: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasecast.llm import decontaminate, fair_mix, jaccard_join, language, secrets
from phrasecast.llm.common import crc_remainder, table
from phrasecast.session import scratch_path

#: A document is rejected when its language cannot be told (no letters) or its best language is less likely than this.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, under a model learned from the rows that are not held out."""
    model = language.train(docs.filter(crc_remainder("doc_id", 4) != 2))
    known = language.identify(docs, model).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return known.select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_first(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` follows the text where it changed."""
    clean = secrets.redact(docs.withColumn("__before", F.col("text")))
    same = F.col("text").eqNullSafe(F.col("__before"))
    counted = F.when(same, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", counted).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its size and how many of its words the mix takes."""
    return fair_mix.mix(docs).documents.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", identify_language),
    ("near_copies", join_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: The language model and the components are no SQL; no test compares every stage with brute force yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
