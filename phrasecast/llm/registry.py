"""The queries of the training-data operators: name -> (function, SQL twin or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phrasecast.llm import arc, bpe, decontaminate, fair_mix, host_quality, jaccard_join, language, licenses, runs, secrets, substring, toxicity, trie
from phrasecast.llm.common import table


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.report(table(spark, sf, "documents"))


def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(table(spark, sf, "documents"))


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.report(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_arc_to_warc(spark: SparkSession, sf: str) -> DataFrame:
    return arc.round_trip(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.report(table(spark, sf, "documents"))


def op8_fair_mix(spark: SparkSession, sf: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op9_host_quality(spark: SparkSession, sf: str) -> DataFrame:
    return host_quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_substring(spark: SparkSession, sf: str) -> DataFrame:
    return substring.report(table(spark, sf, "documents"))


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.report(table(spark, sf, "documents"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.report(table(spark, sf, "conversations"))


def op13_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.report(table(spark, sf, "documents"))


MIX_QUERY = (
    "WITH docs AS (SELECT doc_id, text, source FROM documents)," + fair_mix.MIX_SQL
    + "SELECT doc_id, size, source_size, target, taken FROM mixed"
)

QUERIES = {
    "op1_decontaminate": (op1_decontaminate, None),
    "op2_language": (op2_language, None),
    "op3_secrets": (op3_secrets, None),
    "op4_jaccard_join": (op4_jaccard_join, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_arc_to_warc": (op6_arc_to_warc, None),
    "op7_licenses": (op7_licenses, None),
    "op8_fair_mix": (op8_fair_mix, MIX_QUERY),
    "op9_host_quality": (op9_host_quality, None),
    "op10_substring": (op10_substring, None),
    "op11_byte_bpe": (op11_byte_bpe, None),
    "op12_prefix_trie": (op12_prefix_trie, None),
    "op13_runs": (op13_runs, None),
}
