"""Quality rules judged by host: rule failures per domain, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.functions.scan import skew_join
from phrasecast.llm.common import blank_free, let, without, words
from phrasecast.session import materialize

SYMBOLS = "#*$%&|<>"
#: Fixed limits of the rules: words of a short text, share of repeated words, of repeated lines, of symbols.
MIN_WORDS, MAX_REPEATED, MAX_SAME_LINES, MAX_SYMBOLS = 50, 0.5, 0.3, 0.3
RULES = ("short", "repetitive", "same_lines", "symbols")


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in the array (the first one included).

    Window hashes are sorted inside the row, so equal windows are neighbours; the covered words follow from the gaps
    between the sorted positions.
    """

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(
            at, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("p"))
        )

    def positions(s: Column) -> Column:
        same = lambda x, j: F.get(s, j).getField("h").eqNullSafe(x.getField("h"))
        twice = F.transform(s, lambda x, i: F.when((same(x, i + 1)) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))), x.getField("p")))
        return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))

    def covered(ps: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda a, p: F.struct(
            (a.getField("n") + F.least(F.lit(width), p - a.getField("last"))).alias("n"), p.alias("last")
        )
        return F.aggregate(ps, start, step, lambda a: a.getField("n"))

    found = let(tokens, lambda w: let(F.sort_array(grams(w)), lambda s: let(positions(s), covered)))
    return F.when(F.size(tokens) > width, found).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: the counts that the rules look at, and which rules it fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"),
        words(F.col(text_col)).alias("tokens"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: blank_free(x) != "")
    out = out.select(
        "doc_id", "host", F.size("tokens").cast("long").alias("n_words"),
        F.char_length(blank_free(F.col("text"))).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("same"), F.size(x).alias("n"))).alias("lines"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
    )
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", F.col("lines.same").alias("n_dup_lines"), "n_repeat_words",
        F.array(
            F.col("n_words") < MIN_WORDS,
            F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"),
            F.col("lines.same") > MAX_SAME_LINES * F.col("lines.n"),
            F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        ).alias("fails"),
    )


def host_verdicts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Per host: documents, shrunk failure rate of each rule, and whether the host is kept.

    Prior of a rule: the beta distribution whose mean and variance are those of the hosts' rates (method of moments;
    with fewer than two hosts, or no spread, it counts as one document at the mean). The shrunk rate is the posterior
    mean. A host goes when the shrunk rate of any rule is above ``max_rate``.
    """
    fails = {f"f_{r}": F.sum(F.get("fails", F.lit(i)).cast("long")) for i, r in enumerate(RULES)}
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in fails.items()])
    rates = {r: F.col(f"f_{r}") / F.col("n") for r in RULES}
    spread = hosts.agg(F.struct(*[
        x for r in RULES
        for x in ((F.sum(f"f_{r}") / F.sum("n")).alias(f"m_{r}"), F.var_samp(rates[r]).alias(f"v_{r}"))
    ]).alias("prior")).scalar()
    hosts = hosts.withColumn("prior", spread)
    for r in RULES:
        mean, var = F.col(f"prior.m_{r}"), F.col(f"prior.v_{r}")
        weight = F.when(var > 0, F.greatest(mean * (1 - mean) / var - 1, F.lit(1.0))).otherwise(F.lit(1.0))
        hosts = hosts.withColumn(f"rate_{r}", F.round((F.col(f"f_{r}") + mean * weight) / (F.col("n") + weight), 9))
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return hosts.select("host", "n", *[f"rate_{r}" for r in RULES], (worst <= max_rate).alias("host_kept"))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5
) -> DataFrame:
    """Counts, ``base_failed``, ``host_kept`` and ``kept`` of every document, in its rule's terms.

    A document is kept when it passes the two base rules (short, repetitive) and its host is kept. Null or empty text
    has no words and fails; null hosts are one host; repeated rows are judged alike and each comes back; an empty
    table gives an empty result; other columns are not read.
    """
    key = F.when(F.col("host").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("host")))
    measured = materialize(measures(docs, id_col, text_col, host_col), "quality").withColumn("key", key)
    hosts = materialize(host_verdicts(measured, max_rate), "hosts").withColumn("key", key)
    hot = hosts.filter(F.col("n") * 1000 > hosts.agg(F.sum("n")).scalar()).select("key")
    out = skew_join(measured, hosts.select("key", "host_kept"), "key", spread=["doc_id"], hot=hot)
    base = F.get("fails", F.lit(0)) | F.get("fails", F.lit(1))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
