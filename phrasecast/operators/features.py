"""Feature blocks in long form ``(row_id, feature, value)`` and their assembly into vectors.

Fitted state (vocabulary, category levels, scales) is a table, so it can be written, read back and
joined; the join is what applies it to new rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from phrasecast.functions.scan import global_index, skew_join
from phrasecast.functions.text import WORD
from phrasecast.session import materialize

BROADCAST_ROWS = 200_000  # a vocabulary or index of at most this many rows may be broadcast (some ten MB)
TEXT_BYTES = 8 * 1024 * 1024  # text that one task takes apart; its n-grams need some fifty times as much


def _by_feature(
    cells: DataFrame, table: DataFrame, key: str, rows: int | None, hot: DataFrame | None = None
) -> DataFrame:
    """Join on a term or feature: broadcast when the table is known to be small, else salted.

    The most frequent terms occur in nearly every row, so the shuffled form spreads them.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return cells.join(F.broadcast(table), key)
    return skew_join(cells, table, key, spread=["row_id"], hot=hot)


def word_tokens(text: Column, lowercase: bool = True) -> Column:
    """Runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(f"{WORD}{{2,}}"), F.lit(0))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, joined by a space; (n-1)-grams are extended by a token."""
    grams, kept = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            length = F.greatest(F.size(tokens) - n + 1, F.lit(0))
            grams = F.zip_with(
                F.slice(grams, 1, length), F.slice(tokens, n, length), lambda a, b: F.concat(a, F.lit(" "), b)
            )
        if n >= low:
            kept.append(grams)
    return F.concat(*kept)


def term_counts(
    docs: DataFrame, row_id: str, text: str, ngram_range: tuple[int, int] = (1, 2), lowercase: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """``(row_id, keep, term, tf)``; ``keep`` names columns that are alike in all rows of one id.

    The texts are partitioned by row id before they are taken apart, so the counts need no further
    shuffle: what moves is the text once, not an entry for each of its n-grams. The number of
    partitions follows the size of the texts (adaptive ones follow what is shuffled, which says little
    about the n-grams), so a task holds the n-grams of some ``TEXT_BYTES``.
    """
    keyed = docs.select(F.col(row_id).alias("row_id"), *keep, F.coalesce(text, F.lit("")).alias("t"))
    size = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES))
    tokens = keyed.repartition(parts, "row_id").select("row_id", *keep, word_tokens(F.col("t"), lowercase).alias("t"))
    terms = tokens.select("row_id", *keep, F.explode(ngrams(F.col("t"), *ngram_range)).alias("term"))
    return terms.groupBy("row_id", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(
    counts: DataFrame,
    n_docs: Column,
    min_df: int | float = 2,
    max_df: int | float = 0.9,
    max_features: int | None = None,
) -> DataFrame:
    """``(term, df, idf)`` of the kept terms; with a cap, those with the highest corpus frequency."""
    low = F.lit(min_df) if isinstance(min_df, int) else min_df * n_docs
    high = F.lit(max_df) if isinstance(max_df, int) else max_df * n_docs
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = terms.filter((F.col("df") >= low) & (F.col("df") <= high))
    if max_features is not None:
        kept = kept.orderBy(F.desc("cf"), "term").limit(max_features)
    return kept.select("term", "df", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(
    counts: DataFrame, vocabulary: DataFrame, max_features: int | None = None, sublinear: bool = True, normalise: bool = True,
    slices: int = 1,
) -> DataFrame:
    """``(row_id, feature, value)``: L2-normalised weights.

    ``max_features`` is the cap the vocabulary was fitted with. The norm is a window over one document;
    without ``normalise`` it is left to ``feature_vectors``, which gathers a document's cells anyway.
    With several ``slices`` (of the terms, by hash) a vocabulary that is not broadcast meets the counts
    slice by slice, each written before the next one starts: the cells of one slice are shuffled by
    term at a time, and none of them are on disk when those of all are shuffled by row. The counts are
    read once a slice, so they should be a written table.
    """
    tf = F.col("tf").cast("double")
    weight = (1 + F.log(tf) if sublinear else tf) * F.col("idf")
    # A term has df rows in the counts, so fewer than 1000 terms hold more than 1/1000 of them.
    total = vocabulary.agg(F.sum("df").alias("n")).scalar()
    hot = vocabulary.filter(F.col("df") * 1000 > total)

    def weighed(cells: DataFrame, terms: DataFrame, frequent: DataFrame) -> DataFrame:
        return _by_feature(cells, terms, "term", max_features, frequent).select("row_id", "term", weight.alias("w"))

    if slices > 1 and (max_features is None or max_features > BROADCAST_ROWS):
        place = F.pmod(F.xxhash64("term"), F.lit(slices))
        parts = [materialize(weighed(*(x.filter(place == i) for x in (counts, vocabulary, hot))), "weights") for i in range(slices)]
        raw = reduce(DataFrame.unionByName, parts)
    else:
        raw = weighed(counts, vocabulary, hot)
    if not normalise:
        return raw.select("row_id", F.col("term").alias("feature"), F.col("w").alias("value"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row_id")))
    return raw.select("row_id", F.col("term").alias("feature"), (F.col("w") / norm).alias("value"))


def _levels(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in columns]
    return df.select(F.col(row_id).alias("row_id"), *texts).unpivot(["row_id"], list(columns), "column", "level")


def fit_one_hot(df: DataFrame, row_id: str, columns: Sequence[str], drop: str | None = None) -> DataFrame:
    """Known levels ``(column, level, kept)``; ``drop`` is None, ``first`` or ``if_binary``."""
    if drop not in (None, "first", "if_binary"):
        raise ValueError(f"unsupported drop: {drop}")
    levels = _levels(df, row_id, columns).groupBy("column", "level").agg(F.lit(True).alias("kept"))
    if drop is None:
        return levels
    firsts = levels.groupBy("column").agg(F.min("level").alias("first"), F.count(F.lit(1)).alias("n"))
    dropped = F.col("level") == F.col("first")
    if drop == "if_binary":
        dropped = dropped & (F.col("n") == 2)
    return levels.join(firsts, "column").select("column", "level", (~dropped).alias("kept"))


def one_hot(
    df: DataFrame, row_id: str, columns: Sequence[str], levels: DataFrame, unknown: str = "ignore"
) -> DataFrame:
    """``(row_id, feature, value)`` with value 1; unknown levels give no row, or fail with ``error``."""
    if unknown not in ("ignore", "error"):
        raise ValueError(f"unsupported handling of unknown levels: {unknown}")
    seen = _levels(df, row_id, columns)
    joined = seen.join(levels, ["column", "level"], "left")
    kept = F.col("kept")
    if unknown == "error":
        message = F.concat(F.lit("unknown level "), F.col("level"), F.lit(" of "), F.col("column"))
        kept = F.coalesce(kept, F.raise_error(message).cast("boolean"))
    return joined.filter(kept).select(
        "row_id", F.concat_ws("_", "column", "level").alias("feature"), F.lit(1.0).alias("value")
    )


def embedding_features(
    df: DataFrame, row_id: str, embeddings: DataFrame, key: str, vector: str = "embedding", normalise: bool = True
) -> DataFrame:
    """Precomputed vectors of the rows, L2-normalised, one feature per dimension."""
    joined = df.select(F.col(row_id).alias("row_id")).join(
        embeddings.select(F.col(key).alias("row_id"), F.col(vector).cast("array<double>").alias("v")), "row_id"
    )
    if normalise:
        joined = joined.withColumn("v", unit_vector(F.col("v")))
    dims = joined.select("row_id", F.posexplode("v").alias("i", "value"))
    return dims.select("row_id", F.format_string("embedding_%05d", "i").alias("feature"), "value")


def embedding_names(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """One feature name per dimension of the widest vector."""
    width = embeddings.agg(F.max(F.size(vector)).alias("n")).filter("n > 0")
    dims = width.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return dims.select(F.format_string("embedding_%05d", "i").alias("feature"))


def unit_vector(v: Column) -> Column:
    """Vector divided by its L2 norm; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def numeric_features(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Plain numeric columns (merged news features) as features; NULL is 0 and gives no row."""
    values = [F.col(c).cast("double").alias(c) for c in columns]
    long = df.select(F.col(row_id).alias("row_id"), *values).unpivot(["row_id"], list(columns), "feature", "value")
    return long.filter("value IS NOT NULL AND value <> 0")


def union_features(blocks: dict[str, DataFrame]) -> DataFrame:
    """All blocks, feature names prefixed with the block name."""
    parts = [
        df.select("row_id", F.concat(F.lit(f"{name}__"), F.col("feature")).alias("feature"), "value")
        for name, df in blocks.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_scales(features: DataFrame, n_rows: Column) -> DataFrame:
    """``(feature, scale)``: population standard deviation with absent values as 0; constants scale by 1."""
    sums = features.groupBy("feature").agg(
        F.count("value").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    # the spread of the present values, and the one between them and the absent zeros
    variance = F.col("k") / n_rows * (F.col("v") + (n_rows - F.col("k")) / n_rows * F.col("m") * F.col("m"))
    least = F.greatest(F.lit(1e-15), F.pow(F.col("m") * 1e-12, F.lit(2)))
    return sums.select("feature", F.when(variance > least, F.sqrt(variance)).otherwise(F.lit(1.0)).alias("scale"))


def scale_features(features: DataFrame, scales: DataFrame) -> DataFrame:
    """Divide by the scale, without centring; features without a scale are dropped."""
    joined = _by_feature(features, scales, "feature", None)
    return joined.select("row_id", "feature", (F.col("value") / F.col("scale")).alias("value"))


def text_names(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select(F.col("term").alias("feature"))


def category_names(levels: DataFrame) -> DataFrame:
    return levels.filter("kept").select(F.concat_ws("_", "column", "level").alias("feature"))


def union_names(blocks: dict[str, DataFrame]) -> DataFrame:
    """Feature names of all blocks, taken from their fitted tables, so no row is scanned for them."""
    out = None
    for name, df in blocks.items():
        part = df.select(F.concat(F.lit(f"{name}__"), F.col("feature")).alias("feature"))
        out = part if out is None else out.unionByName(part)
    return out


def feature_index(names: DataFrame) -> DataFrame:
    """``(feature, index)``: places in the vector, in feature-name order."""
    return global_index(names.select("feature").distinct(), ["feature"], "index")


def feature_vectors(rows: DataFrame, features: DataFrame, index: DataFrame, size: int, unit: str | None = None) -> DataFrame:
    """``rows(row_id, ...)`` with a sparse vector column ``features``; unknown features are dropped.

    The features of a row whose names start with ``unit`` are divided by their L2 norm.
    The vectors are written to the shared folder in the storage form of the vector type and read back
    as vectors: no Python touches the rows, and the many passes of a solver read a plain table.
    """
    scaled = F.startswith("feature", F.lit(unit)) if unit else F.lit(False)
    cells = _by_feature(features, index, "feature", size).select("row_id", F.col("index").cast("int"), "value", scaled.alias("scaled"))
    packed = cells.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("index", "value", "scaled"))).alias("__cells"),
        F.sqrt(F.sum(F.when(F.col("scaled"), F.col("value") * F.col("value")))).alias("__norm"),
    )
    none = F.array().cast("array<struct<index:int,value:double,scaled:boolean>>")
    joined = rows.join(packed, "row_id", "left").withColumn("__cells", F.coalesce("__cells", none))
    stored = joined.select(
        *rows.columns,
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(size).alias("size"),
            F.transform("__cells", lambda x: x["index"]).alias("indices"),
            F.transform("__cells", lambda x: F.when(x["scaled"], x["value"] / F.col("__norm")).otherwise(x["value"])).alias("values"),
        ).alias("features"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("features", VectorUDT())])
    return materialize(stored, "vectors", schema)
