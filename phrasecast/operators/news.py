"""News articles: normalise, filter, deduplicate, per-event features, provenance, join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasecast.functions.numbers import publication_time
from phrasecast.functions.phrases import vocabulary
from phrasecast.functions.scan import prefix_sums, skew_join
from phrasecast.functions.text import is_blank

REQUIRED = ["article_id", "event_id", "source", "published_at", "headline", "url", "body_text"]
# Where an article stands in its dump: file, split of the file, line inside the split.
POSITION = ["file", "split_start", "line_no"]
META_COLUMNS = ["news_snapshot_hash", "news_provenance"]


def record_columns(lines: DataFrame) -> DataFrame:
    """Columns of parsed article lines: required fields, tags, provenance and the rest as a map."""
    field = F.col("record")
    tags = field["tags"]
    listed = F.when(tags.startswith("["), F.from_json(tags, "array<string>"))
    core = [*REQUIRED, "tags", "provenance"]
    return lines.filter(field.isNotNull()).select(
        *[field[name].alias(name) for name in REQUIRED],
        F.coalesce(listed, F.when(tags != "", F.array(tags)), F.array().cast("array<string>")).alias("tags"),
        field["provenance"].alias("provenance"),
        F.map_filter(field, lambda k, v: ~k.isin(core)).alias("extras"),
        *POSITION,
    )


def missing_fields() -> Column:
    """Names of the required fields that are NULL or empty."""
    return F.filter(
        F.array(*[F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) == "", F.lit(n)) for n in REQUIRED]),
        lambda n: n.isNotNull(),
    )


def normalise_articles(articles: DataFrame, ingest_source: str, ingested_at: str) -> DataFrame:
    """Complete articles with text columns; everything else goes to ``extras``.

    ``ingested_at`` and ``ingest_source`` are added to extras where the article has none. Incomplete
    rows are left out and can be read from ``rejected_articles``.
    """
    none = F.create_map().cast("map<string,string>")
    no_tags = F.array().cast("array<string>")
    if "tags" not in articles.columns:
        tags = no_tags
    elif articles.schema["tags"].dataType.typeName() == "array":
        tags = F.coalesce(F.col("tags").cast("array<string>"), no_tags)
    else:
        tags = F.when(F.col("tags") != "", F.array(F.col("tags").cast("string"))).otherwise(no_tags)

    known = {*REQUIRED, "tags", "provenance", "extras", *POSITION}
    loose = [F.struct(F.lit(c), F.col(c).cast("string")) for c in articles.columns if c not in known]
    extras = F.map_from_entries(F.array(*loose)) if loose else none
    if "extras" in articles.columns:
        given = F.coalesce(F.col("extras"), none)  # what stands under "extras" wins over a loose column of that name
        extras = F.map_concat(F.map_filter(extras, lambda k, _: ~F.map_contains_key(given, k)), given)
    extras = F.map_filter(extras, lambda _, v: v.isNotNull())
    defaults = F.create_map(F.lit("ingested_at"), F.lit(ingested_at), F.lit("ingest_source"), F.lit(ingest_source))
    unset = F.map_filter(defaults, lambda k, _: ~F.map_contains_key("extras", k))
    has_provenance = "provenance" in articles.columns

    complete = articles.filter(F.size(missing_fields()) == 0).select(
        *[F.col(n).cast("string").alias(n) for n in REQUIRED],
        tags.alias("tags"),
        (F.col("provenance") if has_provenance else F.lit(None)).cast("string").alias("provenance"),
        extras.alias("extras"),
        *[c for c in POSITION if c in articles.columns],
    )
    return complete.withColumn("extras", F.map_concat("extras", unset)).withColumn(
        "ingest_source", F.col("extras")["ingest_source"]
    )


def rejected_articles(articles: DataFrame) -> DataFrame:
    """Articles with missing required fields, which ones in ``missing``."""
    return articles.withColumn("missing", missing_fields()).filter(F.size("missing") > 0)


def within_window(articles: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Published within [since, until]; rows whose time cannot be read pass."""
    at = publication_time(F.col("published_at"))
    out = articles
    if since is not None:
        out = out.filter(at.isNull() | (at >= F.lit(since).cast("timestamp")))
    if until is not None:
        out = out.filter(at.isNull() | (at <= F.lit(until).cast("timestamp")))
    return out


def first_per_source(articles: DataFrame, n: int, source: str = "ingest_source") -> DataFrame:
    """The first ``n`` articles of each source (NULL is one, too) in file and line order.

    Each task keeps its own first ``n`` per source before anything is shuffled.
    """
    place = F.row_number().over(Window.partitionBy(source).orderBy(*POSITION))
    return articles.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def totals_per_source(articles: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Articles per source; with ``sources`` (a table ``ingest_source``) also those without any, as 0."""
    found = articles.groupBy("ingest_source").agg(F.count(F.lit(1)).alias("articles"))
    if sources is None:
        return found
    every = sources.select("ingest_source").distinct().join(found, "ingest_source", "left")
    return every.select("ingest_source", F.coalesce("articles", F.lit(0).cast("bigint")).alias("articles"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def news_target_column(column: str) -> str:
    return f"news_{column}_count"


def measure_articles(articles: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Per article: the small columns the features need; the body stays behind."""
    whole = F.concat(_text("headline"), F.lit("\n"), _text("body_text"))
    return articles.select(
        *[_text(n).alias(n) for n in ("article_id", "event_id", "source", "headline", "url")],
        F.col("published_at").cast("string").alias("published_at"),
        publication_time(F.col("published_at")).alias("published_time"),
        F.char_length(_text("body_text")).cast("bigint").alias("body_length"),
        *[p.count(whole).cast("bigint").alias(news_target_column(p.column)) for p in vocabulary(terms)],
        *POSITION,
    )


def first_copies(measured: DataFrame) -> DataFrame:
    """The first copy of each article id in file and line order.

    An id is claimed before its event is looked at, so a first copy without an event also removes its
    later copies. The minimum combines on the map side: copies of one id leave a task as one row.
    """
    best = F.min_by(F.struct(*measured.columns), F.struct(*POSITION))
    named = measured.filter(F.col("article_id") != "")
    kept = named.groupBy(F.col("article_id").alias("__id")).agg(best.alias("a")).select("a.*")
    return kept.filter(F.col("event_id") != "")


def event_features(copies: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Per event: article and source counts, mean body length, first and last time, phrase counts."""
    counts = [news_target_column(p.column) for p in vocabulary(terms)]
    return copies.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("news_article_count"),
        F.countDistinct("source").alias("news_unique_sources"),
        F.avg("body_length").alias("news_average_body_length"),
        F.min("published_time").alias("news_first_published_at"),
        F.max("published_time").alias("news_latest_published_at"),
        *[F.sum(c).alias(c) for c in counts],
    )


def provenance_rows(copies: DataFrame) -> DataFrame:
    """One row per used article with its place inside the event (from 0, file and line order)."""
    blocks = {name: F.col(name) for name in POSITION[:-1]}
    placed = prefix_sums(copies, ["event_id"], blocks, POSITION[-1:], {"place": F.lit(1).cast("bigint")})
    return placed.select("event_id", "place", "article_id", "source", "headline", "url", "published_at")


def provenance_json(rows: DataFrame, part_size: int = 10000) -> DataFrame:
    """``(event_id, part, news_provenance)``: JSON lists of at most ``part_size`` articles.

    An event with more articles has several parts, so no list grows with the data.
    """
    item = F.struct("place", "article_id", "source", "headline", "url", "published_at")
    listed = F.array_sort(F.collect_list(item))
    bare = F.transform(
        listed,
        lambda x: F.struct(x["article_id"].alias("article_id"), x["source"].alias("source"),
                           x["headline"].alias("headline"), x["url"].alias("url"),
                           x["published_at"].alias("published_at")),
    )
    part = F.floor(F.col("place") / part_size).alias("part")
    return rows.groupBy("event_id", part).agg(F.to_json(bare).alias("news_provenance"))


def corpus_digest(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row ``news_snapshot_hash``: a digest of the multiset of non-blank lines.

    It does not depend on file order or partitioning and needs no sort: every line gives 48 bits, and
    count, sum and xor of them are hashed.
    """
    bits = F.conv(F.substring(F.sha2(F.col(line), 256), 1, 12), 16, 10).cast("bigint")
    kept = lines.filter(~is_blank(F.col(line))).select(bits.alias("b"))
    sums = kept.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("b").cast("decimal(28,0)")), F.lit(0)).alias("s"),
        F.coalesce(F.bit_xor("b"), F.lit(0)).alias("x"),
    )
    parts = [F.col(c).cast("string") for c in ("n", "s", "x")]
    return sums.select(F.sha2(F.concat_ws(":", *parts), 256).alias("news_snapshot_hash"))


def with_snapshot(features: DataFrame, digest: DataFrame) -> DataFrame:
    return features.withColumn("news_snapshot_hash", digest.scalar())


def snapshot_hash(news: DataFrame) -> DataFrame:
    """The snapshot hash of a feature table: that of its first event that has one."""
    return news.agg(F.min_by("news_snapshot_hash", F.when(F.col("news_snapshot_hash").isNotNull(), F.col("event_id"))).alias("news_snapshot_hash"))


def parse_provenance(news: DataFrame) -> DataFrame:
    """Event -> list of article structs from the JSON column; rows without JSON are dropped."""
    schema = "array<struct<article_id:string,source:string,headline:string,url:string,published_at:string>>"
    return news.filter(F.col("news_provenance").isNotNull()).withColumn(
        "articles", F.from_json("news_provenance", schema)
    ).drop("news_provenance")


def merge_news(base: DataFrame, news: DataFrame) -> DataFrame:
    """Left join of per-event news features; clashing names get ``_news``, metadata columns stay out."""
    if "event_id" not in news.columns:
        raise ValueError("the news feature table needs an event_id column")
    features = news.drop(*META_COLUMNS)
    renamed = {c: f"{c}_news" for c in features.columns if c != "event_id" and c in base.columns}
    joined = skew_join(base, features.withColumnsRenamed(renamed), "event_id", "left")
    return joined.select(*base.columns, *[renamed.get(c, c) for c in features.columns if c != "event_id"])
