"""Articles that are the same story: one address, or one headline at one time, or linked over others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phrasecast.functions.groups import connected_groups
from phrasecast.functions.numbers import publication_time
from phrasecast.functions.scan import skew_join
from phrasecast.functions.urls import canonical_url, headline_form


def story_keys(url: Column, headline: Column, published_at: Column, every: str = "day") -> Column:
    """The keys of an article: its canonical address, and its headline with the ``every`` (day, hour, ...) of its publication.

    An unreadable time counts as written. An article without address or headline lacks that key.
    """
    time = F.coalesce(F.date_trunc(every, publication_time(published_at)).cast("string"), published_at.cast("string"), F.lit(""))
    address = F.concat(F.lit("u:"), F.md5(canonical_url(url).cast("binary")))
    title = F.concat(F.lit("h:"), F.md5(F.concat_ws("\n", headline_form(headline), time).cast("binary")))
    title = F.when(headline_form(headline).isNotNull(), title)
    return F.filter(F.array(address, title), lambda k: k.isNotNull())


def story_groups(articles: DataFrame, row_id: str = "article_id", every: str = "day") -> DataFrame:
    """``(row_id, group_id, group_size, kept)``: groups of articles linked over addresses and headlines, however indirectly.

    ``group_id`` is the smallest id of the group; the earliest article is kept (without a readable time last; then the smallest
    id). ``row_id`` must be unique; rows without one are left out.
    """
    keys = story_keys(F.col("url"), F.col("headline"), F.col("published_at"), every)
    named = articles.filter(F.col(row_id).isNotNull())
    pairs = named.select(F.col(row_id).alias("item"), F.explode_outer(keys).alias("key"))
    groups = connected_groups(pairs).select(F.col("item").alias(row_id), F.col("group").alias("group_id"))
    at = publication_time(F.col("published_at")).alias("at")
    dated = groups.join(named.select(row_id, at), row_id)
    rank = F.struct(F.col("at").isNull().alias("undated"), "at", row_id)
    sizes = dated.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"), F.min_by(row_id, rank).alias("__first"))
    out = skew_join(dated, sizes, "group_id", spread=[row_id])
    return out.select(row_id, "group_id", "group_size", (F.col(row_id) == F.col("__first")).alias("kept"))


def first_stories(articles: DataFrame, row_id: str = "article_id", every: str = "day") -> DataFrame:
    """The kept article of each group, with all its columns."""
    kept = story_groups(articles, row_id, every).filter("kept").select(row_id)
    return articles.join(kept, row_id, "left_semi")
