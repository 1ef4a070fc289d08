"""Queries that group articles into stories and search for many phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from phrasecast.operators import dedupe, search


def _copied(spark, sf):
    """Articles of two files; the copies write their address in another way."""
    arts = v.articles(spark, sf)
    number = F.regexp_extract("url", r"(\d+)$", 1)
    other = F.concat(F.lit("HTTP://WWW.News.example.com:80//"), number, F.lit("/?utm_source=feed&b=2&a=1#top"))
    url = F.when(F.col("file") == "dump1", other).otherwise(F.concat("url", F.lit("?a=1&b=2")))
    return arts.select(F.concat_ws("/", "file", "article_id").alias("row_id"), url.alias("url"), "headline", "published_at")


def agg_story_groups(spark, sf):
    return dedupe.story_groups(_copied(spark, sf), "row_id")


_STORIES_SQL = f"""WITH RECURSIVE {v.ARTICLES},
a AS (SELECT file || '/' || article_id AS id, article_id, t,
  trim(regexp_replace(lower(headline), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS h, coalesce(strftime(t, '%Y-%m-%d'), published_at) AS d FROM arts),
k AS (SELECT id, article_id AS key FROM a UNION ALL SELECT id, h || chr(10) || d FROM a WHERE h <> ''),
c AS (SELECT key, min(id) AS centre FROM k GROUP BY key),
e AS (SELECT DISTINCT id AS x, centre AS y FROM k JOIN c USING (key)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT id AS x, id AS y FROM a UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
g AS (SELECT x AS row_id, min(y) AS group_id FROM r GROUP BY x)
SELECT row_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size,
       row_number() OVER (PARTITION BY group_id ORDER BY t IS NULL, t, row_id) = 1 AS kept
FROM g JOIN a ON a.id = g.row_id"""


def mat_phrase_search(spark, sf):
    return search.find_phrases(v.segments(spark, sf), v.TERMS)


_SEARCH_SQL = f"WITH {v.LABELLED} SELECT segment_id, target FROM (UNPIVOT lab ON {', '.join(v.TARGETS)} INTO NAME target VALUE hit) WHERE hit"


def mat_phrase_search_counts(spark, sf):
    return search.find_phrases(v.segments(spark, sf), ["the", "entre", "policy"], counts=True)


def _count_sql(target, forms):
    words = ", ".join(v.quoted(f) for f in forms)
    return f"SELECT segment_id, '{target}' AS target, len(list_filter(w, lambda x: x IN ({words}))) AS n FROM t"


_SEARCH_COUNTS_SQL = f"""WITH {v.SEGMENTS}, t AS (SELECT segment_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM segs),
n AS ({_count_sql('target__the', ['the', 'thes'])} UNION ALL {_count_sql('target__entre', ['entre', 'entres'])}
      UNION ALL {_count_sql('target__policy', ['policy', 'policys', 'policies'])})
SELECT * FROM n WHERE n > 0"""


QUERIES = {
    "agg_story_groups": (agg_story_groups, _STORIES_SQL),
    "mat_phrase_search": (mat_phrase_search, _SEARCH_SQL),
    "mat_phrase_search_counts": (mat_phrase_search_counts, _SEARCH_COUNTS_SQL),
}
