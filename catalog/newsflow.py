"""Queries of the news flow: ingest, deduplication, features, provenance, join."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from phrasecast.operators import news
from phrasecast.plans import newsflow as plan
from phrasecast.session import materialize, scratch_path
from phrasecast.sources import articles as dumps, tables
from phrasecast.sources.dumps import load_dump

TERMS = ["the", "entre"]
INGESTED = "2024-06-01T00:00:00+00:00"
SINCE, UNTIL = "2024-01-03T00:00:00Z", "2024-01-20T12:00:00Z"
_COMPLETE = "article_id <> '' AND event_id <> '' AND source <> '' AND published_at <> '' AND headline <> '' AND url <> '' AND body_text <> ''"


def prj_articles(spark, sf):
    out = news.normalise_articles(v.articles(spark, sf), "wire", INGESTED)
    return out.select(
        "article_id", "event_id", "source", "published_at", F.col("tags")[0].alias("tag"),
        F.col("extras")["edition"].alias("edition"), F.col("extras")["ingested_at"].alias("ingested_at"),
        "ingest_source", F.size("extras").cast("bigint").alias("extras"),
    )


_ARTICLES_SQL = f"""WITH {v.ARTICLES} SELECT article_id, event_id, source, published_at, tags AS tag, edition,
'{INGESTED}' AS ingested_at, 'wire' AS ingest_source, 3::BIGINT AS extras FROM arts WHERE {_COMPLETE}"""


def prj_rejected_articles(spark, sf):
    out = news.rejected_articles(v.articles(spark, sf))
    return out.select("article_id", "file", F.array_join("missing", ",").alias("missing"))


_REJECTED_SQL = f"""WITH {v.ARTICLES}, m AS (SELECT article_id, file, concat_ws(',',
  CASE WHEN event_id = '' THEN 'event_id' END, CASE WHEN source = '' THEN 'source' END,
  CASE WHEN headline = '' THEN 'headline' END, CASE WHEN body_text = '' THEN 'body_text' END) AS missing FROM arts)
SELECT * FROM m WHERE missing <> ''"""


def flt_window(spark, sf):
    return news.within_window(v.articles(spark, sf), SINCE, UNTIL).select("article_id", "file", "published_at")


_WINDOW_SQL = f"""WITH {v.ARTICLES} SELECT article_id, file, published_at FROM arts
WHERE t IS NULL OR t BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""


def lim_per_source(spark, sf):
    arts = v.articles(spark, sf).withColumn("ingest_source", F.coalesce(F.nullif("source", F.lit("")), F.lit("none")))
    return news.first_per_source(arts, 25).select("ingest_source", "article_id", "file")


_LIMIT_SQL = f"""WITH {v.ARTICLES}, r AS (SELECT coalesce(nullif(source, ''), 'none') AS ingest_source, article_id, file,
  row_number() OVER (PARTITION BY coalesce(nullif(source, ''), 'none') ORDER BY file, line_no) AS n FROM arts)
SELECT ingest_source, article_id, file FROM r WHERE n <= 25"""


def _copies(spark, sf):
    return news.first_copies(news.measure_articles(v.articles(spark, sf), TERMS))


_COPIES = f"""{v.ARTICLES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY file, line_no) AS rn FROM arts WHERE article_id <> ''),
copies AS (
  SELECT *, len(body_text) AS body_length,
    len(list_filter(regexp_extract_all(lower(headline || chr(10) || body_text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ('the', 'thes'))) AS n_the,
    len(list_filter(regexp_extract_all(lower(headline || chr(10) || body_text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ('entre', 'entres'))) AS n_entre
  FROM ranked WHERE rn = 1 AND event_id <> '')"""


def agg_first_copies(spark, sf):
    return _copies(spark, sf).select("article_id", "event_id", "file", "body_length")


def _flat_features(df):
    return df.withColumns(
        {
            "news_average_body_length": F.round("news_average_body_length", 6),
            "news_first_published_at": F.unix_timestamp("news_first_published_at"),
            "news_latest_published_at": F.unix_timestamp("news_latest_published_at"),
        }
    )


def agg_news_features(spark, sf):
    return _flat_features(news.event_features(_copies(spark, sf), TERMS))


_FEATURES = f"""{_COPIES}, feats AS (
  SELECT event_id, count(*) AS news_article_count, count(DISTINCT source) AS news_unique_sources,
         round(avg(body_length), 6) AS news_average_body_length,
         epoch(min(t))::BIGINT AS news_first_published_at, epoch(max(t))::BIGINT AS news_latest_published_at,
         sum(n_the)::BIGINT AS news_target__the_count, sum(n_entre)::BIGINT AS news_target__entre_count
  FROM copies GROUP BY event_id)"""


def agg_provenance(spark, sf):
    return news.provenance_rows(_copies(spark, sf))


_PROVENANCE_SQL = f"""WITH {_COPIES} SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY file, line_no) - 1 AS place,
article_id, source, headline, url, published_at FROM copies"""


def agg_provenance_json(spark, sf):
    """Provenance as JSON parts, parsed back into articles."""
    parts = news.provenance_json(news.provenance_rows(_copies(spark, sf)), part_size=7)
    parsed = news.parse_provenance(parts)
    return parsed.select(
        "event_id", "part", F.size("articles").cast("bigint").alias("articles"),
        F.get("articles", F.lit(0))["article_id"].alias("first_article"), F.element_at("articles", -1)["url"].alias("last_url"),
    )


_PROVENANCE_JSON_SQL = f"""WITH {_COPIES}, p AS (SELECT event_id, article_id, url, row_number() OVER (PARTITION BY event_id ORDER BY file, line_no) - 1 AS place FROM copies)
SELECT event_id, (place // 7)::BIGINT AS part, count(*) AS articles, min_by(article_id, place) AS first_article, max_by(url, place) AS last_url
FROM p GROUP BY 1, 2"""


def agg_digest(spark, sf):
    return news.corpus_digest(v.table(spark, sf, "documents").select(F.col("text").alias("line")))


_DIGEST_SQL = """WITH b AS (SELECT ('0x' || substr(sha256(text), 1, 12))::BIGINT AS b FROM documents WHERE trim(text) <> '')
SELECT sha256(concat_ws(':', count(*), sum(b), bit_xor(b))) AS news_snapshot_hash FROM b"""


def agg_snapshot_hash(spark, sf):
    features = news.event_features(_copies(spark, sf), TERMS)
    return news.snapshot_hash(news.with_snapshot(features, agg_digest(spark, sf)))


def jn_news(spark, sf):
    """Segments of twenty event groups with the features of their news; one name clashes."""
    base = v.segments(spark, sf).select(
        F.concat(F.lit("E"), (F.expr("substring(event_id, 2)").cast("bigint") % 25).cast("string")).alias("event_id"),
        "segment_id",
        F.lit(0).cast("bigint").alias("news_article_count"),
    )
    features = news.event_features(_copies(spark, sf), TERMS)
    digest = agg_digest(spark, sf)
    merged = news.merge_news(base, news.with_snapshot(_flat_features(features), digest))
    return merged


_JOIN_SQL = f"""WITH {v.SEGMENTS}, {_FEATURES},
base AS (SELECT 'E' || (event_id[2:]::INTEGER % 25) AS event_id, segment_id, 0::BIGINT AS news_article_count FROM segs)
SELECT b.event_id, b.segment_id, b.news_article_count, f.news_article_count AS news_article_count_news,
       f.news_unique_sources, f.news_average_body_length, f.news_first_published_at, f.news_latest_published_at,
       f.news_target__the_count, f.news_target__entre_count
FROM base b LEFT JOIN feats f USING (event_id)"""


def agg_source_totals(spark, sf):
    """Two sources that each bring one file; a third one is switched off."""
    return news.totals_per_source(_ingested(spark, sf))


def _ingested(spark, sf):
    arts = v.articles(spark, sf)
    dumps.register_source("half", lambda s, which, since=None: news.within_window(arts.filter(F.col("file") == which), since))
    sources = [
        dumps.Source("first", "half", {"which": "dump0"}),
        dumps.Source("second", "half", {"which": "dump1"}),
        dumps.Source("off", "half", {"which": "dump1"}, enabled=False),
    ]
    return dumps.ingest(spark, sources, INGESTED, since=SINCE)


_TOTALS_SQL = f"""WITH {v.ARTICLES} SELECT CASE file WHEN 'dump0' THEN 'first' ELSE 'second' END AS ingest_source, count(*) AS articles
FROM arts WHERE {_COMPLETE} AND (t IS NULL OR t >= TIMESTAMP '2024-01-03 00:00:00') GROUP BY 1"""


def src_articles_jsonl(spark, sf):
    """Normalised articles written as JSON lines, scanned back and parsed."""
    path = dumps.write_articles(_ingested(spark, sf), scratch_path(spark, "news"), "run1")
    back = dumps.read_articles(spark, path)
    return back.select(
        "article_id", "event_id", "published_at", "headline", F.md5("body_text").alias("body_md5"),
        F.element_at("tags", 1).alias("tag"), F.col("extras")["edition"].alias("edition"),
        F.col("extras")["ingest_source"].alias("ingest_source"),
    )


_JSONL_SQL = f"""WITH {v.ARTICLES} SELECT article_id, event_id, published_at, headline, md5(body_text) AS body_md5, tags AS tag, edition,
CASE file WHEN 'dump0' THEN 'first' ELSE 'second' END AS ingest_source
FROM arts WHERE {_COMPLETE} AND (t IS NULL OR t >= TIMESTAMP '2024-01-03 00:00:00')"""


def src_article_dump(spark, sf):
    """Articles written into a folder per day and source, read back by the data source inside a window of days."""
    path = scratch_path(spark, "dump")
    arts = _ingested(spark, sf)
    day = F.substring("published_at", 1, 10)
    lines = dumps.article_lines(arts.withColumn("extras", F.map_concat("extras", F.create_map(F.lit("day"), day))))
    dated = lines.withColumn("day", F.try_to_date(F.get_json_object("value", "$.day"), "yyyy-MM-dd"))
    dumps.write_dated(dated, path)
    back = load_dump(spark, path, since=SINCE, until=UNTIL, columns="day date, ingest_source string")
    return back.select("article_id", "event_id", "published_at", F.md5("body_text").alias("body_md5"), "ingest_source", F.col("day").cast("string").alias("day"))


_DUMP_SQL = f"""WITH {v.ARTICLES} SELECT article_id, event_id, published_at, md5(body_text) AS body_md5,
CASE file WHEN 'dump0' THEN 'first' ELSE 'second' END AS ingest_source, strftime(t, '%Y-%m-%d') AS day
FROM arts WHERE {_COMPLETE} AND (t IS NULL OR t BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00')"""


def src_bad_lines(spark, sf):
    """A dump whose every fifth line is cut: good lines parse, the others are quarantined."""
    docs = v.table(spark, sf, "documents")
    line = F.to_json(F.struct(F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("article_id"), F.col("text").alias("body_text")))
    broken = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.left(line, F.lit(30)))).otherwise(line)
    path = scratch_path(spark, "dump")
    docs.select(broken.alias("value")).write.text(path)
    bad = dumps.bad_lines(spark, path)
    return bad.select(F.substring_index("line", " ", 1).cast("bigint").alias("doc_id"))


def snk_ingest_manifest(spark, sf):
    """The manifest of an ingest run, written and read back."""
    path = scratch_path(spark, "manifest")
    manifest = dumps.ingest_manifest(_ingested(spark, sf), "run1", INGESTED, ["raw/run1"], since=SINCE)
    tables.write_one_json(manifest, path)
    read = spark.read.schema(
        "run_id string, dry_run boolean, window struct<since:string,until:string>, totals map<string,bigint>, outputs array<string>"
    ).json(path)
    return read.select(
        "run_id", "dry_run", F.col("window.since").alias("since"), F.col("window.until").alias("until"),
        F.col("totals")["first"].alias("first"), F.col("totals")["second"].alias("second"), F.col("outputs")[0].alias("output"),
    )


_MANIFEST_SQL = f"""WITH t AS ({_TOTALS_SQL})
SELECT 'run1' AS run_id, false AS dry_run, '{SINCE}' AS since, NULL::VARCHAR AS until,
       max(CASE WHEN ingest_source = 'first' THEN articles END) AS first, max(CASE WHEN ingest_source = 'second' THEN articles END) AS second,
       'raw/run1' AS output FROM t"""


def flow_news_features(spark, sf):
    """The whole news flow: ingest to JSON lines, scan, deduplicate, features, table on disk."""
    folder = scratch_path(spark, "raw")
    ordered = materialize(news.normalise_articles(v.articles(spark, sf), "wire", INGESTED), "normalised")
    for name in ("dump0", "dump1"):
        part = ordered.filter(F.col("file") == name).orderBy("line_no")
        dumps.article_lines(part).select("value").write.text(f"{folder}/{name}")
    out = scratch_path(spark, "features")
    plan.build_features(spark, folder, TERMS, out)
    return _flat_features(spark.read.parquet(f"{out}/features")).drop("news_snapshot_hash")


_FLOW_SQL = f"""WITH {v.ARTICLES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY file, line_no) AS rn FROM arts WHERE {_COMPLETE}),
copies AS (
  SELECT *, len(body_text) AS body_length,
    len(list_filter(regexp_extract_all(lower(headline || chr(10) || body_text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ('the', 'thes'))) AS n_the,
    len(list_filter(regexp_extract_all(lower(headline || chr(10) || body_text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ('entre', 'entres'))) AS n_entre
  FROM ranked WHERE rn = 1)
SELECT event_id, count(*) AS news_article_count, count(DISTINCT source) AS news_unique_sources,
       round(avg(body_length), 6) AS news_average_body_length,
       epoch(min(t))::BIGINT AS news_first_published_at, epoch(max(t))::BIGINT AS news_latest_published_at,
       sum(n_the)::BIGINT AS news_target__the_count, sum(n_entre)::BIGINT AS news_target__entre_count
FROM copies GROUP BY event_id"""


QUERIES = {
    "prj_articles": (prj_articles, _ARTICLES_SQL),
    "prj_rejected_articles": (prj_rejected_articles, _REJECTED_SQL),
    "flt_window": (flt_window, _WINDOW_SQL),
    "lim_per_source": (lim_per_source, _LIMIT_SQL),
    "agg_first_copies": (agg_first_copies, f"WITH {_COPIES} SELECT article_id, event_id, file, body_length FROM copies"),
    "agg_news_features": (agg_news_features, f"WITH {_FEATURES} SELECT * FROM feats"),
    "agg_provenance": (agg_provenance, _PROVENANCE_SQL),
    "agg_provenance_json": (agg_provenance_json, _PROVENANCE_JSON_SQL),
    "agg_digest": (agg_digest, _DIGEST_SQL),
    "agg_snapshot_hash": (agg_snapshot_hash, _DIGEST_SQL),
    "jn_news": (jn_news, _JOIN_SQL),
    "agg_source_totals": (agg_source_totals, _TOTALS_SQL),
    "src_articles_jsonl": (src_articles_jsonl, _JSONL_SQL),
    "src_article_dump": (src_article_dump, _DUMP_SQL),
    "src_bad_lines": (src_bad_lines, "SELECT doc_id FROM documents WHERE doc_id % 5 = 0"),
    "snk_ingest_manifest": (snk_ingest_manifest, _MANIFEST_SQL),
    "flow_news_features": (flow_news_features, _FLOW_SQL),
}
