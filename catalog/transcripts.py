"""Queries of the transcript flow: inventory, cleaning, segments, labels, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from phrasecast.functions.phrases import humanise_slug, slug_column
from phrasecast.operators import inventory as iv, label, profile, segment
from phrasecast.plans import transcripts as plan
from phrasecast.session import materialize, scratch_path
from phrasecast.sources import tables
from phrasecast.streaming import live
from phrasecast.streaming.labels import read_segments

_FLAT = ["event_id", "event_type", "event_date", "speakers", "source_url", "provenance", "desk"]
_INVENTORY_SQL = f"WITH {v.INVENTORY} SELECT event_id, event_type, strftime(event_date, '%Y-%m-%d') AS event_date, speakers, source_url, provenance, desk FROM inv"


def _flat_inventory(raw):
    return iv.inventory_rows(iv.project_inventory(raw)).select(*_FLAT)


def prj_inventory(spark, sf):
    return _flat_inventory(v.inventory(spark, sf))


def src_inventory_csv(spark, sf):
    path = scratch_path(spark, "inventory") + ".csv"
    v.inventory(spark, sf).write.option("header", True).csv(path)
    return _flat_inventory(tables.read_inventory(spark, path, multi_line=False))


def src_inventory_jsonl(spark, sf):
    raw = v.inventory(spark, sf)
    path = scratch_path(spark, "inventory") + ".jsonl"
    raw.write.json(path)
    return _flat_inventory(tables.read_inventory(spark, path, raw.columns))


def src_table_csv(spark, sf):
    path = scratch_path(spark, "segments") + ".tsv"
    v.segments(spark, sf).drop("text").write.option("header", True).option("sep", "\t").csv(path)
    schema = "event_id string, segment_id string, event_date date, speaker string, start_char bigint, end_char bigint"
    return tables.read_table(spark, path, schema, multi_line=False).select("event_id", "segment_id", "event_date", "speaker", "end_char")


def jn_overrides(spark, sf):
    raw = v.inventory(spark, sf)
    finished = raw.filter(F.col("desk") == "F")
    overrides = finished.select(
        "event_id",
        F.lit("Ines Vantorp, Bram Oake").alias("speakers"),
        F.when(F.col("event_type") == "1-URGENT", F.lit("urgent")).alias("event_type"),
    )
    return _flat_inventory(iv.apply_overrides(raw, overrides))


_OVERRIDES_SQL = f"""WITH {v.INVENTORY}
SELECT event_id, CASE WHEN desk = 'F' AND event_type = '1-URGENT' THEN 'urgent' ELSE event_type END AS event_type,
       strftime(event_date, '%Y-%m-%d') AS event_date,
       CASE WHEN desk = 'F' THEN 'Ines Vantorp, Bram Oake' ELSE speakers END AS speakers,
       source_url, provenance, desk FROM inv"""


def val_duplicate_ids(spark, sf):
    orders = v.table(spark, sf, "orders").select(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("event_id"))
    return iv.duplicate_ids(orders)


def val_missing_documents(spark, sf):
    events = v.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("event_id"), "c_name")
    pages = v.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("event_id"))
    return iv.events_without_document(events, pages)


def val_events_without_segments(spark, sf):
    """Events of the inventory that no conversation belongs to; its order keys reach further than the conversations."""
    return iv.events_without_document(v.event_inventory(spark, sf), v.segments(spark, sf)).select("event_id", "event_type")


def agg_inventory_summary(spark, sf):
    return iv.inventory_summary(v.inventory(spark, sf))


def agg_event_types(spark, sf):
    return iv.event_types(v.inventory(spark, sf))


def agg_events_over_time(spark, sf):
    return iv.events_over_time(v.inventory(spark, sf))


def flt_events(spark, sf):
    kept = iv.filter_events(
        iv.project_inventory(v.inventory(spark, sf)), ["1-URGENT", "5-LOW"], "1995-03-01", "1998-12-31"
    )
    return kept.select("event_id", "event_type", "event_date")


def val_dataset_profile(spark, sf):
    docs = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id", "left")
    return profile.dataset_profile(docs.select("doc_id", "lang", "quality", "toxic")).drop("type", "position")


_PROFILE_SQL = """WITH d AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS rows, 'doc_id' AS "column", count(*) - count(doc_id) AS missing FROM d UNION ALL
SELECT count(*), 'lang', count(*) - count(lang) FROM d UNION ALL
SELECT count(*), 'quality', count(*) - count(quality) FROM d UNION ALL
SELECT count(*), 'toxic', count(*) - count(toxic) FROM d"""


def prj_slugs(spark, sf):
    lines = v.table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("term"))
    slug = slug_column(F.col("term"))
    return lines.select(
        "doc_id", slug.alias("slug"), humanise_slug(slug, F.lit(None).cast("string")).alias("phrase")
    )


_SLUG_SQL = """WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)
SELECT doc_id, 'target__' || CASE WHEN s = '' THEN 'term' ELSE s END AS slug,
       replace(CASE WHEN s = '' THEN 'term' ELSE s END, '_', ' ') AS phrase FROM t"""


def txt_clean_pages(spark, sf):
    return segment.clean_pages(v.transcript_pages(spark, sf))


def txt_clean_documents(spark, sf):
    return segment.clean_pages(v.document_pages(spark, sf))


def txt_merge_pages(spark, sf):
    return segment.merge_pages(segment.clean_pages(v.transcript_pages(spark, sf)))


def _clean(pages):
    """Clean pages as a written table: the segment operators read their input several times."""
    return materialize(segment.clean_pages(pages), "clean-pages")


def _sized(segments):
    return segments.select("event_id", "segment_id", "speaker", "text", "start_char", "end_char")


def seg_speaker_turns(spark, sf):
    return _sized(segment.segment_by_speaker(_clean(v.transcript_pages(spark, sf))))


def seg_speaker_documents(spark, sf):
    return _sized(segment.segment_by_speaker(_clean(v.document_pages(spark, sf))))


def seg_windows(spark, sf):
    return _sized(segment.segment_by_window(_clean(v.transcript_pages(spark, sf)), 200))


def seg_windows_overlapping(spark, sf):
    return _sized(segment.segment_by_window(v.document_pages(spark, sf), 200, 150))


_LABEL_SQL = v.quoted(r"(?m)^([A-Z][A-Z\s\-']{1,40}):")
_WS_EDGES = v.quoted(v._WS + "+")


def _windows_sql(source: str, window: int, stride: int) -> str:
    return source + f""",
toks AS (SELECT event_id, list_filter(string_split_regex(text, {_WS_EDGES}), lambda t: t <> '') AS t FROM wtext),
wins AS (SELECT event_id, t, unnest(range(0, len(t), {stride})) AS s FROM toks),
win_rows AS (
  SELECT event_id, event_id || '_W' || lpad((s // {stride} + 1)::VARCHAR, greatest(4, len((s // {stride} + 1)::VARCHAR))::INTEGER, '0') AS segment_id,
         NULL::VARCHAR AS speaker, array_to_string(t[s + 1:s + {window}], ' ') AS text,
         len(array_to_string(t[1:s], ' ')) AS start_char
  FROM wins)"""


_WINDOW_COLUMNS = "SELECT event_id, segment_id, speaker, text, start_char, start_char + len(text) AS end_char FROM win_rows"


def _turns_sql(source: str) -> str:
    """Turns from the joined text of every event: labels, bodies and running positions."""
    base = source + v.MERGED + f""",
parts AS (
  SELECT event_id, text, regexp_extract_all(text, {_LABEL_SQL}, 0) AS labels, string_split_regex(text, {_LABEL_SQL}) AS bodies FROM merged),
turns AS (
  SELECT event_id, text AS full_text, unnest(range(1, len(labels) + 1)) AS k, labels, bodies FROM parts WHERE len(labels) > 0),
placed AS (
  SELECT event_id, full_text, k, labels[k] AS lab, bodies[k + 1] AS body, len(bodies[1]) AS skip
  FROM turns),
pos AS (
  SELECT *, skip + coalesce(sum(len(lab) + len(body)) OVER (PARTITION BY event_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lab_at FROM placed),
marked AS (
  SELECT *, regexp_matches(body, '[^\\t-\\r\\x1c-\\x20]') AS spoken FROM pos),
spoken AS (
  SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY k) AS n, trim(lab[:-2], E' \\n') AS speaker,
         trim(body, E' \\n') AS text, (lab_at + len(lab) + len(body) - len(ltrim(body, E' \\n'))) AS start_char
  FROM marked WHERE spoken),
ends AS (
  SELECT event_id, max(k) AS last_k, coalesce(max(CASE WHEN spoken THEN k END), 0) AS last_spoken, count_if(spoken) AS m FROM marked GROUP BY event_id),
tails AS (
  SELECT e.event_id, e.m + 1 AS n, NULL::VARCHAR AS speaker,
         full_text[CASE WHEN last_spoken = 0 THEN 0 ELSE lab_at END + 1:] AS raw, CASE WHEN last_spoken = 0 THEN 0 ELSE lab_at END AS pos0
  FROM ends e JOIN marked p ON p.event_id = e.event_id AND p.k = e.last_spoken + 1 WHERE last_k > last_spoken),
all_turns AS (
  SELECT event_id, n, speaker, text, start_char FROM spoken UNION ALL
  SELECT event_id, n, speaker, trim(raw, E' \\n'), pos0 + len(raw) - len(ltrim(raw, E' \\n')) FROM tails),
wtext AS (SELECT event_id, text FROM parts WHERE len(labels) = 0)"""
    return _windows_sql(base, 200, 200) + f"""
SELECT event_id, event_id || '_S' || lpad(n::VARCHAR, greatest(4, len(n::VARCHAR))::INTEGER, '0') AS segment_id, speaker, text,
       start_char::BIGINT AS start_char, (start_char + len(text))::BIGINT AS end_char FROM all_turns
UNION ALL {_WINDOW_COLUMNS}"""


_CLEAN = v.clean_sql(v.TRANSCRIPT_PAGES)
_CLEAN_DOCS = v.clean_sql(v.DOCUMENT_PAGES)
_MERGED_WINDOWS_SQL = "WITH " + _windows_sql(_CLEAN + v.MERGED + ", wtext AS (SELECT event_id, text FROM merged)", 200, 200) + _WINDOW_COLUMNS
_DOC_WINDOWS_SQL = "WITH " + _windows_sql(v.DOCUMENT_PAGES + ", wtext AS (SELECT event_id, text FROM raw_pages)", 200, 150) + _WINDOW_COLUMNS


def mat_labels(spark, sf):
    return v.labelled(spark, sf).select("segment_id", *v.TARGETS)


def mat_labels_contract(spark, sf):
    return v.labelled(spark, sf, prefilter=False).select("segment_id", *v.TARGETS)


def mat_counts(spark, sf):
    docs = v.table(spark, sf, "documents")
    phrases = label.vocabulary(["the", "entre", "le / la"])
    return docs.select("doc_id", *[p.count(F.col("text")).cast("bigint").alias(p.column) for p in phrases])


_COUNT_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'thes'))) AS target__the,
       len(list_filter(w, lambda x: x IN ('entre', 'entres'))) AS target__entre,
       len(list_filter(w, lambda x: x IN ('le', 'les', 'la', 'las'))) AS target__le_la FROM w"""


def mat_long(spark, sf):
    return label.long_targets(v.labelled(spark, sf), v.TARGETS, ["segment_id"])


def flt_speakers(spark, sf):
    return label.filter_speakers(
        v.segments(spark, sf), ["assistant", "regex: ^us.r$", "system"], ["SYSTEM"]
    ).select("segment_id", "speaker")


def jn_segments_inventory(spark, sf):
    rows = label.build_rows(
        v.segments(spark, sf).drop("event_date"), v.event_inventory(spark, sf), v.TERMS, exclude=["system"]
    )
    return rows.select("event_id", "segment_id", "event_type", "event_date", "speaker", "provenance", "desk", *v.TARGETS)


_JOIN_SQL = f"""WITH {v.LABELLED}
SELECT l.event_id, l.segment_id, o.o_orderpriority AS event_type, o.o_orderdate::DATE AS event_date, l.speaker,
       'orders' AS provenance, o.o_orderstatus AS desk, {', '.join(v.TARGETS)}
FROM lab l JOIN orders o ON l.event_id = 'C' || lpad(o.o_orderkey::VARCHAR, greatest(6, len(o.o_orderkey::VARCHAR))::INTEGER, '0') WHERE l.speaker <> 'SYSTEM'"""


def val_segments(spark, sf):
    checked = label.validate_segments(v.segments(spark, sf))
    return checked.select(
        F.col("checks")["unique_segment_ids"].alias("unique_segment_ids"),
        F.col("checks")["non_empty_text"].alias("non_empty_text"),
        F.size("notes").cast("bigint").alias("notes"),
    )


_VALID_SQL = f"""WITH {v.SEGMENTS} SELECT count(*) = count(DISTINCT segment_id) AS unique_segment_ids,
       count_if(trim(text) = '') = 0 AS non_empty_text, 0::BIGINT AS notes FROM segs"""


def flow_labelled_segments(spark, sf):
    """The whole transcript flow: clean, segment, filter, join, label."""
    cut = segment.segment(_clean(v.transcript_pages(spark, sf)))
    rows = label.build_rows(cut, v.event_inventory(spark, sf), v.TERMS, exclude=["system"])
    return rows.select("event_id", "segment_id", "event_type", "speaker", "start_char", "end_char", *v.TARGETS)


_FLOW_SQL = f"""SELECT r.event_id, r.segment_id, o.o_orderpriority AS event_type, r.speaker, r.start_char, r.end_char,
       {', '.join(f'{v.hit_sql(t)} AS {t}' for t in v.TARGETS)}
FROM (WITH {_turns_sql(_CLEAN)}) r JOIN orders o ON r.event_id = 'C' || lpad(o.o_orderkey::VARCHAR, greatest(6, len(o.o_orderkey::VARCHAR))::INTEGER, '0')
WHERE r.speaker IS NULL OR NOT regexp_matches(r.speaker, '(?i)\\bsystem\\b')"""


def snk_publish_manifest(spark, sf):
    folder = scratch_path(spark, "published")
    raw = v.event_inventory(spark, sf).withColumn("speakers", F.lit("A, B"))
    done = plan.publish(
        v.transcript_pages(spark, sf), raw, v.TERMS, folder, "v1", "20240101T000000Z", exclude=["system"]
    )
    manifest = tables.read_manifests(spark, done.manifest)
    return manifest.select(
        "version", "generated_at", "num_rows", "dataset_stem",
        F.col("validation.checks")["unique_segment_ids"].alias("unique_segment_ids"),
        F.size("target_columns").cast("bigint").alias("targets"),
    )


_PUBLISH_SQL = f"""SELECT 'v1' AS version, '20240101T000000Z' AS generated_at, count(*) AS num_rows, 'segments_v1' AS dataset_stem,
       true AS unique_segment_ids, 6::BIGINT AS targets FROM ({_FLOW_SQL})"""


def src_target_terms(spark, sf):
    rows = v.labelled(spark, sf)
    folder = scratch_path(spark, "manifests")
    for version, terms in (("v1", {}), ("v2", label.target_map(v.TERMS)), ("v3", {"late": "target__late"})):
        manifest = tables.segment_manifest(rows, label.validate_segments(rows), version, "20240101T000000Z", terms)
        tables.write_one_json(manifest, f"{folder}/segments_{version}.json")
    return tables.target_terms(tables.read_manifests(spark, f"{folder}/segments_*.json/part-*"))


def _spoken(spark, sf):
    """Segments with the time they are spoken: a conversation per minute, a turn every twenty seconds."""
    return v.segments(spark, sf).select(
        (F.floor(F.expr("substring(event_id, 2)").cast("bigint") / 40)).alias("hour"), "segment_id", "text",
        F.timestamp_seconds(
            F.lit(1704067200) + F.expr("substring(event_id, 2)").cast("bigint") * 60 + F.expr("substring_index(segment_id, '_S', -1)").cast("bigint") * 20
        ).alias("spoken_at"),
    ).select(F.concat(F.lit("H"), F.col("hour").cast("string")).alias("event_id"), "segment_id", "spoken_at", "text")


def str_live_features(spark, sf):
    """The stream of spoken segments in three deliveries, each row twice, with a restart before the last one."""
    spoken, folder = _spoken(spark, sf), scratch_path(spark, "live")
    edges = spoken.agg(F.min(F.unix_timestamp("spoken_at")).alias("a"), F.max(F.unix_timestamp("spoken_at")).alias("b"))
    part = materialize(spoken.withColumn("part", F.least(
        F.floor(3 * (F.unix_timestamp("spoken_at") - edges.select("a").scalar()) / (edges.select("b").scalar() - edges.select("a").scalar() + 1)), F.lit(2),
    )), "spoken")
    kind = "event_id string, segment_id string, spoken_at timestamp, text string"
    for parts in ([0, 1], [2]):
        for i in parts:
            rows = part.filter(F.col("part") == i).drop("part")
            rows.unionByName(rows).write.mode("append").parquet(f"{folder}/in")
        stream = read_segments(spark, f"{folder}/in", kind)
        features = live.live_features(stream, ["the", "entre"], "10 minutes", "5 minutes")
        live.write_live(features, f"{folder}/out", f"{folder}/state").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.withColumns({c: F.unix_timestamp(c) for c in ("window_start", "window_end")})


_LIVE_SQL = f"""WITH {v.LABELLED}, s AS (SELECT 'H' || (event_id[2:]::BIGINT // 40) AS event_id,
  1704067200 + event_id[2:]::BIGINT * 60 + string_split(segment_id, '_S')[2]::BIGINT * 20 AS at_s, target__the, target__entre FROM lab)
SELECT event_id, (at_s // 600) * 600 AS window_start, (at_s // 600) * 600 + 600 AS window_end, count(*) AS segments,
       sum(target__the::INT)::BIGINT AS target__the, sum(target__entre::INT)::BIGINT AS target__entre
FROM s WHERE (at_s // 600) * 600 + 600 <= (SELECT max(at_s) FROM s) - 300 GROUP BY ALL"""


QUERIES = {
    "str_live_features": (str_live_features, _LIVE_SQL),
    "prj_inventory": (prj_inventory, _INVENTORY_SQL),
    "src_inventory_csv": (src_inventory_csv, _INVENTORY_SQL),
    "src_inventory_jsonl": (src_inventory_jsonl, _INVENTORY_SQL),
    "src_table_tsv": (src_table_csv, f"WITH {v.SEGMENTS} SELECT event_id, segment_id, event_date, speaker, len(text) AS end_char FROM segs"),
    "jn_overrides": (jn_overrides, _OVERRIDES_SQL),
    "val_duplicate_ids": (val_duplicate_ids, "SELECT 'K' || o_custkey AS event_id, count(*) AS rows FROM orders GROUP BY o_custkey HAVING count(*) > 1"),
    "val_missing_documents": (val_missing_documents, "SELECT c_custkey::VARCHAR AS event_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "val_events_without_segments": (
        val_events_without_segments,
        f"WITH {v.SEGMENTS}, o AS (SELECT 'C' || lpad(o_orderkey::VARCHAR, greatest(6, len(o_orderkey::VARCHAR))::INTEGER, '0') AS event_id, o_orderpriority AS event_type FROM orders) "
        "SELECT event_id, event_type FROM o WHERE event_id NOT IN (SELECT event_id FROM segs)",
    ),
    "agg_inventory_summary": (agg_inventory_summary, f"WITH {v.INVENTORY} SELECT count(*) AS events, min(event_date) AS date_min, max(event_date) AS date_max, count(DISTINCT event_type) AS event_types FROM inv"),
    "agg_event_types": (agg_event_types, "SELECT DISTINCT o_orderpriority AS event_type FROM orders ORDER BY 1"),
    "agg_events_over_time": (agg_events_over_time, "SELECT o_orderdate::DATE AS event_day, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1"),
    "flt_events": (flt_events, f"WITH {v.INVENTORY} SELECT event_id, event_type, event_date FROM inv WHERE event_type IN ('1-URGENT', '5-LOW') AND event_date BETWEEN DATE '1995-03-01' AND DATE '1998-12-31'"),
    "val_dataset_profile": (val_dataset_profile, _PROFILE_SQL),
    "prj_slugs": (prj_slugs, _SLUG_SQL),
    "txt_clean_pages": (txt_clean_pages, f"WITH {_CLEAN} SELECT * FROM clean"),
    "txt_clean_documents": (txt_clean_documents, f"WITH {_CLEAN_DOCS} SELECT * FROM clean"),
    "txt_merge_pages": (txt_merge_pages, f"WITH {_CLEAN}{v.MERGED} SELECT * FROM merged"),
    "seg_speaker_turns": (seg_speaker_turns, f"WITH {_turns_sql(_CLEAN)}"),
    "seg_speaker_documents": (seg_speaker_documents, f"WITH {_turns_sql(_CLEAN_DOCS)}"),
    "seg_windows": (seg_windows, _MERGED_WINDOWS_SQL),
    "seg_windows_overlapping": (seg_windows_overlapping, _DOC_WINDOWS_SQL),
    "mat_labels": (mat_labels, f"WITH {v.LABELLED} SELECT segment_id, {', '.join(v.TARGETS)} FROM lab"),
    "mat_labels_contract": (mat_labels_contract, f"WITH {v.CONTRACT} SELECT segment_id, {', '.join(v.TARGETS)} FROM lab"),
    "mat_counts": (mat_counts, _COUNT_SQL),
    "mat_long": (mat_long, f"WITH {v.LABELLED} SELECT segment_id, target, hit FROM (UNPIVOT lab ON {', '.join(v.TARGETS)} INTO NAME target VALUE hit)"),
    "flt_speakers": (flt_speakers, f"WITH {v.SEGMENTS} SELECT segment_id, speaker FROM segs WHERE speaker IN ('USER', 'ASSISTANT')"),
    "jn_segments_inventory": (jn_segments_inventory, _JOIN_SQL),
    "val_segments": (val_segments, _VALID_SQL),
    "flow_labelled_segments": (flow_labelled_segments, _FLOW_SQL),
    "snk_publish_manifest": (snk_publish_manifest, _PUBLISH_SQL),
    "src_target_terms": (src_target_terms, "SELECT unnest(['entre', 'is', 'le / la', 'of the', 'policy', 'the']) AS term"),
}
