"""The library's input tables, derived from the provided tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasecast.operators import label
from phrasecast.session import spread

# Tracked phrases that occur in the invented prose; "policy" never does.
TERMS = ["the", "is", "of the", "le / la", "entre", "policy"]
TARGETS = ["target__the", "target__is", "target__of_the", "target__le_la", "target__entre", "target__policy"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC times without a zone
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "conversations") else df


def padded(number, width: int):
    """A number with leading zeros; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.char_length(digits)), F.lit("0"))


def _event(column: str):
    return F.concat(F.lit("C"), padded(F.col(column), 6))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """One segment per conversation turn; three conversations share a day."""
    return table(spark, sf, "conversations").select(
        _event("conv_id").alias("event_id"),
        F.concat(_event("conv_id"), F.lit("_S"), padded(F.col("turn") + 1, 4)).alias("segment_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("conv_id") / 3).cast("int")).alias("event_date"),
        F.upper("role").alias("speaker"),
        "text",
        F.lit(0).cast("bigint").alias("start_char"),
        F.char_length("text").cast("bigint").alias("end_char"),
    )


SEGMENTS = """
segs AS (
  SELECT 'C' || lpad(conv_id::VARCHAR, greatest(6, len(conv_id::VARCHAR))::INTEGER, '0') AS event_id,
         'C' || lpad(conv_id::VARCHAR, greatest(6, len(conv_id::VARCHAR))::INTEGER, '0') || '_S' || lpad((turn + 1)::VARCHAR, greatest(4, len((turn + 1)::VARCHAR))::INTEGER, '0') AS segment_id,
         (DATE '2020-01-01' + (conv_id // 3)::INTEGER) AS event_date,
         upper(role) AS speaker, text
  FROM conversations)
"""


def labelled(spark: SparkSession, sf: str, prefilter: bool = True) -> DataFrame:
    return label.label_segments(segments(spark, sf), TERMS, prefilter)


# The spellings are written out here, independently of the library's pattern builder.
_L, _R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_APO = "['’]"
_SEP = r"(?:\s+|\s*[-‐‑–—]\s*)"
_FORMS = {
    "target__the": rf"(?:the|thes|the{_APO}s|thes{_APO})",
    "target__is": rf"(?:is|iss|ises|es|is{_APO}s|is{_APO}|iss{_APO}|ises{_APO}|es{_APO})",
    "target__of_the": rf"(?:of|ofs|oves|of{_APO}s|ofs{_APO}|oves{_APO}){_SEP}(?:the|thes|the{_APO}s|thes{_APO})",
    "target__le_la": rf"(?:le|les|le{_APO}s|les{_APO}|la|las|la{_APO}s|las{_APO})",
    "target__entre": rf"(?:entre|entres|entre{_APO}s|entres{_APO})",
    "target__policy": rf"(?:policy|policys|policies|policy{_APO}s|policys{_APO}|policies{_APO})",
}
_FIRST = {
    "target__the": ["the"], "target__is": ["is"], "target__of_the": ["of"], "target__le_la": ["le", "la"],
    "target__entre": ["entre"], "target__policy": ["policy"],
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit_sql(target: str, prefilter: bool = True) -> str:
    found = f"regexp_matches(text, {quoted('(?i)' + _L + _FORMS[target] + _R)})"
    if not prefilter:
        return found
    seen = " OR ".join(f"contains(lower(text), {quoted(w)})" for w in _FIRST[target])
    return f"(({seen}) AND {found})"


LABELLED = SEGMENTS + ", lab AS (SELECT segs.*, " + ", ".join(
    f"{hit_sql(t)} AS {t}" for t in TARGETS
) + " FROM segs)"
CONTRACT = SEGMENTS + ", lab AS (SELECT segs.*, " + ", ".join(
    f"{hit_sql(t, False)} AS {t}" for t in TARGETS
) + " FROM segs)"


def transcript_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One raw page per conversation turn: header lines, a labelled line, the text, a footer."""
    title = F.concat(F.upper(F.left("role", F.lit(1))), F.substr("role", F.lit(2)))
    turn = F.col("turn").cast("string")
    page = F.concat(
        F.lit("Page "), turn, F.lit("\nFederal Reserve notes\n"), title, F.lit(":  "), F.col("text"),
        F.lit("\n \n"), turn, F.lit(" / 7\n***"),
    )
    return table(spark, sf, "conversations").select(
        _event("conv_id").alias("event_id"), F.col("turn").cast("int").alias("page_no"), page.alias("text")
    )


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an event of one page."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("D"), padded(F.col("doc_id"), 8)).alias("event_id"),
        F.lit(0).alias("page_no"),
        "text",
    )


TRANSCRIPT_PAGES = """
raw_pages AS (
  SELECT 'C' || lpad(conv_id::VARCHAR, greatest(6, len(conv_id::VARCHAR))::INTEGER, '0') AS event_id, turn::INTEGER AS page_no,
         'Page ' || turn || chr(10) || 'Federal Reserve notes' || chr(10)
         || upper(role[1]) || role[2:] || ':  ' || text || chr(10) || ' ' || chr(10)
         || turn || ' / 7' || chr(10) || '***' AS text
  FROM conversations)
"""
DOCUMENT_PAGES = """
raw_pages AS (
  SELECT 'D' || lpad(doc_id::VARCHAR, greatest(8, len(doc_id::VARCHAR))::INTEGER, '0') AS event_id, 0::INTEGER AS page_no, text FROM documents)
"""

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_HEAD = rf"(?i)^{_WS}*(page{_WS}+\d+|federal reserve|press{_WS}+conference)"
_FOOT = rf"^{_WS}*(\d+{_WS}*/{_WS}*\d+|\*+){_WS}*$"
_LABEL = r"^([A-Za-z][A-Za-z. \-']{1,60}) *[:.]"
_CONN = "'of','the','and','for','to','in','on','at','with'"
_TITLES = "'mr','mrs','ms','dr','prof','professor','chair','chairman','chairwoman','vice','gov','governor','president'"


def clean_sql(source: str) -> str:
    """Cleaning as row-wise SQL: lines are unnested, headers and footers found by position."""
    return source + rf""",
broken AS (
  SELECT event_id, page_no, string_split_regex(translate(text, '–—’‘“”', '--''''""'), {quoted(_BREAK)}) AS l FROM raw_pages),
trimmed AS (
  SELECT event_id, page_no, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM broken),
numbered AS (
  SELECT event_id, page_no, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM trimmed),
flagged AS (
  SELECT *, regexp_matches(line, {quoted(_HEAD)}) AS is_head, regexp_matches(line, {quoted(_FOOT)}) AS is_foot FROM numbered),
bounds AS (
  SELECT event_id, page_no, min(CASE WHEN NOT is_head THEN i END) AS first_line FROM flagged GROUP BY ALL),
inner_lines AS (
  SELECT f.*, max(CASE WHEN NOT is_foot THEN i END) OVER (PARTITION BY f.event_id, f.page_no) AS last_line
  FROM flagged f JOIN bounds b ON f.event_id = b.event_id AND f.page_no = b.page_no AND f.i >= b.first_line),
flat AS (
  SELECT event_id, page_no, i, trim(regexp_replace(line, {quoted(_WS + '+')}, ' ', 'g')) AS line
  FROM inner_lines WHERE i <= last_line),
labels AS (
  SELECT *, regexp_extract(line, {quoted(_LABEL)}, 1) AS label, regexp_extract(line, {quoted(_LABEL)}, 0) AS whole
  FROM flat WHERE line <> ''),
judged AS (
  SELECT *, list_transform(string_split(trim(label), ' '), lambda w: regexp_replace(w, '[''.\-]', '', 'g')) AS words FROM labels),
written AS (
  SELECT event_id, page_no, i,
    CASE WHEN label <> '' AND len(words) <= 8
          AND len(list_filter(words, lambda w: NOT (lower(w) IN ({_CONN},{_TITLES})
               OR regexp_matches(w, '^([A-Z]+|[A-Z][a-z]+)$')))) = 0
          AND len(list_filter(words, lambda w: NOT lower(w) IN ({_CONN}))) > 0
      THEN replace(upper(trim(label)), '.', '') || ':' ||
           CASE WHEN ltrim(line[len(whole) + 1:]) = '' THEN '' ELSE ' ' || ltrim(line[len(whole) + 1:]) END
      ELSE line END AS line
  FROM judged),
clean AS (
  SELECT p.event_id, p.page_no, coalesce(string_agg(w.line, chr(10) ORDER BY w.i), '') AS text
  FROM raw_pages p LEFT JOIN written w ON p.event_id = w.event_id AND p.page_no = w.page_no
  GROUP BY p.event_id, p.page_no)"""


MERGED = """,
merged AS (
  SELECT event_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text
  FROM clean WHERE trim(text) <> '' GROUP BY event_id)"""


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Raw inventory: one event per order, dates in three formats, names as text."""
    day = F.col("o_orderdate")
    form = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.col("o_orderpriority").alias("event_type"),
        F.when(form == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.date_format(day, "yyyyMMdd"))
        .alias("event_date"),
        F.concat(F.lit(" Clerk "), F.col("o_custkey").cast("string"), F.lit(" , , Desk "), F.col("o_orderstatus")).alias("speakers"),
        F.lit("a.pdf").alias("pdf_file"),
        F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("source_url"),
        F.lit(None).cast("string").alias("provenance"),
        F.col("o_orderstatus").alias("desk"),
    )


INVENTORY = """
inv AS (
  SELECT 'O' || o_orderkey AS event_id, o_orderpriority AS event_type, o_orderdate::DATE AS event_date,
         'Clerk ' || o_custkey || ', Desk ' || o_orderstatus AS speakers,
         'https://example.com/' || o_orderkey AS source_url, NULL::VARCHAR AS provenance, o_orderstatus AS desk
  FROM orders)
"""


def event_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Projected inventory whose ids are those of the conversations (order keys reach further)."""
    return table(spark, sf, "orders").select(
        _event("o_orderkey").alias("event_id"),
        F.col("o_orderpriority").alias("event_type"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit("orders").alias("provenance"),
        F.col("o_orderstatus").alias("desk"),
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles from documents, and a second file with a copy of each for another event.

    Some have no source, some no event in the first file, some no readable time.
    """
    docs = table(spark, sf, "documents")
    doc = F.col("doc_id")

    def part(copy: int) -> DataFrame:
        event = F.concat(F.lit("E"), ((doc + 7 * copy) % 20).cast("string"))
        body = F.substr("text", F.char_length(F.substring_index("text", "\n", 1)) + 2)
        time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + doc * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return docs.select(
            F.concat(F.lit("A"), doc.cast("string")).alias("article_id"),
            (F.when(F.col("lang") == "de", F.lit("")).otherwise(event) if copy == 0 else event).alias("event_id"),
            F.when(F.col("source") == "src3", F.lit("")).otherwise(F.col("source")).alias("source"),
            F.when(F.col("lang") == "es", F.lit("soon")).otherwise(time).alias("published_at"),
            F.substring_index("text", "\n", 1).alias("headline"),
            F.concat(F.lit("https://news.example.com/"), doc.cast("string")).alias("url"),
            body.alias("body_text"),
            F.col("lang").alias("tags"),
            F.col("lang").alias("edition"),
            F.lit(f"dump{copy}").alias("file"),
            F.floor(doc / 500).cast("bigint").alias("split_start"),
            doc.alias("line_no"),
        )

    return part(0).unionByName(part(1))


ARTICLES = """
arts AS (
  SELECT 'A' || doc_id AS article_id,
         CASE WHEN copy = 0 AND lang = 'de' THEN '' ELSE 'E' || ((doc_id + 7 * copy) % 20) END AS event_id,
         CASE WHEN source = 'src3' THEN '' ELSE source END AS source,
         CASE WHEN lang = 'es' THEN 'soon' ELSE strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%SZ') END AS published_at,
         CASE WHEN lang = 'es' THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours(doc_id) END AS t,
         string_split(text, chr(10))[1] AS headline,
         'https://news.example.com/' || doc_id AS url,
         text[len(string_split(text, chr(10))[1]) + 2:] AS body_text,
         lang AS tags, lang AS edition, 'dump' || copy AS file, doc_id AS line_no
  FROM documents, (VALUES (0), (1)) c(copy))
"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with ties and both ends for the labelled documents; one fold has a single class."""
    labels = table(spark, sf, "labels").filter(F.col("quality").isNotNull())
    fold = F.col("doc_id") % 4
    return labels.select(
        fold.cast("int").alias("fold"),
        "doc_id",
        F.when(fold == 3, F.lit(1)).otherwise(F.col("quality")).alias("y"),
        ((F.col("doc_id") * 37) % 101 / 100.0).alias("p"),
    )


PREDICTIONS = """
preds AS (
  SELECT (doc_id % 4)::INTEGER AS fold, doc_id, CASE WHEN doc_id % 4 = 3 THEN 1 ELSE quality END AS y,
         ((doc_id * 37) % 101) / 100.0::DOUBLE AS p
  FROM labels WHERE quality IS NOT NULL)
"""


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades from events: the user is the market, the value the price in cents."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("M-"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("created_time"),
        F.round(F.col("value")).cast("bigint").alias("yes_price"),
        (1 + F.col("event_id") % 5).alias("count"),
        F.col("event_id").alias("trade_id"),
    )


TRADES = """
trades AS (
  SELECT 'M-' || user_id AS ticker, ts AS created_time, round(value)::BIGINT AS yes_price,
         1 + event_id % 5 AS count, event_id AS trade_id
  FROM events)
"""


def markets(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot per event row: four text price fields, some blank, absent, wrong or too high."""
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("T-"), F.col("event_id").cast("string")).alias("ticker"),
        F.when(kind == "view", value).when(kind == "click", F.lit("")).alias("last_price"),
        F.when(kind == "click", (F.col("value") / 1000).cast("decimal(12,6)").cast("string")).alias("last_trade_price"),
        F.when(kind == "error", F.lit("n/a")).alias("yes_bid"),
        F.when(F.col("user_id") % 2 == 0, value).alias("yes_ask"),
    )


MARKETS = """
mk AS (
  SELECT 'T-' || event_id AS ticker,
         CASE event_type WHEN 'view' THEN value::VARCHAR WHEN 'click' THEN '' END AS last_price,
         CASE WHEN event_type = 'click' THEN (value / 1000)::DECIMAL(12,6)::VARCHAR END AS last_trade_price,
         CASE WHEN event_type = 'error' THEN 'n/a' END AS yes_bid,
         CASE WHEN user_id % 2 = 0 THEN value::VARCHAR END AS yes_ask
  FROM events),
raw AS (
  SELECT *, coalesce(nullif(last_price, ''), nullif(last_trade_price, ''), nullif(yes_bid, ''), nullif(yes_ask, '')) AS price FROM mk),
num AS (SELECT *, try_cast(price AS DOUBLE) AS v FROM raw),
priced AS (
  SELECT *, CASE WHEN price IS NULL THEN 'no_price' WHEN v IS NULL THEN 'not_numeric' WHEN v < 0 THEN 'negative'
                 WHEN v / 100 > 1 THEN 'above_one' END AS error,
         CASE WHEN v > 1 THEN v / 100 ELSE v END AS p
  FROM num)
"""
