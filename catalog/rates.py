"""Queries over event flags, base rates, series and market prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from phrasecast.functions import numbers as nb
from phrasecast.operators import market, rates
from phrasecast.plans import edge
from phrasecast.session import scratch_path

_T = ", ".join(v.TARGETS)
_FLAGS = ", ".join(f"bool_or({t}) AS {t}" for t in v.TARGETS)
_COUNTS = ", ".join(f"sum({t}::INT)::BIGINT AS {t}" for t in v.TARGETS)
_FLAG_CTE = f"{v.LABELLED}, flags AS (SELECT event_id, {_FLAGS} FROM lab GROUP BY event_id)"
_COUNT_CTE = f"{v.LABELLED}, counts AS (SELECT event_id, {_COUNTS} FROM lab GROUP BY event_id)"
_LONG_FLAGS = f"{_FLAG_CTE}, long AS (SELECT event_id, replace(target, 'target__', '') AS target, hit FROM (UNPIVOT flags ON {_T} INTO NAME target VALUE hit))"
_LONG_COUNTS = f"{_COUNT_CTE}, long AS (SELECT event_id, replace(target, 'target__', '') AS target, hits FROM (UNPIVOT counts ON {_T} INTO NAME target VALUE hits))"
_WILSON = f"""{_LONG_FLAGS}, kn AS (SELECT target, count_if(hit)::BIGINT AS k, count(*) AS n FROM long GROUP BY target),
ci AS (
  SELECT target, k, n, k / n AS prob,
    greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)) AS ci_lo,
    least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)) AS ci_hi
  FROM kn)"""
_CI_COLUMNS = "target, k, n, round(prob, 6) AS prob, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def agg_event_flags(spark, sf):
    return rates.event_flags(v.labelled(spark, sf), v.TARGETS)


def agg_event_counts(spark, sf):
    return rates.event_counts(v.labelled(spark, sf), v.TARGETS)


def agg_base_rates(spark, sf):
    return _rounded(rates.base_rates(v.labelled(spark, sf), v.TARGETS), "historical_prob")


def agg_mean_hits(spark, sf):
    return _rounded(rates.mean_hits(v.labelled(spark, sf), v.TARGETS), "avg_num")


def agg_event_series(spark, sf):
    return rates.event_series(v.labelled(spark, sf), "target__the")


def agg_event_series_counts(spark, sf):
    return rates.event_series(v.labelled(spark, sf), "target__the", counts=True)


def agg_rate_intervals(spark, sf):
    return _rounded(rates.rate_intervals(v.labelled(spark, sf), v.TARGETS), "prob", "ci_lo", "ci_hi")


def lim_top_phrases(spark, sf):
    top = rates.top_phrases(rates.rate_intervals(v.labelled(spark, sf), v.TARGETS), 3)
    return _rounded(top, "prob", "ci_lo", "ci_hi")


def agg_hit_matrix(spark, sf):
    return rates.hit_matrix(v.labelled(spark, sf), v.TARGETS)


def agg_hit_matrix_counts(spark, sf):
    return rates.hit_matrix(v.labelled(spark, sf), v.TARGETS, counts=True)


def lim_event_order(spark, sf):
    return rates.events_in_order(v.segments(spark, sf))


def win_cumulative_share(spark, sf):
    return _rounded(rates.cumulative_share(v.labelled(spark, sf), v.TARGETS), "cum_share")


_CUMULATIVE_SQL = f"""WITH {_LONG_FLAGS}, dated AS (
  SELECT l.event_id, d.event_date, target, hit::INT::BIGINT AS was_said
  FROM long l JOIN (SELECT DISTINCT event_id, event_date FROM lab) d USING (event_id)),
run AS (
  SELECT *, row_number() OVER w AS event_index, sum(was_said) OVER w AS cum_was_said FROM dated
  WINDOW w AS (PARTITION BY target ORDER BY event_date, md5(event_id) ROWS UNBOUNDED PRECEDING))
SELECT event_id, event_date, target, was_said, event_index, cum_was_said::BIGINT AS cum_was_said,
       round(cum_was_said / event_index, 6) AS cum_share FROM run"""


def win_cumulative_undated(spark, sf):
    return _rounded(rates.cumulative_share_undated(v.labelled(spark, sf), "target__entre"), "cum_share")


_UNDATED_SQL = f"""WITH {_FLAG_CTE}, run AS (
  SELECT event_id, target__entre::INT::BIGINT AS was_said, row_number() OVER w AS event_index,
         sum(target__entre::INT) OVER w AS cum_was_said FROM flags
  WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, was_said, event_index, cum_was_said::BIGINT AS cum_was_said, round(cum_was_said / event_index, 6) AS cum_share FROM run"""


def agg_event_probability(spark, sf):
    scored = v.segments(spark, sf).select("event_id", ((F.char_length("text") % 101) / 100.0).alias("probability"))
    return _rounded(rates.event_probability(scored), "any_segment", "mean_segment", "max_segment")


_PROBABILITY_SQL = f"""WITH {v.SEGMENTS}, s AS (SELECT event_id, (len(text) % 101) / 100.0::DOUBLE AS p FROM segs)
SELECT event_id, round(1 - product(1 - p), 6) AS any_segment, round(avg(p), 6) AS mean_segment, round(max(p), 6) AS max_segment
FROM s GROUP BY event_id"""


def mth_odds(spark, sf):
    """Implied probability and Kelly edge over the order lines (quantity as odds, discount as estimate)."""
    lines = v.table(spark, sf, "lineitem")
    implied = nb.implied_probability(F.col("l_quantity"))
    return lines.select(
        "l_orderkey", "l_linenumber",
        F.round(implied, 6).alias("implied"),
        F.round(nb.kelly_edge(F.col("l_discount"), implied), 6).alias("edge"),
    )


_ODDS_SQL = """SELECT l_orderkey, l_linenumber, round(1.0 / nullif(l_quantity, 0), 6) AS implied,
round(CASE WHEN 1.0 / nullif(l_quantity, 0) <> 1 THEN (l_discount - 1.0 / nullif(l_quantity, 0)) / (1 - 1.0 / nullif(l_quantity, 0)) END, 6) AS edge FROM lineitem"""


def prj_timestamps(spark, sf):
    """Times of events as text in several spellings, read back as Unix seconds."""
    events = v.table(spark, sf, "events")
    t = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.unix_timestamp(t).cast("string"))
        .when(kind == 1, F.concat(F.unix_timestamp(t).cast("string"), F.lit(".75")))
        .when(kind == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 3, F.date_format(t, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("at "), F.date_format(t, "HH:mm")))
    )
    return events.select("event_id", nb.unix_seconds(text).alias("seconds"))


_TIMES_SQL = """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN epoch(ts::DATE)::BIGINT
ELSE floor(epoch(ts))::BIGINT END AS seconds FROM events"""


def prj_references(spark, sf):
    """Page addresses and tickers as market references, most of them with an error."""
    pages = v.table(spark, sf, "pages")
    kind = F.col("page_id") % 4
    number = F.col("page_id").cast("string")
    value = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat(F.lit("https://market.example.com/markets/series"), number, F.lit("/any-name/series"), number, F.lit("-25oct?x=1")))
        .when(kind == 2, F.concat(F.lit(" series"), number, F.lit("-a-b ")))
        .otherwise(F.concat(F.lit("single"), number))
    )
    given = F.when(F.col("page_id") % 8 == 3, F.lit("given"))
    named = pages.select("page_id", value.alias("value"), given.alias("series"))
    return market.parse_references(named, "value", "series").drop("value", "series")


_REFERENCES_SQL = """SELECT page_id,
CASE page_id % 4 WHEN 1 THEN 'series' || page_id WHEN 2 THEN 'series' || page_id WHEN 3 THEN CASE WHEN page_id % 8 = 3 THEN 'given' END END AS series_ticker,
CASE page_id % 4 WHEN 1 THEN 'series' || page_id || '-25oct' WHEN 2 THEN 'series' || page_id || '-a-b' WHEN 3 THEN CASE WHEN page_id % 8 = 3 THEN 'single' || page_id END END AS market_ticker,
CASE page_id % 4 WHEN 0 THEN 'bad_url' WHEN 3 THEN CASE WHEN page_id % 8 <> 3 THEN 'no_series' END END AS error
FROM pages"""


def prj_prices(spark, sf):
    return _rounded(market.market_probabilities(v.markets(spark, sf)), "market_probability")


def jn_price_failures(spark, sf):
    return market.price_failures(v.markets(spark, sf)).select("ticker", "error")


def jn_market_edge(spark, sf):
    model = v.table(spark, sf, "events").select(
        F.concat(F.lit("T-"), F.col("event_id").cast("string")).alias("ticker"),
        ((F.col("event_id") % 100) / 100.0).alias("model_probability"),
    )
    out = market.compare_to_market(model, market.market_probabilities(v.markets(spark, sf)))
    return _rounded(out, "market_probability", "edge")


_EDGE_SQL = f"""WITH {v.MARKETS}
SELECT ticker, (replace(ticker, 'T-', '')::BIGINT % 100) / 100.0::DOUBLE AS model_probability, round(p, 6) AS market_probability,
       round((replace(ticker, 'T-', '')::BIGINT % 100) / 100.0::DOUBLE - p, 6) AS edge
FROM priced WHERE error IS NULL"""


def _phrase_markets(spark, sf):
    """Each event row quotes one phrase; the latest quote of a phrase is its market."""
    events = v.table(spark, sf, "events")
    names = F.array(*[F.lit(t.replace("target__", "")) for t in v.TARGETS])
    quotes = events.select(
        F.element_at(names, (F.col("event_id") % len(v.TARGETS) + 1).cast("int")).alias("target"),
        "event_id",
        F.col("value").cast("string").alias("value"),
    )
    last = quotes.groupBy("target").agg(F.max_by("value", "event_id").alias("last_price"))
    none = F.lit(None).cast("string")
    return last.select(
        F.concat(F.lit("P-"), F.col("target")).alias("ticker"), "target", "last_price",
        none.alias("last_trade_price"), none.alias("yes_bid"), none.alias("yes_ask"),
    )


def jn_edge_report(spark, sf):
    return edge.phrase_edges(v.labelled(spark, sf), v.TARGETS, _phrase_markets(spark, sf))


_REPORT_SQL = f"""WITH {_WILSON},
q AS (SELECT (ARRAY['the','is','of_the','le_la','entre','policy'])[event_id % 6 + 1] AS target, event_id, value FROM events),
m AS (SELECT target, max_by(value, event_id) AS v FROM q GROUP BY target),
mp AS (SELECT target, CASE WHEN v > 1 THEN v / 100 ELSE v END AS mp FROM m WHERE v >= 0 AND v <= 100)
SELECT target AS phrase, round(prob, 3) AS my_prob, round(ci_lo, 3) AS conservative_prob, round(mp, 3) AS market_prob,
       round(CASE WHEN mp <> 1 THEN (prob - mp) / (1 - mp) END, 4) AS edge_prob_based,
       round(CASE WHEN mp <> 1 THEN (ci_lo - mp) / (1 - mp) END, 4) AS edge_conservative
FROM ci JOIN mp USING (target)"""


def agg_candles(spark, sf):
    return _rounded(market.candlesticks(v.trades(spark, sf), 60), "mean")


def agg_candles_daily(spark, sf):
    return _rounded(market.candlesticks(v.trades(spark, sf), 1440), "mean")


def _candles_sql(minutes: int) -> str:
    s = minutes * 60
    return f"""{v.TRADES}, bars AS (
  SELECT ticker, (floor(epoch(created_time) / {s}) * {s} + {s})::BIGINT AS end_period_ts,
         first(yes_price ORDER BY created_time, trade_id) AS open, max(yes_price) AS high, min(yes_price) AS low,
         last(yes_price ORDER BY created_time, trade_id) AS close, round(avg(yes_price), 6) AS mean, sum(count)::BIGINT AS volume
  FROM trades GROUP BY 1, 2),
candles AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY end_period_ts) AS previous FROM bars)"""


_START, _END = 1704153600, 1704758400


def flt_candles(spark, sf):
    return market.filter_candles(agg_candles(spark, sf), _START, _END, 60)


def snk_candle_payloads(spark, sf):
    """Payloads written as JSON and read back, one row per market."""
    path = scratch_path(spark, "candles")
    payloads = market.candle_payloads(market.candlesticks(v.trades(spark, sf), 60), _START, _END, 60)
    payloads.write.json(path)
    schema = (
        "series_ticker string, market_ticker string, start_ts bigint, end_ts bigint, period_minutes int, part bigint, "
        "candlesticks array<struct<end_period_ts:bigint,close:bigint,volume:bigint>>"
    )
    read = spark.read.schema(schema).json(path)
    return read.select(
        "series_ticker", "market_ticker", "start_ts", "end_ts", "period_minutes", "part",
        F.size("candlesticks").cast("bigint").alias("candles"),
        F.get("candlesticks", F.lit(0))["end_period_ts"].alias("first_end"),
        F.element_at("candlesticks", -1)["close"].alias("last_close"),
    )


_PAYLOAD_SQL = f"""WITH {_candles_sql(60)}
SELECT 'M' AS series_ticker, ticker AS market_ticker, {_START}::BIGINT AS start_ts, {_END}::BIGINT AS end_ts, 60::INTEGER AS period_minutes,
       0::BIGINT AS part, count(*) AS candles, min(end_period_ts) AS first_end, max_by(close, end_period_ts) AS last_close
FROM candles WHERE end_period_ts BETWEEN {_START} AND {_END} GROUP BY ticker"""


def _candle_documents(spark, sf):
    """One JSON document per event row: a list with a candle and, at times, a stray text, or no list."""
    events = v.table(spark, sf, "events")
    price = F.round("value").cast("bigint")
    bar = F.to_json(F.struct(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("end_period_ts"), F.col("user_id").alias("volume"),
        F.struct(price.alias("open"), price.alias("close")).alias("price"),
    ))
    payload = (
        F.when(F.col("event_type") == "view", F.lit('{"candlesticks": null}'))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"candlesticks": ["stray", '), bar, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"candlesticks": ['), bar, F.lit("]}")))
    )
    return events.select("event_id", payload.alias("payload"))


def flt_candle_documents(spark, sf):
    return market.read_candles(_candle_documents(spark, sf)).select(
        "event_id", "position", "end_period_ts", "volume", F.col("price.close").alias("close")
    )


def flt_bad_candles(spark, sf):
    return market.bad_candles(_candle_documents(spark, sf)).select("event_id", "position", "entry")


_DOCUMENT_SQL = """SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::INTEGER AS position,
floor(epoch(ts))::BIGINT AS end_period_ts, user_id AS volume, round(value)::BIGINT AS close FROM events WHERE event_type <> 'view'"""


QUERIES = {
    "agg_event_flags": (agg_event_flags, f"WITH {_FLAG_CTE} SELECT * FROM flags"),
    "agg_event_counts": (agg_event_counts, f"WITH {_COUNT_CTE} SELECT * FROM counts"),
    "agg_base_rates": (agg_base_rates, f"WITH {_LONG_FLAGS} SELECT target, round(avg(hit::INT), 6) AS historical_prob FROM long GROUP BY target"),
    "agg_mean_hits": (agg_mean_hits, f"WITH {_LONG_COUNTS} SELECT target, round(avg(hits), 6) AS avg_num FROM long GROUP BY target"),
    "agg_event_series": (agg_event_series, f"WITH {v.LABELLED} SELECT event_id, max(event_date) AS event_date, bool_or(target__the) AS was_said FROM lab GROUP BY event_id"),
    "agg_event_series_counts": (agg_event_series_counts, f"WITH {v.LABELLED} SELECT event_id, event_date, sum(target__the::INT)::BIGINT AS hit_count FROM lab GROUP BY event_id, event_date"),
    "agg_rate_intervals": (agg_rate_intervals, f"WITH {_WILSON} SELECT {_CI_COLUMNS} FROM ci"),
    "lim_top_phrases": (lim_top_phrases, f"WITH {_WILSON} SELECT {_CI_COLUMNS} FROM ci ORDER BY ci.prob DESC, target LIMIT 3"),
    "agg_hit_matrix": (agg_hit_matrix, f"WITH {_FLAG_CTE} SELECT f.event_id, d.event_date, {', '.join(f'{t}::INT::BIGINT AS {t}' for t in v.TARGETS)} FROM flags f JOIN (SELECT DISTINCT event_id, event_date FROM lab) d USING (event_id)"),
    "agg_hit_matrix_counts": (agg_hit_matrix_counts, f"WITH {_COUNT_CTE} SELECT c.event_id, d.event_date, {_T} FROM counts c JOIN (SELECT DISTINCT event_id, event_date FROM lab) d USING (event_id)"),
    "lim_event_order": (lim_event_order, f"WITH {v.SEGMENTS} SELECT DISTINCT event_id, event_date FROM segs"),
    "win_cumulative_share": (win_cumulative_share, _CUMULATIVE_SQL),
    "win_cumulative_undated": (win_cumulative_undated, _UNDATED_SQL),
    "agg_event_probability": (agg_event_probability, _PROBABILITY_SQL),
    "mth_odds": (mth_odds, _ODDS_SQL),
    "prj_timestamps": (prj_timestamps, _TIMES_SQL),
    "prj_references": (prj_references, _REFERENCES_SQL),
    "prj_prices": (prj_prices, f"WITH {v.MARKETS} SELECT ticker, round(p, 6) AS market_probability FROM priced WHERE error IS NULL"),
    "jn_price_failures": (jn_price_failures, f"WITH {v.MARKETS} SELECT ticker, error FROM priced WHERE error IS NOT NULL"),
    "jn_market_edge": (jn_market_edge, _EDGE_SQL),
    "jn_edge_report": (jn_edge_report, _REPORT_SQL),
    "agg_candles": (agg_candles, f"WITH {_candles_sql(60)} SELECT * FROM candles"),
    "agg_candles_daily": (agg_candles_daily, f"WITH {_candles_sql(1440)} SELECT * FROM candles"),
    "flt_candles": (flt_candles, f"WITH {_candles_sql(60)} SELECT * FROM candles WHERE end_period_ts BETWEEN {_START} AND {_END}"),
    "snk_candle_payloads": (snk_candle_payloads, _PAYLOAD_SQL),
    "flt_candle_documents": (flt_candle_documents, _DOCUMENT_SQL),
    "flt_bad_candles": (flt_bad_candles, "SELECT event_id, 0::INTEGER AS position, 'stray' AS entry FROM events WHERE event_type = 'error'"),
}
