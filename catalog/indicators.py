"""Queries over indicators, fading news and phrase history; indicators come from order lines by return flag and ship day."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import newsflow, views as v
from phrasecast.functions.frames import sketched_quantiles
from phrasecast.operators import history, indicators

TERMS = newsflow.TERMS


def _indicators(spark, sf):
    """One value per order line; lines without discount have none."""
    return v.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("indicator"), F.col("l_shipdate").cast("date").alias("day"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("value"),
    )


_INDICATORS = """ind AS (
  SELECT l_returnflag AS indicator, l_shipdate::DATE AS day, l_orderkey || '-' || l_linenumber AS row_id,
         CASE WHEN l_discount > 0 THEN l_extendedprice END AS value
  FROM lineitem)"""


def win_trailing_zscore(spark, sf):
    scored = indicators.trailing_zscores(_indicators(spark, sf), ["indicator"], "day", "value", 90)
    return scored.select("indicator", "row_id", F.round("zscore", 6).alias("zscore"))


_ZSCORE_SQL = f"""WITH {_INDICATORS}, w AS (
  SELECT *, avg(value) OVER win AS m, stddev_samp(value) OVER win AS s FROM ind
  WINDOW win AS (PARTITION BY indicator ORDER BY day RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW))
SELECT indicator, row_id, round(CASE WHEN s > 0 THEN (value - m) / s WHEN s = 0 THEN value - m END, 6) AS zscore FROM w"""


def prj_winsorised(spark, sf):
    rows = _indicators(spark, sf)
    flagged = indicators.missing_flags(rows, ["value"])
    out = indicators.winsorise(flagged, ["indicator"], "value", indicators.fit_bounds(rows, ["indicator"], "value"))
    return out.select("indicator", "row_id", F.round("value", 6).alias("value"), "value_missing")


_WINSOR_SQL = f"""WITH {_INDICATORS}, b AS (
  SELECT indicator, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM ind GROUP BY indicator)
SELECT indicator, row_id, round(CASE WHEN value IS NOT NULL THEN least(greatest(value, low), high) END, 6) AS value, value IS NULL AS value_missing
FROM ind JOIN b USING (indicator)"""


def agg_sketched_bounds(spark, sf):
    """Sketched quantiles and whether their ranks keep the stated error."""
    rows, error = _indicators(spark, sf), 1e-3
    found = sketched_quantiles(rows, ["indicator"], "value", {"low": 0.01, "high": 0.99}, error)
    below = rows.join(found, "indicator").groupBy("indicator").agg(
        F.count("value").alias("n"),
        *[F.count_if(F.col("value") <= F.col(c)).alias(f"upto_{c}") for c in ("low", "high")],
        *[F.count_if(F.col("value") < F.col(c)).alias(f"under_{c}") for c in ("low", "high")],
    )
    held = lambda c, q: (F.col(f"under_{c}") <= (q + error) * F.col("n") + 1) & (F.col(f"upto_{c}") >= (q - error) * F.col("n") - 1)
    return below.select("indicator", "n", held("low", 0.01).alias("low_held"), held("high", 0.99).alias("high_held"))


def _halves(spark, sf):
    rows = _indicators(spark, sf)
    shifted = rows.withColumn("value", F.when(F.col("indicator") == "R", F.col("value") * 1.6).otherwise(F.col("value")))
    return rows.filter("day < DATE '1996-01-01'"), shifted.filter("day >= DATE '1996-01-01'")


_HALVES = f"""{_INDICATORS}, train AS (SELECT indicator, value FROM ind WHERE day < DATE '1996-01-01' AND value IS NOT NULL),
recent AS (SELECT indicator, CASE WHEN indicator = 'R' THEN value * 1.6 ELSE value END AS value FROM ind WHERE day >= DATE '1996-01-01' AND value IS NOT NULL)"""


def agg_drift(spark, sf):
    train, recent = _halves(spark, sf)
    out = indicators.drift(train, recent, ["indicator"], "value")
    return indicators.report_values(out, {"psi": 6, "ks": 6})


_DRIFT_SQL = f"""WITH {_HALVES},
q AS (SELECT indicator, unnest([i / 10.0 for i in range(1, 10)]) AS p FROM (SELECT DISTINCT indicator FROM train)),
b AS (SELECT q.indicator, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS l
      FROM (SELECT DISTINCT indicator FROM q) q JOIN train USING (indicator) GROUP BY q.indicator),
bins AS (SELECT indicator, unnest(range(0, len(l) + 1)) AS bin FROM b),
t AS (SELECT indicator, len(list_filter(l, lambda x: x < value)) AS bin, count(*) AS n FROM train JOIN b USING (indicator) GROUP BY ALL),
r AS (SELECT indicator, len(list_filter(l, lambda x: x < value)) AS bin, count(*) AS n FROM recent JOIN b USING (indicator) GROUP BY ALL),
s AS (SELECT indicator, greatest(coalesce(t.n, 0) / sum(t.n) OVER (PARTITION BY indicator), 0.0001) AS e,
             greatest(coalesce(r.n, 0) / sum(r.n) OVER (PARTITION BY indicator), 0.0001) AS a
      FROM bins LEFT JOIN t USING (indicator, bin) LEFT JOIN r USING (indicator, bin)),
psi AS (SELECT indicator, sum((a - e) * ln(a / e)) AS psi FROM s GROUP BY indicator),
both_tables AS (SELECT indicator, value, 1 AS t, 0 AS r FROM train UNION ALL SELECT indicator, value, 0, 1 FROM recent),
f AS (SELECT indicator, sum(t) OVER w / sum(t) OVER (PARTITION BY indicator) AS ft, sum(r) OVER w / sum(r) OVER (PARTITION BY indicator) AS fr
      FROM both_tables WINDOW w AS (PARTITION BY indicator ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT indicator, max(abs(ft - fr)) AS ks FROM f GROUP BY indicator)
SELECT indicator, round(psi, 6) AS psi, psi > 0.2 AS drifted, round(ks, 6) AS ks FROM psi LEFT JOIN ks USING (indicator)"""


def prj_filled_gaps(spark, sf):
    """Gaps of the later orders filled with what the earlier ones say."""
    rows = v.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderkey") % 7 > 1, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"),
    )
    fills = indicators.fit_fills(rows.filter("day < DATE '1996-01-01'"), ["price"], ["priority"])
    out = indicators.fill_gaps(rows.filter("day >= DATE '1996-01-01'"), fills, ["price"], ["priority"])
    return out.select("o_orderkey", F.round("price", 6).alias("price"), "priority")


_FILLED_SQL = """WITH o AS (
  SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 7 > 1 THEN o_totalprice END AS price,
         CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority FROM orders),
m AS (SELECT median(price) AS price FROM o WHERE day < DATE '1996-01-01'),
c AS (SELECT priority FROM o WHERE day < DATE '1996-01-01' AND priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)
SELECT o_orderkey, round(coalesce(o.price, (SELECT price FROM m)), 6) AS price, coalesce(o.priority, (SELECT priority FROM c)) AS priority
FROM o WHERE day >= DATE '1996-01-01'"""


def win_decayed_news(spark, sf):
    """Fading counts at each publication time; blocks of three hours cut every event into many."""
    out = history.decaying_news(newsflow._copies(spark, sf), TERMS, block=3 * 3600)
    return out.select("event_id", "seen_at", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


_DECAYED_SQL = f"""WITH {newsflow._COPIES}, timed AS (SELECT event_id, epoch(t)::BIGINT AS seen_at, n_the, n_entre FROM copies WHERE t IS NOT NULL)
SELECT o.event_id, o.seen_at, round(sum(pow(2, (i.seen_at - o.seen_at) / 86400.0)), 6) AS decayed_articles,
       round(sum(i.n_the * pow(2, (i.seen_at - o.seen_at) / 86400.0)), 6) AS decayed_news_target__the_count,
       round(sum(i.n_entre * pow(2, (i.seen_at - o.seen_at) / 86400.0)), 6) AS decayed_news_target__entre_count
FROM (SELECT DISTINCT event_id, seen_at FROM timed) o JOIN timed i ON i.event_id = o.event_id AND i.seen_at <= o.seen_at GROUP BY o.event_id, o.seen_at"""


def agg_decayed_news(spark, sf):
    """News of each event as they weigh when it starts; events start on different days, one before all its news."""
    copies = newsflow._copies(spark, sf)
    number = F.substr("event_id", F.lit(2)).cast("int")
    starts = v.articles(spark, sf).filter("event_id <> ''").select("event_id").distinct()
    starts = starts.withColumn("starts_at", F.timestamp_seconds(F.lit(1704067200 - 3600) + number * 86400))
    out = history.decayed_event_features(copies, starts, TERMS)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_DECAYED_EVENTS_SQL = f"""WITH {newsflow._COPIES},
starts AS (SELECT DISTINCT event_id, 1704067200 - 3600 + event_id[2:]::INTEGER * 86400 AS s FROM arts WHERE event_id <> ''),
w AS (SELECT c.event_id, pow(2, (epoch(t) - s) / 86400.0) AS w, n_the, n_entre FROM copies c JOIN starts USING (event_id) WHERE t IS NOT NULL AND epoch(t) <= s),
f AS (SELECT event_id, sum(w) AS a, avg(w) AS m, max(w) AS g, sum(w * n_the) AS t, sum(w * n_entre) AS e FROM w GROUP BY event_id)
SELECT event_id, round(coalesce(a, 0), 6) AS decayed_articles, round(m, 6) AS mean_weight, round(g, 6) AS max_weight,
       round(coalesce(t, 0), 6) AS decayed_news_target__the_count, round(coalesce(e, 0), 6) AS decayed_news_target__entre_count
FROM starts LEFT JOIN f USING (event_id)"""


def _rolled(df, by):
    return df.select(
        "target", "event_id", "event_date", *by, "was_said", "past_events",
        *[F.round(c, 6).alias(c) for c in ("past_rate", "trend", "surprise")],
    )


def win_rolling_frequency(spark, sf):
    """Blocks of seven places, so that the last ten events reach over two of them."""
    return _rolled(history.rolling_frequency(v.labelled(spark, sf), v.TARGETS, 10, block=7), [])


def win_speaker_frequency(spark, sf):
    return _rolled(history.rolling_frequency(v.labelled(spark, sf), v.TARGETS, 6, by=["speaker"]), ["speaker"])


def _rolling_sql(k, by=""):
    half = k // 2
    over = f"OVER (PARTITION BY target{', ' + by if by else ''} ORDER BY event_date, md5(event_id) ROWS BETWEEN"
    columns = ", ".join(f"max({t}::INT) AS {t}" for t in v.TARGETS)
    return f"""WITH {v.LABELLED}, e AS (SELECT event_id, event_date{', ' + by if by else ''}, {columns} FROM lab GROUP BY ALL),
l AS (UNPIVOT e ON {', '.join(v.TARGETS)} INTO NAME target VALUE was_said),
w AS (SELECT *, count(*) {over} {k} PRECEDING AND 1 PRECEDING) AS past_events, avg(was_said) {over} {k} PRECEDING AND 1 PRECEDING) AS r,
  avg(was_said) {over} {half} PRECEDING AND 1 PRECEDING) AS n, avg(was_said) {over} {k} PRECEDING AND {half + 1} PRECEDING) AS o FROM l)
SELECT target, event_id, event_date{', ' + by if by else ''}, was_said, past_events, round(r, 6) AS past_rate, round(n - o, 6) AS trend,
  round(was_said - r, 6) AS surprise FROM w"""


QUERIES = {
    "win_trailing_zscore": (win_trailing_zscore, _ZSCORE_SQL),
    "prj_winsorised": (prj_winsorised, _WINSOR_SQL),
    "agg_sketched_bounds": (agg_sketched_bounds, f"WITH {_INDICATORS} SELECT indicator, count(value) AS n, true AS low_held, true AS high_held FROM ind GROUP BY indicator"),
    "agg_drift": (agg_drift, _DRIFT_SQL),
    "prj_filled_gaps": (prj_filled_gaps, _FILLED_SQL),
    "win_decayed_news": (win_decayed_news, _DECAYED_SQL),
    "agg_decayed_news": (agg_decayed_news, _DECAYED_EVENTS_SQL),
    "win_rolling_frequency": (win_rolling_frequency, _rolling_sql(10)),
    "win_speaker_frequency": (win_speaker_frequency, _rolling_sql(6, "speaker")),
}
