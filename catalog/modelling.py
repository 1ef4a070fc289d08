"""Queries of the modelling flow: labels, features, folds, models, metrics, run comparison."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import views as v
from phrasecast.functions import numbers as nb
from phrasecast.operators import features as fx, folds as fl, metrics as mt, models as md, profile, rates
from phrasecast.plans import experiment as ex
from phrasecast.session import materialize, scratch_path
from phrasecast.sources import tables


def _documents(spark, sf):
    """Documents with their label (NULL where there is none), a date and an event."""
    docs = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", "text", "lang", "source", "quality",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("event_date"),
        F.col("source").alias("event_id"),
    )


def flt_labels(spark, sf):
    return fl.labelled_rows(_documents(spark, sf), "quality").select("doc_id", "label")


def fea_tfidf(spark, sf):
    """Weights of all documents, summed up per document."""
    docs = v.table(spark, sf, "documents")
    # Sorted by term, the table and what is shuffled by term compress better.
    counts = materialize(fx.term_counts(docs, "doc_id", "text").sortWithinPartitions("term"), "counts")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    weights = fx.tfidf(counts, materialize(fx.fit_tfidf(counts, n), "vocabulary"), slices=4)
    return weights.groupBy(F.col("row_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("terms"), F.min("feature").alias("first_term"),
        F.round(F.sum("value"), 5).alias("total"), F.round(F.max("value"), 5).alias("top"),
    )


def fea_vocabulary(spark, sf):
    """The 500 terms with the highest corpus frequency, single words only."""
    docs = v.table(spark, sf, "documents")
    counts = fx.term_counts(docs, "doc_id", "text", (1, 1))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return fx.fit_tfidf(counts, n, 2, 0.9, 500).select("term", "df", F.round("idf", 6).alias("idf"))


def _counts_sql(ngrams: bool) -> str:
    pairs = " || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])" if ngrams else ""
    return f"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents),
grams AS (SELECT doc_id, unnest(w{pairs}) AS term FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9::DOUBLE * (SELECT n FROM nd))"""


_TFIDF_SQL = f"""WITH {_counts_sql(True)},
w AS (SELECT doc_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), nd),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM w)
SELECT doc_id, count(*) AS terms, min(term) AS first_term, round(sum(v), 5) AS total, round(max(v), 5) AS top FROM u GROUP BY doc_id"""
_VOCABULARY_SQL = f"""WITH {_counts_sql(False)}
SELECT term, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM vocab, nd ORDER BY cf DESC, term LIMIT 500"""


def fea_one_hot(spark, sf):
    docs = _documents(spark, sf)
    levels = fx.fit_one_hot(docs, "doc_id", ["lang", "source"], "first")
    return fx.one_hot(docs, "doc_id", ["lang", "source"], levels).withColumnRenamed("row_id", "doc_id")


_ONE_HOT_SQL = """SELECT doc_id, 'lang_' || lang AS feature, 1.0::DOUBLE AS value FROM documents WHERE lang <> (SELECT min(lang) FROM documents)
UNION ALL SELECT doc_id, 'source_' || source, 1.0::DOUBLE FROM documents WHERE source <> (SELECT min(source) FROM documents)"""


def fea_embeddings(spark, sf):
    docs = v.table(spark, sf, "documents")
    cells = fx.embedding_features(docs, "doc_id", v.table(spark, sf, "embeddings"), "vec_id")
    return cells.select(F.col("row_id").alias("doc_id"), "feature", F.round("value", 6).alias("value"))


_EMBEDDING_SQL = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY vec_id)
SELECT vec_id AS doc_id, 'embedding_' || lpad(i::VARCHAR, 5, '0') AS feature, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 6) AS value
FROM e JOIN n USING (vec_id) WHERE vec_id IN (SELECT doc_id FROM documents)"""


def fea_scaled(spark, sf):
    """Numeric columns of the order lines as features, scaled to unit deviation."""
    lines = v.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_quantity", "l_extendedprice"
    )
    cells = fx.numeric_features(lines, "line_id", ["l_quantity", "l_extendedprice"])
    n = lines.agg(F.count(F.lit(1)).alias("n")).scalar()
    scaled = fx.scale_features(cells, fx.fit_scales(cells, n))
    return scaled.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.max("value"), 5).alias("top"), F.round(F.avg("value"), 5).alias("mean")
    )


_SCALED_SQL = """WITH s AS (SELECT stddev_pop(l_quantity) AS a, stddev_pop(l_extendedprice) AS b FROM lineitem)
SELECT 'l_quantity' AS feature, count(*) AS rows, round(max(l_quantity / a), 5) AS top, round(avg(l_quantity / a), 5) AS mean FROM lineitem, s
UNION ALL SELECT 'l_extendedprice', count(*), round(max(l_extendedprice / b), 5), round(avg(l_extendedprice / b), 5) FROM lineitem, s"""


def fea_vectors(spark, sf):
    """Text, category and embedding blocks of the documents in one sparse vector each."""
    docs = v.table(spark, sf, "documents")
    counts = materialize(fx.term_counts(docs, "doc_id", "text", (1, 1)), "counts")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    cells = materialize(
        fx.union_features(
            {
                "text": fx.tfidf(counts, fx.fit_tfidf(counts, n, 2, 0.9, 2000), 2000),
                "category": fx.one_hot(docs, "doc_id", ["lang"], fx.fit_one_hot(docs, "doc_id", ["lang"])),
                "dense": fx.embedding_features(docs, "doc_id", v.table(spark, sf, "embeddings"), "vec_id"),
            }
        ),
        "cells",
    )
    index = fx.feature_index(cells)  # the names that occur
    rows = docs.select(F.col("doc_id").alias("row_id"))
    vectors = fx.feature_vectors(rows, cells, index, index.count())
    dense = vector_to_array("features")
    return vectors.select(
        F.col("row_id").alias("doc_id"), F.size(dense).alias("size"), F.size(F.filter(dense, lambda x: x != 0)).alias("used")
    )


_VECTORS_SQL = f"""WITH {_counts_sql(False)},
top AS (SELECT term FROM vocab ORDER BY cf DESC, term LIMIT 2000),
used AS (SELECT doc_id, count(*) AS n FROM tf JOIN top USING (term) GROUP BY 1),
width AS (SELECT (SELECT count(*) FROM top) + (SELECT count(DISTINCT lang) FROM documents) + (SELECT max(len(embedding)) FROM embeddings) AS size)
SELECT d.doc_id, size::INTEGER AS size, (coalesce(n, 0) + 1 + coalesce(len(list_filter(embedding, lambda x: x <> 0)), 0))::INTEGER AS used
FROM documents d CROSS JOIN width LEFT JOIN used USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""


def win_date_positions(spark, sf):
    return fl.date_positions(_documents(spark, sf), "event_date", "doc_id")


_DATED = "docs AS (SELECT doc_id, DATE '2024-01-01' + (doc_id % 40)::INTEGER AS event_date, source AS event_id FROM documents)"
_POSITION = f"{_DATED}, pos AS (SELECT *, row_number() OVER (ORDER BY event_date, md5(doc_id::VARCHAR)) - 1 AS position FROM docs)"


def fld_rolling(spark, sf):
    return fl.rolling_folds(_documents(spark, sf), 3, 5, "event_date", "doc_id")


def fld_rolling_minimum(spark, sf):
    """The first fold has too few training rows and is skipped; the others move up."""
    return fl.rolling_folds(_documents(spark, sf), 5, 200, "event_date", "doc_id")


def _rolling_sql(k: int, minimum: int) -> str:
    return f"""WITH {_POSITION}, s AS (SELECT count(*) AS n, greatest(1, count(*) // {k + 1}) AS ts FROM docs),
f AS (SELECT i, n - ({k} - i) * ts AS start, ts FROM s, range({k}) r(i)),
kept AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS fold FROM f WHERE start >= {minimum})
SELECT doc_id, fold::INTEGER AS fold, CASE WHEN position < start THEN 'train' ELSE 'validate' END AS role
FROM pos, kept WHERE position < start + ts"""


def fld_leave_one_out(spark, sf):
    return fl.leave_one_event_out(_documents(spark, sf), 5)


def fld_held_out_rows(spark, sf):
    docs = _documents(spark, sf)
    return fl.held_out_rows(docs, fl.leave_one_event_out(docs, 5), "doc_id")


_LOEO = f"""{_DATED}, e AS (SELECT event_id, count(*) AS n_validate FROM docs GROUP BY 1),
folds AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS fold, event_id, n_validate, (SELECT count(*) FROM docs) - n_validate AS n_train
  FROM e WHERE (SELECT count(*) FROM docs) - n_validate >= 5)"""


def fld_stratified(spark, sf):
    rows = fl.labelled_rows(_documents(spark, sf), "quality").select("doc_id", "label")
    return fl.stratified_parts(rows, 3, "label", "doc_id")


_STRATIFIED_SQL = """WITH r AS (SELECT doc_id, quality::INTEGER AS label,
  row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR)) - 1 AS at0, count(*) OVER (PARTITION BY quality) AS n
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
SELECT doc_id, label, floor(at0 * 3 / n)::INTEGER AS part FROM r"""


def _round_metrics(df):
    return df.withColumns({m: F.round(m, 6) for m in mt.METRICS})


def met_classification(spark, sf):
    return _round_metrics(mt.classification_metrics(v.predictions(spark, sf)))


_METRICS = f"""{v.PREDICTIONS},
point AS (
  SELECT fold, avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)) AS log_loss, avg((p - y) * (p - y)) AS brier,
    count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y = 0) AS fp, count_if(p < 0.5 AND y = 1) AS fn, count(*) AS n
  FROM (SELECT *, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM preds) GROUP BY fold),
auc AS (
  SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS roc_auc
  FROM preds a JOIN preds b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY a.fold),
thr AS (
  SELECT t.fold, t.p, t.pos, (SELECT count(*) FROM preds x WHERE x.fold = t.fold AND x.p >= t.p AND x.y = 1) AS tp,
         (SELECT count(*) FROM preds x WHERE x.fold = t.fold AND x.p >= t.p) AS said,
         (SELECT count(*) FROM preds x WHERE x.fold = t.fold AND x.y = 1) AS npos
  FROM (SELECT fold, p, count_if(y = 1) AS pos FROM preds GROUP BY fold, p) t),
ap AS (SELECT fold, coalesce(sum(pos / npos * tp / said), 0) AS average_precision FROM thr GROUP BY fold),
mets AS (
  SELECT fold, log_loss, brier, coalesce(roc_auc, 'nan'::DOUBLE) AS roc_auc, average_precision,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, (n - fp - fn) / n AS accuracy
  FROM point LEFT JOIN auc USING (fold) JOIN ap USING (fold))"""
_ROUNDED = ", ".join(f"round({m}::DOUBLE, 6) AS {m}" for m in mt.METRICS)


def met_mean_over_folds(spark, sf):
    per_fold = mt.classification_metrics(v.predictions(spark, sf))
    return mt.mean_over_folds(mt.long_metrics(per_fold)).withColumn("value", F.round("value", 6))


def agg_fold_summary(spark, sf):
    """Metrics written per fold as JSON, read back (bare NaN included) and summarised."""
    per_fold = mt.classification_metrics(v.predictions(spark, sf))
    path = tables.write_metric_files(per_fold, scratch_path(spark, "runs"))
    read = tables.read_metric_files(spark, f"{path}/fold=*/part-*")
    long = read.unpivot(["experiment", "file"], mt.METRICS, "metric", "value")
    summary = mt.fold_summary(long)
    return summary.withColumns({c: F.round(c, 6) for c in ("mean", "min", "max")})


_UNPIVOT = f"long AS (SELECT fold, metric, value FROM (UNPIVOT (SELECT fold, {', '.join(f'{m}::DOUBLE AS {m}' for m in mt.METRICS)} FROM mets) ON {', '.join(mt.METRICS)} INTO NAME metric VALUE value))"


def met_calibration_curve(spark, sf):
    curve = mt.calibration_curve(v.predictions(spark, sf))
    return curve.withColumns({c: F.round(c, 6) for c in ("mean_predicted_value", "fraction_of_positives")})


_CURVE_SQL = f"""WITH {v.PREDICTIONS}, b AS (SELECT y, p, len(list_filter(range(1, 10), lambda i: p > i * 0.1::DOUBLE))::INTEGER AS bin FROM preds)
SELECT bin, round(avg(p), 6) AS mean_predicted_value, round(avg(y), 6) AS fraction_of_positives, count(*) AS rows FROM b GROUP BY bin"""


def met_calibration_result(spark, sf):
    out = mt.calibration_result(v.predictions(spark, sf), "none")
    return out.withColumns({c: F.round(c, 6) for c in ("brier", "log_loss")})


_RESULT_SQL = f"""WITH {v.PREDICTIONS} SELECT 'none' AS method, round(avg((p - y) * (p - y)), 6) AS brier,
round(avg(-ln(CASE WHEN y = 1 THEN greatest(p, 2.220446049250313e-16) ELSE 1 - least(p, 1 - 2.220446049250313e-16) END)), 6) AS log_loss FROM preds"""


def prj_metric_format(spark, sf):
    """Prices as stored metrics: text, NaN and missing values become dashes."""
    events = v.table(spark, sf, "events")
    text = (
        F.when(F.col("event_type") == "error", F.lit("NaN"))
        .when(F.col("event_type") == "view", F.lit("n/a"))
        .otherwise((F.col("user_id") / 128.0).cast("string"))
    )
    metric = nb.clean_metric(text)
    return events.select("event_id", nb.format_percent(metric).alias("percent"), nb.format_score(metric).alias("score"))


_FORMAT_SQL = """WITH m AS (SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN user_id / 128.0::DOUBLE END AS m FROM events)
SELECT event_id, coalesce(printf('%.1f%%', m * 100), '—') AS percent, coalesce(printf('%.3f', m), '—') AS score FROM m"""


def met_run_table(spark, sf):
    """Runs written as config and metric files with a manifest, scanned and compared."""
    folder = scratch_path(spark, "experiments")
    per_fold = mt.classification_metrics(v.predictions(spark, sf))
    long = mt.long_metrics(per_fold)
    manifest = tables.segment_manifest(
        v.segments(spark, sf), _no_check(spark), "v1", "20240101T000000Z", {"of the": "target__of_the"}
    )
    tables.write_one_json(manifest, f"{folder}/data/segments_v1.json")
    for run, target in (("run_a", "target__of_the"), ("run_b", "target__balance_sheet")):
        config = [f"dataset_path: data/segments_{'v1' if run == 'run_a' else 'v9'}.parquet", f"target_column: {target}", "model:", "  type: x"]
        spark.createDataFrame([(line,) for line in config], "value string").coalesce(1).write.text(f"{folder}/{run}-config")
        kept = long.filter("fold < 3") if run == "run_a" else long
        row = mt.mean_over_folds(kept).groupBy().pivot("metric", mt.METRICS).agg(F.first("value"))
        tables.write_one_json(row, f"{folder}/{run}-metrics")
    configs = tables.read_run_configs(spark, f"{folder}/run_*-config/part-*")
    found = tables.read_metric_files(spark, f"{folder}/run_*-metrics/part-*")
    clean = {"experiment": F.regexp_replace("experiment", "-(config|metrics)$", "")}
    runs = profile.run_table(
        configs.withColumns(clean), found.withColumns(clean).drop("file"),
        tables.read_manifests(spark, f"{folder}/data/*.json/part-*"),
    )
    return profile.comparison_table(profile.runs_with_accuracy(runs))


def _no_check(spark):
    return spark.range(1).select(
        F.create_map(F.lit("non_empty_text"), F.lit(True)).alias("checks"), F.array().cast("array<string>").alias("notes")
    )


_RUNS_SQL = f"""WITH {_METRICS}, a AS (
  SELECT 'of the' AS phrase, 'run_a' AS experiment, 'v1' AS dataset_version, '20240101T000000Z' AS generated_at,
         (SELECT count(*)::VARCHAR FROM conversations) AS num_rows, avg(accuracy) AS acc, avg(average_precision) AS ap, avg(log_loss) AS ll, avg(brier) AS br FROM mets WHERE fold < 3
  UNION ALL SELECT 'balance sheet', 'run_b', '—', '—', '—', avg(accuracy), avg(average_precision), avg(log_loss), avg(brier) FROM mets)
SELECT phrase, experiment, dataset_version, generated_at, num_rows, printf('%.1f%%', acc * 100) AS accuracy,
       printf('%.1f%%', ap * 100) AS average_precision, printf('%.3f', ll) AS log_loss, printf('%.3f', br) AS brier FROM a"""


def _settings(**changes):
    return ex.Settings(
        **{
            "target": "quality", "row_id": "doc_id", "categorical": ["lang"], "max_features": 2000,
            "calibration": "isotonic", **changes,
        }
    )


def _trained(spark, sf, **changes):
    """Feature state and vectors of all labelled documents."""
    s = _settings(**changes)
    rows, counts = ex.prepare(_documents(spark, sf), s)
    return s, *ex.fit_features(rows, counts, s, whole=True)


def mdl_rolling_logistic(spark, sf):
    """Rolling folds, TF-IDF with language, balanced logistic regression: metrics per fold."""
    return ex.run_experiment(_documents(spark, sf), _settings(calibration="none")).fold_metrics


def mdl_importances(spark, sf):
    _, fitted, vectors = _trained(spark, sf)
    return md.feature_importances(md.fit_model(vectors), fitted.index)


def _calibrated(spark, sf, method):
    s, _, vectors = _trained(spark, sf, ngram_range=(1, 1))
    model = md.calibrate(vectors, s.model, method, s.cv)
    return model.predict(vectors).select(F.lit(0).alias("fold"), F.col("label").alias("y"), "p")


def cal_sigmoid_curve(spark, sf):
    return mt.calibration_curve(_calibrated(spark, sf, "sigmoid"))


def cal_isotonic_result(spark, sf):
    return mt.calibration_result(_calibrated(spark, sf, "isotonic"), "isotonic")


def mdl_boosting(spark, sf):
    """Importances of gradient boosting on a small vocabulary."""
    _, fitted, vectors = _trained(spark, sf, ngram_range=(1, 1), max_features=100)
    model = md.fit_model(vectors, "gradient_boosting", n_estimators=20)
    return md.feature_importances(model, fitted.index).filter("importance > 0")


def mdl_score_events(spark, sf):
    """A saved and loaded model scores all documents; segment scores become event scores."""
    s, fitted, vectors = _trained(spark, sf, ngram_range=(1, 1))
    folder = scratch_path(spark, "model")
    ex.save_model(md.calibrate(vectors, s.model, "none"), fitted, folder)
    model, loaded = ex.load_model(spark, folder)
    return rates.event_probability(ex.score_segments(_documents(spark, sf), loaded, model, s))


QUERIES = {
    "flt_labels": (flt_labels, "SELECT doc_id, quality::INTEGER AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"),
    "fea_tfidf": (fea_tfidf, _TFIDF_SQL),
    "fea_vocabulary": (fea_vocabulary, _VOCABULARY_SQL),
    "fea_one_hot": (fea_one_hot, _ONE_HOT_SQL),
    "fea_embeddings": (fea_embeddings, _EMBEDDING_SQL),
    "fea_scaled": (fea_scaled, _SCALED_SQL),
    "fea_vectors": (fea_vectors, _VECTORS_SQL),
    "win_date_positions": (win_date_positions, f"WITH {_POSITION} SELECT doc_id, event_date, position FROM pos"),
    "fld_rolling": (fld_rolling, _rolling_sql(3, 5)),
    "fld_rolling_minimum": (fld_rolling_minimum, _rolling_sql(5, 200)),
    "fld_leave_one_out": (fld_leave_one_out, f"WITH {_LOEO} SELECT * FROM folds"),
    "fld_held_out_rows": (fld_held_out_rows, f"WITH {_LOEO} SELECT doc_id, event_id, fold FROM docs JOIN folds USING (event_id)"),
    "fld_stratified": (fld_stratified, _STRATIFIED_SQL),
    "met_classification": (met_classification, f"WITH {_METRICS} SELECT fold, {_ROUNDED} FROM mets"),
    "met_mean_over_folds": (met_mean_over_folds, f"WITH {_METRICS}, {_UNPIVOT} SELECT metric, round(avg(value), 6) AS value FROM long GROUP BY metric"),
    "agg_fold_summary": (agg_fold_summary, f"WITH {_METRICS}, {_UNPIVOT} SELECT metric, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM long WHERE NOT isnan(value) GROUP BY metric"),
    "met_calibration_curve": (met_calibration_curve, _CURVE_SQL),
    "met_calibration_result": (met_calibration_result, _RESULT_SQL),
    "prj_metric_format": (prj_metric_format, _FORMAT_SQL),
    "met_run_table": (met_run_table, _RUNS_SQL),
    "mdl_rolling_logistic": (mdl_rolling_logistic, None),
    "mdl_importances": (mdl_importances, None),
    "mdl_boosting": (mdl_boosting, None),
    "mdl_score_events": (mdl_score_events, None),
    "cal_sigmoid_curve": (cal_sigmoid_curve, None),
    "cal_isotonic_result": (cal_isotonic_result, None),
}
