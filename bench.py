"""Headline timings: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import registry
from phrasecast.session import build_session

HEADLINE = [
    "txt_clean_documents", "seg_speaker_turns", "seg_speaker_documents", "seg_windows_overlapping", "mat_labels",
    "mat_counts", "jn_segments_inventory", "flow_labelled_segments", "agg_rate_intervals", "agg_hit_matrix",
    "win_cumulative_share", "agg_first_copies", "agg_news_features", "agg_provenance_json", "agg_digest", "jn_news",
    "flow_news_features", "fea_tfidf", "fea_vectors", "fld_rolling", "fld_leave_one_out", "met_classification",
    "met_calibration_curve", "mdl_importances", "agg_candles", "jn_market_edge", "jn_edge_report", "prj_inventory",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "phrasecast-bench", f"local[{cpus}]", cpus,
        {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.ALL["agg_event_flags"][0](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.ALL[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf).name,
    }))


if __name__ == "__main__":
    main()
