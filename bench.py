"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed with its whole result written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from holdfast.catalog import load  # noqa: E402
from holdfast.session import local_session  # noqa: E402

HEADLINE = (
    "dropna_dedup",
    "validate_rows",
    "features_serving",
    "split_stratified",
    "group_medians",
    "boxplot_stats",
    "segment_clv",
    "revenue_at_risk",
    "cohort_heatmap",
    "survival_curve",
    "vip_list",
    "score_accounts",
    "what_if_rebuild",
    "similar_accounts",
    "woe_table",
    "yeo_johnson_grid",
    "metrics",
    "roc_points",
    "threshold_sweep",
    "kmeans_assign",
    "segment_drivers",
    "customer_top_drivers",
    "tree_attributions_small",
    "audit_stats",
    "stream_user_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "holdfast-bench")
    queries, _ = load()
    seconds = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
            spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
