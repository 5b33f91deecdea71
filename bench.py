"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tablewright.catalog import QUERIES
from tablewright.session import build_session

HEADLINE = [
    "a12_scan_parquet",
    "b01_request_count",
    "b09_conditional_log",
    "b11_filter_dimension",
    "c02_join_null_safe",
    "c03_join_null_safe_range",
    "c07_join_star_three",
    "c08_join_left_anti",
    "c10_join_self_pairs",
    "d01_agg_sums_sorted",
    "d05_rate_table",
    "d06_word_count",
    "d08_cooccurrence_topk",
    "d09_collect_group",
    "g01_tokenize_clean",
    "j04_stream_sliding_counts",
    "j06_stream_active_users",
    "k01_tfidf",
    "k12_string_indexer",
    "k17_standard_scaler",
    "l08_naive_bayes",
    "m01_linear_regression",
    "n02_table_summary",
    "n03_correlation_spearman",
    "n08_stratified_sample_exact",
    "n14_eval_auc",
    "p07_fp_growth",
    "q02_apply_plan",
]


def run(spark, folder: str, key: str) -> float:
    """Seconds to compute every row of a query and drop it."""
    start = time.perf_counter()
    QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus) if cpus.isdigit() else 8,
        {"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    cold, warm = {}, {}
    for key in keys:
        cold[key] = round(run(spark, folder, key), 3)
        warm[key] = round(run(spark, folder, key), 3)
    spark.stop()
    result = {
        "metric": "headline queries, warm wall time",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
