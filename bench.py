"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below, `all` for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowlens import plans  # noqa: E402
from flowlens.session import build_session  # noqa: E402

HEADLINE = (
    "traffic_by_app flow_sessions count_window flow_sequence ipt_lag packet_stats order_volumes "
    "flow_histograms feat_ratios feat_rates feat_time features_tabular features_seq_tabular "
    "seq_tensor seq_norm_stats tab_norm_stats zscore label_encode version_index class_weights "
    "class_report macro_f1 log_loss top10_support service_rollup value_counts running_accuracy "
    "sample_exact stratified_split time_split per_class_topn etl_csv_parquet manifest "
    "model_dt model_rf score_batch st_count_window st_sessions"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = plans.queries()
    names = list(registered) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    # One untimed query starts the executors and loads the classes every query needs.
    registered["row_count"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
