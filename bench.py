"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and once timed; its rows go to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumenbar.catalog.queries import QUERIES  # noqa: E402
from lumenbar.session import build_session  # noqa: E402

HEADLINE = [
    "bars_ohlcv",
    "feature_table",
    "nav_feature_table",
    "intraday_indicators",
    "forward_labels_1y",
    "winsorize_features",
    "chrono_split",
    "signals_scored",
    "opportunities",
    "growth_asof",
    "classification_metrics",
    "backtest_stats",
    "threshold_sweep",
    "drift_summary",
    "upsert_replace",
    "change_log",
    "reconcile_keys",
    "quality_profile",
    "audit_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        extra={
            "spark.sql.shuffle.partitions": cpus,
            # the bars are a few MB: without this AQE would run the windows in one task
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
