"""Time the headline queries once each, warm, and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from reviewlab.plans.catalog import QUERIES
from reviewlab.session import get_session

HEADLINES = (
    "clean_reviews",
    "rare_class_drop",
    "class_counts",
    "strat_split_30",
    "mix_fallback_90_10",
    "sample_weights",
    "knn_neighbors",
    "own_train_knn",
    "retrain_mix_knn",
    "transfer_knn",
    "classification_report",
    "roc_auc",
    "welch_t",
    "token_cap",
    "embed_hashed",
    "embed_cached_lookup",
    "fit_logreg",
    "fit_dt",
    "fit_svm",
    "transfer_logreg",
    "embed_hashed_idf",
    "fit_densenet",
    "fit_densenet_early_stopping",
    "run_metrics",
    "report_lines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "reviewlab-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["own_train_knn"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "reviewlab headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
