"""Times the headline queries. Prints one JSON line.

Every query is run twice into a sink that reads all rows; the second time counts, so
that class loading and code generation are left out (`cold` holds the first times)."""

from __future__ import annotations

import json
import os
import time

from macrospark.plans.registry import CATALOGUE
from macrospark.session import local_session

HEADLINE = [
    "flagship_latest_features", "src5_latest", "src6_vintages", "jon1_pivot", "agg1_monthly_mean", "agg3_profile",
    "agg5_column_median", "agg7_pair_correlations", "agg14_forecast_metrics", "agg18_acf_features",
    "win3_rolling_previous", "win3_rolling_long", "win7_ema", "win11_forward_fill_long", "win14_upsample_monthly",
    "win16_fill_cascade", "win18_expanding_acf", "dq8_malformed", "tso1_decompose", "tso2_decompose_loess",
    "tso6_anomalies", "tso8_box_cox_lambda", "tso9_differencing_order", "tso10_trend_forecast", "tso12_auto_forecast",
    "tso13_seasonal_regression", "tso15_vector_forecast", "tso20_leak_free_features", "tso21_regression_rows",
    "mlo6_stratified_folds", "mlo2_boosted_trees",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            CATALOGUE[name].run(spark, sf_dir).write.mode("overwrite").format("noop").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
