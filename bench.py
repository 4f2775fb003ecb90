"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.operators import ml  # noqa: E402
from barloom.plans import catalog, portfolio  # noqa: E402
from barloom.session import build_session  # noqa: E402

HEADLINE = ("bars_canonical", "triple_barrier_labels", "label_distribution", "zigzag_state", "market_regime_features", "stock_features", "gmma_and_ema_distances", "daily_top_fraction", "average_uniqueness", "classification_metrics", "market_breadth_daily", "adv20", "portfolio_integrity")


def model_fit(spark, sf: str) -> float:
    """Seconds to fit boosted trees on the first fold's training rows, which are at hand."""
    members = portfolio._model_members(spark, sf).filter("fold_id = 1").cache()
    members.count()
    start = time.time()
    ml.fit_predict_fold(members, 1, "gbt", portfolio._NUMERIC, portfolio._CATEGORICAL)[0].agg({"p": "max"}).collect()
    members.unpersist()
    return round(time.time() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(max(8, cpus)), spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    took["gbt_fit"] = model_fit(spark, sf)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
