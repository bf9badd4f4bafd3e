"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query.

Each query is built, planned and run to the end (every row of the result is produced); the time is the whole of it.
"""

from __future__ import annotations

import json
import os
import re
import time

from lapel.plans.registry import REGISTRY
from lapel.session import local_session

HEADLINE = [
    "q01_revenue_ytd",
    "q02_revenue_by_store_12m",
    "q03_clients_by_tier",
    "q04_top_categories",
    "q05_vip_by_city",
    "q06_top_clients",
    "q07_inactive_high_value",
    "q08_advisor_revenue",
    "q09_aov_by_category",
    "q10_city_compare",
    "q11a_category_buyers",
    "q11b_buyers_now_inactive",
    "q12_advisors_having",
    "q13_discount_rate",
    "q14_monthly_trend",
    "q15_revenue_by_brand",
    "q16_advisor_at_risk_book",
    "q17_bought_x_never_y",
    "q18_return_rate",
    "get_revenue_by_period",
    "get_top_clients_all_stores",
    "rank_by_revenue",
    "segment_clients",
    "client_profile",
    "metric_growth_mom_series",
    "metric_purchase_frequency",
    "log_top_questions",
    "log_runtime",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(key: str) -> float:
        start = time.perf_counter()
        REGISTRY[key](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds("q02_revenue_by_store_12m")  # start-up of the JVM and of the first scan is not a query's time
    times = {key: round(min(seconds(key) for _ in range(2)), 3) for key in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", folder)
    line = {
        "metric": "headline queries, total of the better of two runs each",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
