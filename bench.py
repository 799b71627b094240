"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the task slots. ``BENCH_QUERIES``
may name other queries, separated by commas, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from orderloom.plans.catalog import full_registry  # noqa: E402
from orderloom.session import build_session  # noqa: E402

HEADLINE = (
    "late_delivery_rate", "category_revenue", "seller_performance", "product_ranking", "customer_geography",
    "payments_to_order", "geo_representative", "order_features", "describe_percentiles", "seller_pareto",
    "category_metrics", "complaint_matrix", "spearman_review", "mannwhitney_freight", "prioritization",
    "lexicon_sentiment", "aspect_tagging", "signals_by_type", "tfidf", "ctfidf_terms", "nmf_topics",
    "intent_classify", "rate_limit_flags", "table_fingerprint", "nlp_reviews", "model_sentiment", "stream_rate_limit",
    "logit_negative_review",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = build_session(
        "orderloom-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registry = full_registry().queries
    names = tuple(registry) if chosen == "all" else tuple(n for n in chosen.split(",") if n) or HEADLINE
    # One untimed query starts the JVM's compilers and the Python workers.
    registry["late_delivery_rate"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
