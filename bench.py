"""Headline timings: prints one JSON line.

Landing the catalogue, features and enriched tables is timed on its own; the queries
then read the landed tables, as the reports of a stored catalogue do. Each query has
one warm-up run and is then timed as the median of its repeats, rows fully produced.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfwise.plans.queries import REGISTRY  # noqa: E402
from shelfwise.session import local_session  # noqa: E402
from shelfwise.sources import landing, views  # noqa: E402
from shelfwise.sources.offers import products  # noqa: E402

HEADLINE = (
    "s0_products", "n5_html_text", "n14_card_dedupe", "n18_n20_clean", "n23_normalised", "f1_f4_derived",
    "f5_label_codes", "f6_imputed", "f9_features", "f12_fallback_rank_label", "c3_silhouette_sample", "c4_cluster_profile",
    "c8_pca", "l1_target", "l7_split", "a2_order_baskets", "a8_rules", "t2_composite_score", "t3_rank_any",
    "t5_top_k", "t6_container_score", "d1_filters", "d4_kpis", "d8_category_volume", "d9_score_histogram",
    "d10_price_histogram", "d14_sample", "d17_discount_spread", "d19_search", "m1_context",
    "m5_segment_profiles", "m9_questions", "m10_memory", "m12_prompts", "u1_log_stats",
    "u3_permission_check", "u5_policy_summary",
)


def produce(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    # A place of its own, so that landing is timed and no earlier run's tables are read.
    landing.ROOT = f"shelfwise/bench-{uuid.uuid4().hex}"
    times: dict[str, float] = {}
    for name, land in (
        ("land_products", products), ("land_features", views.features), ("land_enriched", views.enriched),
    ):
        start = time.perf_counter()
        land(spark, sf_dir)
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        run = REGISTRY[name]
        produce(run(spark, sf_dir))
        taken = []
        for _ in range(repeats):
            start = time.perf_counter()
            produce(run(spark, sf_dir))
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
