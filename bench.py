"""Timings of the headline queries, one JSON line.

Each query runs once to warm up and is then timed in full: every row is
produced and discarded by the ``noop`` sink, so nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from vellum import bindings
from vellum.session import build_session

HEADLINE = [
    "Q-S4_search", "T01_top_results", "Q-S5_suggestions", "Q-S1_search_documents", "Q-S4_search_prose", "W01_winner", "W02_history",
    "W06_diagnostic_identity", "J01_aliases_for", "J03_link_recipes", "J10_link_modifiers", "J15_item_recipes", "J24_effect_backlinks",
    "A11_backlink_totals", "A17_level_stats", "A04_item_categories", "R01_item_comparison", "I01_inheritance", "I09_combined_requirements",
    "S03_parse_xml", "N17_recipes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    timings = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            bindings.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - started, 3)
    documents = bindings.QUERIES["Q-S1_search_documents"](spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir),
        "search_documents": documents,
        "search_ms_per_query": round(1000 * timings["Q-S4_search"] / 12, 3) if "Q-S4_search" in timings else None,
    }))


if __name__ == "__main__":
    main()
