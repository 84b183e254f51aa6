"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf", "rows"}.  Each query is run to completion with the ``noop`` sink (all
rows produced, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harrow.plans.registered import QUERIES  # noqa: E402
from harrow.session import build_session  # noqa: E402

HEADLINE = [
    "run_summary", "dedupe_two_key", "incremental_two_batch", "tier_filter", "classify",
    "relevance_gate", "salary_clean", "salary_format", "fingerprint", "first_wins",
    "cap_per_source", "anti_store", "page_cards", "page_section_fill", "page_links",
    "strip_html", "phrase_semi", "backfill_classes", "repair_dates", "recover_company",
    "status_funnel", "source_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    spark.conf.set("spark.harrow.partitions", cpus)  # the tables are single files of one split each
    # Warm the JVM (class loading, codegen caches) on the smallest table.
    QUERIES["star_lookup"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
