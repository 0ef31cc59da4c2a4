"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3, the median counts), BENCH_QUERIES (comma list, or ``all``).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from canvasser.plans import catalogue  # noqa: E402
from canvasser.session import local_session  # noqa: E402

HEADLINE = [
    "engagement_score",
    "summary_metrics",
    "engagement_funnel",
    "top_engaged_schools",
    "counties_at_risk",
    "county_cards",
    "program_coverage_by_county",
    "upcoming_followups",
    "schools_needing_attention",
    "schools_never_at_event",
    "global_search",
    "load_contacts",
    "link_scraped_contacts",
    "merge_upsert",
    "upsert_staff_scraped",
    "merge_school_list",
    "dedupe_facilities",
    "preferred_website",
    "apply_changes",
    "validate_contacts",
    "extract_signals",
    "assign_fields",
    "fuzzy_best_match",
    "streaming_school_activity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries = catalogue.callables()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="bench")
    queries["load_schools"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        seen = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen), 4)
        print(f"{name:34s} {times[name]:8.3f}s", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
