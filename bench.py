"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is
computed completely (all columns, no sink). Tables shared between queries are
dropped before each one, so a time covers everything behind the query except the
parsed log, which is built and timed once as ``parse_log``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import tables  # noqa: E402
from catalog.spark_queries import QUERIES  # noqa: E402
from logwarden.session import local_session  # noqa: E402

HEADLINE = [
    "parse_lines", "message_templates", "impossible_travel", "rule_brute_force", "rule_enumeration", "rules_fired",
    "flagship", "incident_assignment", "incidents", "incident_techniques", "incident_prompts", "incident_records",
    "triage_top", "quantile_threshold", "template_vectors", "forest_scores", "scored_events", "scored_incidents",
    "embedding_outliers", "corpus_lines", "camouflage_combo",
]
# the run matrix copies the whole log 45 times; on request only
MATRIX = ["pooled_rates", "robustness_pooled", "detector_comparison", "contamination_sweep"]


def timed(build) -> float:
    begin = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = HEADLINE + (MATRIX if os.environ.get("BENCH_MATRIX") else [])
    spark = local_session(cpus, "bench")
    kept = {"lines", "parsed"}
    times = {"parse_log": timed(lambda: tables.parsed(spark, sf_dir))}
    for name in names:
        if name not in MATRIX:
            for key in [k for k in tables._memo if k[0] not in kept]:
                del tables._memo[key]
        times[name] = timed(lambda: QUERIES[name](spark, sf_dir))
        print(f"{name} {times[name]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": total, "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
