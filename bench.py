"""Wall time of the headline queries; prints one JSON line.

The binding of the facts is planned once per table folder and reused, so planning it is
part of the warm-up only.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up (default 3; the median counts)
BENCH_QUERIES  comma-separated names (default: the list below)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tracewell.plans import registry
from tracewell.session import build_session

HEADLINE = [
    "lookup_page",              # filter, page
    "with_dimensions",          # dimension joins
    "include_targets",          # target filter
    "count_by_type",
    "user_last_n",
    "has_removed",              # bulk existence
    "page_visible",
    "newest_per_position",
    "plan_rollback",
    "plan_with_explosions",
    "inverse_mutations",
    "apply_mutations",
    "effective_flags",
    "undo_plan",
    "explode_affected",
    "pack_affected",
    "attribute_last_hit",
    "attribute_prime",
    "peek_fire_causer",
    "attribute_fire",
    "attribute_fluid",
    "attribute_entity",
    "gate",
    "gate_blacklist",
    "coalesce_entity_changes",
    "throttle_spawns",
    "diff_containers",
    "diff_hopper_samples",
    "classify_block_changes",
    "export_jsonl",
    "purge",
    "append_actions",           # stores all events, twice offered
    "ingest_stream",            # gate and store, as a stream
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registry.load_all()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            # The noop sink computes every row and column without fetching them.
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {
        f"{name}_events_per_sec": round(events / seconds[name])
        for name in ("gate", "append_actions", "ingest_stream") if name in seconds
    }
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf,
                "events": events,
                **rates,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
