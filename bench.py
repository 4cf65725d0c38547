"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the ``noop`` sink (no driver collect).  The session is warmed
up once on a tiny query so the numbers are query times, not JVM / Python-worker start-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evalgrid.plans import fixtures, registry  # noqa: E402
from evalgrid.session import get_spark  # noqa: E402

HEADLINE = [
    "m2_accuracy",       # closed tasks: extract letter / boolean, match, accuracy per cell
    "m3_tuple_f1",       # literal-tuple parser (Arrow) + set F1
    "m4_triple_f1",      # regex tuple parser + positional F1
    "m5_bleu",           # BLEU-4 over whole documents
    "m8_rougeL",         # ROUGE-L (bit-parallel LCS) over whole documents
    "m11_summary",       # the whole evaluation grid in one job
    "rp5_latest_run",    # latest run per cell of the append-only log
    "p3_prompt",         # prompt assembly for every item x shot level
    "s6_detail",         # detail JSON sink round trip
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark()
    registry.QUERIES["s9_model_safe"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # making the inputs from the test tables is part of every query's time; here it is alone, for comparison
    inputs = {}
    for name, make in (("items", fixtures.all_items), ("responses", fixtures.all_responses)):
        t0 = time.time()
        make(spark, sf_dir).write.format("noop").mode("overwrite").save()
        inputs[name] = round(time.time() - t0, 3)
    times = {}
    for name in names:
        t0 = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "inputs": inputs,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
    }))


if __name__ == "__main__":
    main()
