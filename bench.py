"""Bench: run the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (no driver collect).
Before timing, every headline query runs once on the smallest scale factor
(``BENCH_WARMUP_DIR``, default: the sibling ``sf0.001`` folder when present)
so JIT compilation and Python worker start-up are not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "user_feed",             # flagship, exact path: D2 -> F4 -> F3 -> F1
    "user_feed_bounded",     # flagship, bounded path (no repeats)
    "fanout_visible",        # D2
    "first_seen_dedup",      # F3 on attempts
    "anchored_ttl_epochs",   # F4
    "feed_topic_filter",     # C1
    "rate_1m",               # H1
    "hist_quantile",         # H4
    "pipeline_overview",     # H9
    "classify_by_prototype",  # I9
    "micro_batches",         # F9
    "toggle_topic",          # F10
    "stream_dedup_ttl",      # I3, four micro-batches with state
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from feedspark.session import get_session
    from feedspark.catalog import load_all

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    keys = [k for k in HEADLINE if k in reg]
    warm = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if os.path.isdir(warm):
        for k in keys:
            reg[k].build(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t0 = time.time()
        reg[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    # throughput of the flagship in the units of the published figures
    # (articles in, feed rows out); counted outside the timed part
    amp = reg["fanout_amplification"].build(spark, sf_dir).first()
    feed_rows = reg["user_feed"].build(spark, sf_dir).count()
    sec = times.get("user_feed") or float("nan")
    throughput = {
        "articles": amp["messages"],
        "visible_deliveries": amp["deliveries"],
        "user_feed_articles_per_sec": round(amp["messages"] / sec, 1),
        "feed_rows": feed_rows,
        "user_feed_rows_per_sec": round(feed_rows / sec, 1),
    }
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "throughput": throughput,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
