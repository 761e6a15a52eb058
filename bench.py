"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import buslens.plans.more_queries  # noqa: E402, F401  registers its queries
from buslens.plans.event_frames import event_catalogue  # noqa: E402
from buslens.plans.queries import REGISTRY  # noqa: E402
from buslens.session import local_session  # noqa: E402

HEADLINE = [
    "frames_normalised", "filter_ids", "signals_long", "frames_parsed", "frames_wide",
    "frame_numbers", "count_limit", "duration_limit", "duration_filter_count", "capture_stats",
    "window_stats_10s", "bucket_stats", "signal_summary", "signal_corr", "signal_drift",
    "quarantine", "gaps", "duplicates", "quality", "rules",
    "sink_csv", "sink_ndjson", "sink_text", "sink_parquet", "stream_signals", "stream_stats",
    "frame_lines", "fanout_count", "store_tables", "store_bulk_import", "stream_capture", "signals_long_payload",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    # One pass over the first query starts the executors and loads the classes.
    REGISTRY[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # The catalogue is prepared once per session, as a capture run would do.
    start = time.perf_counter()
    event_catalogue(spark)
    seconds = {"catalogue_load": round(time.perf_counter() - start, 3)}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": scale,
    }))


if __name__ == "__main__":
    main()
