"""Time the headline queries on the bench tables and print one JSON line.

Each query is built, planned and run to a no-op sink.  One small warm-up query
starts the session; the queries themselves are timed on their first run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from listmill.session import build_session  # noqa: E402

HEADLINE = [
    "feed_remotive", "clean_ws", "html_to_text", "page_listing", "needs_render", "extract_anchors", "job_links",
    "matches_keywords", "is_contract", "robots_allowed", "extract_pay", "feed_listing", "sections", "task_type",
    "follow_links", "upsert_listings", "apply_reviews", "dedup_cross", "first_distinct", "search_feeds", "board_walk",
    "board_scrape", "queue_positions", "status_counts", "run_outcome", "change_only", "progress_upsert",
    "review_events_stream", "change_only_stream", "ingest_stream",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")

    from checks.queries import QUERIES

    QUERIES["page_scan"](spark, sf).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "listmill_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
