"""Time headline queries; prints one JSON line.

Every query is run to the end (all rows, all columns) into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "count_unseen_by_folder",
    "count_many",
    "filter_every_term",
    "rollup_totals",
    "chunks",
    "size_batches",
    "delivery_careful",
    "normalised_hash_length",
    "archive_names",
    "archive_reconcile",
    "mark_by_key",
    "delete_auto",
    "gmail_trash",
    "backup_expire",
]

#: Queries that handle unread messages only; rates count what is handled.
UNREAD = {"count_unseen_by_folder", "chunks", "size_batches", "delivery_careful"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks import all_queries, mailbox

    queries = all_queries()
    messages = mailbox.messages(spark, sf_dir)  # counting also warms the session
    every, unread = messages.count(), messages.filter("not seen").count()
    rows = {name: unread if name in UNREAD else every for name in HEADLINE}
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total time of headline mailbox queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "messages_per_sec": {n: round(rows[n] / s) for n, s in seconds.items()},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
