"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to the end (every column of every row is produced, into Spark's
``noop`` sink) once to warm up and then BENCH_RUNS times; the best run counts.
The stream is timed once, from its first file to its last commit.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tidemark.operators import apply
from tidemark.plans import domain
from tidemark.plans.catalog import QUERIES
from tidemark.plans.mirror import Mirror
from tidemark.session import session, shared_dir
from tidemark.sources import feed as feeds
from tidemark.streaming.follow import follow

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = (
    "q1_orders_by_region",
    "q5_business_question",
    "q6_business_question_counts",
    "q7_top_products",
    "q8_key_counts",
    "q10_tolerant_totals",
    "q11_snapshot_history",
    "q14_key_versions",
    "s8_type_check",
    "s10_keyed_apply",
    "m5_write_propagation",
    "m7_latency_summary",
    "m9_event_ordering",
    "m11_secret_redaction",
    "w1_upsert_documents",
    "w4_reconcile_to_baseline",
)


def _as_of(version: int):
    return lambda spark, sf_dir: apply.state_as_of(domain.change_log(spark, sf_dir), version)


def _run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _stream(spark) -> dict[str, float]:
    """The feed's files through the streaming writer, then reads of the table it left."""
    root = shared_dir(spark, "bench")
    rows = domain.feed(spark, SF_DIR).select(*[F.col(f.name).cast(f.dataType) for f in feeds.FEED_SCHEMA])
    rows.repartitionByRange(8, "seq").write.mode("overwrite").parquet(f"{root}/feed")
    mirror = Mirror(spark, f"{root}/mirror", buckets=8)
    start = time.perf_counter()
    follow(mirror, feeds.stream_feed(spark, f"{root}/feed", max_files=4), f"{root}/checkpoint").awaitTermination()
    took = {"stream_apply": time.perf_counter() - start}
    mirror.write_base()
    for name, query in {
        "table_state": lambda *_: mirror.state(),
        "table_lookup": lambda *_: mirror.lookup("8"),
        "table_history": lambda *_: mirror.snapshots(),
    }.items():
        _run(query, spark)
        took[name] = min(_run(query, spark) for _ in range(RUNS))
    return took


def main() -> int:
    spark = session(
        f"local[{CPUS}]",
        app="bench",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = {name: QUERIES[name] for name in HEADLINE}
    queries |= {f"q12_as_of_{v}": _as_of(v) for v in (1, 15, 30)}
    times: dict[str, float] = {}
    for name, query in queries.items():
        _run(query, spark)
        times[name] = min(_run(query, spark) for _ in range(RUNS))
    times |= _stream(spark)
    events = domain.table(spark, SF_DIR, "events").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(took, 3) for name, took in times.items()},
                "stream_events_per_sec": round(events / times["stream_apply"]),
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "runs": RUNS,
            }
        )
    )
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
