"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Inputs derived from ``events`` are written once before the clock starts, so a query's
time is that of its operator reading a stored log and writing all result rows to a
sink that discards them.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from checks import inputs as I
from checks.compare import local_session
from partlog.functions import codec
from partlog.operators import audit, completeness, delivery, replay, reports, retention, routing, spacing
from partlog.plans.scratch import scratch_path
from partlog.sources import log
from partlog.streaming import jobs


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))

    def stored(df, name):
        # Several files, as a log of any size has.
        return spark.read.parquet(I.stored(df.repartition(16), name))

    published = stored(I.published(spark, sf_dir), "published")
    delivered = stored(I.delivered(spark, sf_dir), "delivered")
    raw = stored(I.raw_messages(spark, sf_dir), "raw")
    stream_log = stored(I.stream_log(spark, sf_dir), "stream_log")
    deliveries = stored(I.deliveries(spark, sf_dir), "deliveries")
    samples = stored(I.lag_samples(spark, sf_dir), "samples")
    expected = stored(I.expected(spark, sf_dir), "expected")
    messages = stored(I.messages(spark, sf_dir), "messages")
    config = I.config_log(spark)
    log3 = scratch_path(spark, "log")
    log.write_log(replay.rekey(messages, 3), log3)
    latencies = deliveries.select(
        "stream",
        (F.unix_micros(F.col("attempt_ts").cast("timestamp")) % 86_400_000_000).alias("latency_us"),
    )
    by_key = published.select("stream_seq", F.col("key").alias("id"), "ts")

    audited = delivered.select("key", "run", "partition", "arrival", "sequence")
    folder = delivered.inputFiles()[0].rsplit("/", 1)[0]
    path = lambda name: scratch_path(spark, name)

    def audit_stream():
        stream = log.read_log_stream(spark, folder, max_files=4, schema=audited.schema)
        jobs.audit_batches(stream, path("audit"), path("state"), path("ckpt")).awaitTermination()

    def audit_batches():
        stream = log.read_log_stream(spark, folder, schema=audited.schema)
        jobs.audit_batches(stream, path("audit"), path("state"), path("ckpt")).awaitTermination()

    queries = {
        "read_log": lambda: consume(log.read_log(spark, log3, partitions=[1])),
        "decode_messages": lambda: consume(codec.decode_messages(raw)[0]),
        "encode_messages": lambda: consume(codec.encode_messages(messages)),
        "route_messages": lambda: consume(routing.route_messages(published, config, "LEDGER")),
        "ordering_audit": lambda: consume(audit.ordering_audit(delivered)),
        "ordering_summary": lambda: consume(
            audit.ordering_summary(audit.ordering_audit(delivered), by=("partition",))
        ),
        "account_sequences": lambda: consume(audit.account_sequences(delivered)),
        "position_check": lambda: consume(audit.position_check(delivered)),
        "summarize_sequences": lambda: consume(audit.summarize_sequences(delivered)),
        "completeness_report": lambda: consume(completeness.completeness_report(expected, delivered)),
        "missing_messages": lambda: consume(completeness.missing_messages(expected, delivered)),
        "consumer_info": lambda: consume(delivery.consumer_info(stream_log, deliveries)),
        "latency_percentiles": lambda: consume(reports.latency_percentiles(latencies, by=("stream",))),
        "lag_windows": lambda: consume(reports.lag_windows(samples)),
        "retain_newest": lambda: consume(retention.retain_newest(stream_log, "20 days", 5000)),
        "dedup_window": lambda: consume(spacing.dedup_window(by_key, window="12 hours")),
        "replay_plan": lambda: consume(replay.replay_plan(published, config, "LEDGER")),
        "replay_buffer": lambda: consume(replay.replay_buffer(raw, 5, "LEDGER")[0]),
        "repartition_log": lambda: replay.repartition_log(
            spark, log3, scratch_path(spark, "rewritten"), 5, old_count=3
        ),
        "audit_stream": audit_stream,
        "audit_batches": audit_batches,
    }
    seconds = {}
    for name, run in queries.items():
        run()  # warm-up
        times = []
        for _ in range(repeats):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 4)

    rows = delivered.count()
    result = {
        "metric": "total seconds of headline queries",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "rows": rows,
        "rows_per_second": {n: int(rows / s) for n, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
