"""Restarts, repeated batches, time-outs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from partlog.operators import audit, replay, reports, spacing
from partlog.plans import ordered, state_table
from partlog.plans.scratch import scratch_path
from partlog.sources import log
from partlog.streaming import jobs


def test_replay_after_a_failed_batch(spark, small, monkeypatch):
    raw = spark.read.parquet(I.stored(I.raw_messages(spark, small), "raw"))
    source = scratch_path(spark, "buffer")
    raw.repartitionByRange(3, "stream_seq").write.parquet(source)
    out, dead, ckpt = (scratch_path(spark, n) for n in ("out", "dead", "ckpt"))
    start = lambda: jobs.replay_stream(
        log.read_log_stream(spark, source, max_files=1, schema=raw.schema), out, dead, 5, "S", ckpt, 1
    )

    put = jobs.put_batch

    def fail_after_write(df, path, batch_id, by=None):
        put(df, path, batch_id, by)
        if path == out and batch_id == 1:
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(jobs, "put_batch", fail_after_write)
    with pytest.raises(Exception):
        start().awaitTermination()
    monkeypatch.setattr(jobs, "put_batch", put)
    start().awaitTermination()

    got = spark.read.schema(jobs.REPLAYED).parquet(out)
    want, bad = replay.replay_buffer(raw, 5, "S")
    columns = want.columns
    assert got.count() == want.count()
    assert got.select(*columns).exceptAll(want).count() == 0
    assert jobs.read_batches(spark, dead).count() == bad.count()

    # Replaying the same buffer again adds nothing.
    redo, rejected = replay.replay_buffer(raw, 5, "S", got)
    assert redo.count() == 0 and rejected.count() == bad.count()


def test_audit_of_a_repeated_batch(spark, monkeypatch):
    """A hot key over two micro-batches, the second of which fails once after its write."""
    source, out, state, ckpt = (scratch_path(spark, n) for n in ("src", "out", "state", "ckpt"))
    schema = "run int, partition int, key string, arrival bigint, sequence bigint"
    rows = [(1, 0, "hot" if i % 3 else f"k{i % 5}", i, i * 7 % 50) for i in range(400)]
    start = lambda: jobs.audit_batches(
        log.read_log_stream(spark, source, schema=schema), out, state, ckpt, span=16
    )
    write = lambda part: spark.createDataFrame(part, schema).write.mode("append").parquet(source)
    write(rows[:250])
    start().awaitTermination()
    write(rows[250:])
    put = jobs.put_batch

    def fail_after_write(df, path, batch_id, by=None):
        put(df, path, batch_id, by)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(jobs, "put_batch", fail_after_write)
    with pytest.raises(Exception):
        start().awaitTermination()
    monkeypatch.setattr(jobs, "put_batch", put)
    start().awaitTermination()
    want = audit.ordering_audit(spark.createDataFrame(rows, schema))
    got = jobs.read_batches(spark, out).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_config_change_without_restart(spark):
    source, config, out, bad, ckpt = (scratch_path(spark, n) for n in ("src", "config", "out", "bad", "ckpt"))
    schema = "key string, ts timestamp"
    rows = lambda t: spark.createDataFrame([("acct-4", t)], "key string, t bigint").select(
        "key", F.timestamp_seconds("t").alias("ts")
    )
    setting = lambda rev, t, mode, n: spark.createDataFrame(
        [(rev, t, mode, n)], "revision int, t bigint, mode string, partition_count int"
    ).withColumn("effective_ts", F.timestamp_seconds("t"))
    setting(1, 5, "direct", 3).write.mode("append").parquet(config)
    rows(10).unionByName(rows(2)).write.mode("append").parquet(source)
    q = jobs.route_stream(
        log.read_log_stream(spark, source, schema=schema),
        lambda s: s.read.parquet(config),
        "S",
        out,
        bad,
        ckpt,
        {"processingTime": "0 seconds"},
    )
    try:
        q.processAllAvailable()
        setting(2, 20, "buffer", 3).write.mode("append").parquet(config)
        rows(30).write.mode("append").parquet(source)
        q.processAllAvailable()
    finally:
        q.stop()
    got = jobs.read_batches(spark, out).orderBy("ts").collect()
    assert [r.subject for r in got] == ["S.01", "S_BUFFER"]
    assert [r.reject_reason for r in jobs.read_batches(spark, bad).collect()] == ["no configuration"]


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_dedup_stream_does_not_depend_on_batches(spark, batches):
    rnd = random.Random(4)
    rows = sorted((rnd.randrange(4_000), f"k{rnd.randrange(4)}") for _ in range(300))
    rows = [(id if n % 50 else None, t, n) for n, (t, id) in enumerate(rows)]
    schema = "id string, t bigint, stream_seq bigint"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
    source, out, state, ckpt = (scratch_path(spark, n) for n in ("src", "out", "state", "ckpt"))
    for k in range(batches):
        part = df.where((F.col("stream_seq") * batches / len(rows)).cast("int") == k)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = log.read_log_stream(spark, source, schema=df.schema)
        jobs.dedup_stream(stream, out, state, ckpt, window="2 minutes").awaitTermination()
    got = jobs.read_batches(spark, out)
    want = spacing.dedup_window(df, window="2 minutes")
    assert sorted(r.stream_seq for r in got.collect()) == sorted(r.stream_seq for r in want.collect())


def test_state_expires(spark):
    """Accounts idle for ten seconds by a clock that the test sets."""
    source, out, state, ckpt = (scratch_path(spark, n) for n in ("src", "out", "state", "ckpt"))
    schema = "key string, arrival bigint, sequence bigint"

    def once(second, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = log.read_log_stream(spark, source, schema=schema)
        clock = lambda: F.lit(second * 1_000_000)
        jobs.account_stream(stream, out, state, ckpt, "10 seconds", clock=clock).awaitTermination()

    once(0, [("a", 2, 7), ("a", 1, 9), ("b", 1, 1), (None, 1, 4)])
    once(8, [("b", 5, 4)])
    once(12, [("c", 1, 5), (None, 2, 8)])
    once(17, [("a", 3, 20)])
    once(30, [("d", 1, 1)])
    got = {
        (r.batch_id, r.key, r.sequence, r.gaps, r.gap_total, r.violations, r.expired)
        for r in jobs.read_batches(spark, out).collect()
    }
    assert got == {
        (0, "a", 7, 0, 0, 1, False),
        (0, "b", 1, 0, 0, 0, False),
        (0, None, 4, 0, 0, 0, False),
        (1, "b", 4, 1, 2, 0, False),
        (2, "c", 5, 0, 0, 0, False),
        # What comes back after its time starts anew.
        (2, None, 8, 0, 0, 0, False),
        (2, None, 4, 0, 0, 0, True),
        (2, "a", 7, 0, 0, 1, True),
        (3, "a", 20, 0, 0, 0, False),
        (4, "d", 1, 0, 0, 0, False),
        (4, "a", 20, 0, 0, 0, True),
        (4, "b", 4, 1, 2, 0, True),
        (4, "c", 5, 0, 0, 0, True),
        (4, None, 8, 0, 0, 0, True),
    }


def arrivals(spark, batches, schema):
    """900 rows of which a third have one key, written in ``batches`` files by arrival."""
    rng = random.Random(9)
    rows = [
        ("s1" if n % 4 else "s2", "x" * (n % 9), "hot" if n % 3 else f"k{n % 7}", n, rng.randrange(60), n % 2)
        for n in range(900)
    ]
    source = scratch_path(spark, "src")
    for k in range(batches):
        part = [r for r in rows if r[3] * batches // len(rows) == k]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(f"{source}/part={k}")
    return rows, source


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_accounts_and_audit_do_not_depend_on_batches(spark, batches, monkeypatch):
    """A hot key is summed up in slices, and only segments meet the state."""
    monkeypatch.setattr(ordered, "HOT_ROWS", 40)
    monkeypatch.setattr(state_table, "FAN_IN", 3)
    schema = "stream string, data string, key string, arrival bigint, sequence bigint, partition int"
    rows, source = arrivals(spark, batches, schema)
    df = spark.createDataFrame(rows, schema)
    out, state, audited, last, ckpt, ckpt2 = (scratch_path(spark, n) for n in ("o", "s", "a", "l", "c", "c2"))
    for k in range(batches):
        # Each start takes up one folder more, as a restarted job does.
        stream = log.read_log_stream(spark, f"{source}/part={{{','.join(map(str, range(k + 1)))}}}", schema=schema)
        jobs.status_stream(stream, out, state, ckpt).awaitTermination()
        jobs.audit_batches(stream, audited, last, ckpt2, scope=("key",)).awaitTermination()
    want = {tuple(r) for r in audit.account_sequences(df).collect()}
    got = jobs.latest_accounts(spark, state)
    assert {tuple(r) for r in got.select("key", "sequence", "partition", "gaps", "gap_total").collect()} == want
    audit_rows = audit.ordering_audit(df, scope=("key",))
    violations = audit_rows.groupBy("key").agg(F.count_if(F.col("status") == "violation").alias("n")).collect()
    assert {(r.key, r.violations) for r in got.collect()} == {(r.key, r.n) for r in violations}
    totals = {tuple(r) for r in jobs.latest_status(spark, state).collect()}
    assert totals == {tuple(r) for r in reports.stream_info(df).collect()}
    found = jobs.read_batches(spark, audited).select(*audit_rows.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, audit_rows.collect()), key=str)


def test_lag_windows_keep_late_samples_and_the_end(spark):
    """Micro-batches in any order of time, the last one hours late."""
    source, out, state, ckpt = (scratch_path(spark, n) for n in ("samples", "windows", "state", "ckpt"))
    schema = "stream string, partition bigint, sample_seq bigint, ts timestamp, partition_count bigint, pending bigint, ack_pending bigint"
    rng = random.Random(6)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(f"s{n % 2}", n % 3, n, at(rng.randrange(7200)), 1 + n % 5, rng.randrange(99), n % 7) for n in range(300)]
    rows.sort(key=lambda r: -r[3].timestamp())
    for part in (rows[:100], rows[100:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = log.read_log_stream(spark, source, max_files=1, schema=schema)
        jobs.lag_stream(stream, out, state, ckpt).awaitTermination()
    want = reports.lag_windows(spark.createDataFrame(rows, schema)).collect()
    assert sorted(jobs.latest_lag_windows(spark, state).collect()) == sorted(want)
    # The last update of each window is the window.
    updates = jobs.read_batches(spark, out).collect()
    last = {(r.stream, r.window_start): tuple(r)[:-1] for r in sorted(updates, key=lambda r: r.batch_id)}
    assert set(last.values()) == {tuple(r) for r in want}
    assert len(want) > 100


def test_replay_stream_decodes_once_in_many_tasks(spark, tmp_path, monkeypatch):
    """A batch from one file is decoded by several tasks, and ids are read from what that wrote."""
    rows = [(k, f'{{"key":"acct-{k % 9}","sequence":{k // 9}}}') for k in range(400)]
    spark.createDataFrame(rows, "stream_seq bigint, data string").coalesce(1).write.parquet(str(tmp_path / "raw"))
    seen, decode, known = [], replay.decode_messages, jobs.IdStore.known

    def decoded(df, *args):
        seen.append(df.rdd.getNumPartitions())
        return decode(df, *args)

    def checked(store, batch_id, ids):
        assert "from_json" not in ids._jdf.queryExecution().optimizedPlan().toString()
        return known(store, batch_id, ids)

    monkeypatch.setattr(replay, "decode_messages", decoded)
    monkeypatch.setattr(jobs.IdStore, "known", checked)
    out, dead, ckpt = (str(tmp_path / n) for n in ("out", "dead", "ckpt"))
    source = log.read_log_stream(spark, str(tmp_path / "raw"), schema="stream_seq bigint, data string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # for so few rows
    try:
        jobs.replay_stream(source, out, dead, 5, "S", ckpt, 1).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert jobs.read_batches(spark, out).count() == 400
    assert seen and min(seen) > 1
