"""Configuration history, routing, replay plans and rewriting."""

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from partlog.functions.keys import partition_for_key
from partlog.operators import replay, retention, routing
from partlog.plans.scratch import scratch_path
from partlog.sources import log


@pytest.mark.parametrize("n", [0, -1, -100, 21, 1000])
def test_invalid_counts(spark, n):
    with pytest.raises(ValueError):
        replay.repartition_log(spark, "unused", "unused", n)


def test_same_count_is_no_work(spark):
    assert replay.repartition_log(spark, "unused", "unused", 3, old_count=3) is False


def test_valid_config(spark):
    df = spark.createDataFrame([(v,) for v in ("0", "1", "20", "21", "-1", "x", "", None)], "value string")
    assert [r.partition_count for r in routing.valid_config(df).collect()] == [1, 20]


def test_config_history(spark):
    rows = [
        (1, "mode", "buffer"),
        (2, "partition_count", "3"),
        (3, "partition_count", "junk"),
        (4, "mode", "direct"),
        (5, "partition_count", "99"),
        (6, "desired_partitions", "7"),
        (7, "partition_count", "5"),
    ]
    df = spark.createDataFrame(rows, "revision bigint, key string, value string")
    df = df.withColumn("effective_ts", F.timestamp_seconds("revision"))
    got = routing.config_history(df).orderBy("revision").collect()
    assert [(r.revision, r.mode, r.partition_count) for r in got] == [
        (2, "buffer", 3),
        (3, "buffer", 3),
        (4, "direct", 3),
        (5, "direct", 3),
        (7, "direct", 5),
    ]


@pytest.fixture(scope="module")
def config(spark):
    rows = [(1, 100, "direct", 3), (2, 200, "buffer", 3), (3, 300, "direct", 5), (4, 400, "buffer", 5)]
    df = spark.createDataFrame(rows, "revision int, t bigint, mode string, partition_count int")
    return df.select("revision", F.timestamp_seconds("t").alias("effective_ts"), "mode", "partition_count")


@pytest.mark.parametrize("bound", [0, 1000])
def test_route(spark, config, bound):
    rows = [(50, "acct-4"), (100, "acct-4"), (199, "acct-5"), (200, "acct-4"), (300, "acct-4"), (999, "acct-4")]
    df = spark.createDataFrame(rows, "t bigint, key string").withColumn("ts", F.timestamp_seconds("t"))
    got = routing.route_messages(df, config, "S", max_broadcast_rows=bound).orderBy("t").collect()
    assert [(r.t, r.subject) for r in got] == [
        (100, "S.01"),
        (199, "S.02"),
        (200, "S_BUFFER"),
        (300, "S.04"),
        (999, "S_BUFFER"),
    ]
    assert [r.t for r in routing.rejected_messages(df, config).collect()] == [50]


@pytest.mark.parametrize("n", [1, 2, 150])
def test_many_changes(spark, n):
    """Slices of time, merge by time, and a plain range join agree."""
    changes = spark.range(n).select(
        F.col("id").alias("revision"),
        # Bursts, pauses and several changes at one time.
        F.timestamp_seconds(F.floor(F.col("id") * F.col("id") / 3)).alias("effective_ts"),
        F.lit("direct").alias("mode"),
        (F.col("id") % 20 + 1).cast("int").alias("partition_count"),
    )
    df = spark.range(1200).select(
        "id", F.timestamp_seconds((F.col("id") - 10) * 7.3).alias("ts"), F.lit("acct-7").alias("key")
    )
    latest = df.join(changes, F.col("effective_ts") <= F.col("ts")).groupBy("id").agg(
        F.max_by("partition_count", F.struct("effective_ts", "revision")).alias("partition_count")
    )
    want = {r.id: r.partition_count for r in latest.collect()}
    for bound in (0, 1000):
        got = routing.route_messages(df, changes, "S", max_broadcast_rows=bound).collect()
        assert {r.id: r.partition_count for r in got} == want


def test_empty_config_rejects_all(spark, config):
    df = spark.range(3).select(F.timestamp_seconds("id").alias("ts"), F.lit("acct-7").alias("key"))
    assert routing.route_messages(df, config.limit(0), "S").count() == 0
    assert routing.rejected_messages(df, config.limit(0)).count() == 3


def test_route_does_not_shuffle_messages(spark, small, config):
    df = I.events(spark, small).select("ts", F.col("event_type").alias("key"))
    plan = routing.route_messages(df, config, "S")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("bound", [0, 1000])
def test_replay_plan_without_next_epoch(spark, config, bound):
    rows = [(150, "acct-4"), (250, "acct-4"), (350, "acct-4"), (450, "acct-4")]
    df = spark.createDataFrame(rows, "t bigint, key string").withColumn("ts", F.timestamp_seconds("t"))
    got = replay.replay_plan(df, config, "S", max_broadcast_rows=bound).orderBy("t").collect()
    assert [(r.epoch, r.phase, r.partition, r.subject) for r in got] == [
        (1, 1, 1, "S.01"),
        (3, 0, 4, "S.04"),
        (3, 1, 4, "S.04"),
        (None, 0, None, None),
    ]


def test_rewrite_keeps_rows_and_key_order(spark, small):
    start = scratch_path(spark, "log")
    log.write_log(replay.rekey(I.messages(spark, small), 1), start)
    want = {(r.key, r.sequence) for r in log.read_log(spark, start).collect()}
    path, count = start, 1
    for n in (3, 5, 2, 4):
        out = scratch_path(spark, "log")
        assert replay.repartition_log(spark, path, out, n, old_count=count)
        path, count = out, n
        rows = log.read_log(spark, path)
        assert rows.count() == len(want)
        assert {(r.key, r.sequence) for r in rows.collect()} == want
        assert rows.where(F.col("partition") != partition_for_key("key", n)).count() == 0
    # Within a file, positions rise; files of one partition do not overlap.
    files = (
        rows.withColumn("f", F.input_file_name())
        .groupBy("partition", "f")
        .agg(F.min("stream_seq").alias("lo"), F.max("stream_seq").alias("hi"))
        .orderBy("partition", "lo")
        .collect()
    )
    for a, b in zip(files, files[1:]):
        assert a.partition != b.partition or a.hi < b.lo


def test_partition_pruning(spark, small):
    path = scratch_path(spark, "log")
    log.write_log(replay.rekey(I.messages(spark, small), 3), path)
    plan = log.read_log(spark, path, partitions=[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [partition" in plan or "PartitionFilters: [isnotnull(partition" in plan


def test_empty_buffer(spark):
    empty = spark.createDataFrame([], "stream_seq bigint, data string")
    good, bad = replay.replay_buffer(empty, 3, "S")
    assert good.count() == 0 and bad.count() == 0


def test_poison_rows_do_not_stop_replay(spark):
    rows = [(i, "not-valid-json") for i in range(600)]
    rows += [(1000 + i, f'{{"key":"acct-{i % 3}","sequence":{i // 3 + 1}}}') for i in range(5)]
    rows += [(2000, '{"key":"acct-0","sequence":1}')]
    good, bad = replay.replay_buffer(spark.createDataFrame(rows, "stream_seq bigint, data string"), 1, "S")
    got = good.collect()
    assert sorted(r.stream_seq for r in got) == [1000, 1001, 1002, 1003, 1004]
    assert all(r.partition == 0 and r.subject == "S.00" for r in got)
    assert bad.count() == 600


def test_delivery_order_puts_replay_first(spark, small):
    plan = replay.replay_plan(I.published(spark, small), I.config_log(spark), "S")
    got = replay.delivery_order(plan, span=100).orderBy("partition", "position").collect()
    for a, b in zip(got, got[1:]):
        if a.partition == b.partition:
            assert b.position == a.position + 1
            assert (a.epoch, a.phase, a.stream_seq) < (b.epoch, b.phase, b.stream_seq)
    physical = replay.sort_for_delivery(plan)
    assert physical.count() == len(got)


def test_retention_by_now(spark):
    df = spark.range(100).select(
        F.lit("s").alias("stream"), F.col("id").alias("stream_seq"), F.timestamp_seconds(F.col("id") * 3600).alias("ts")
    )
    now = F.timestamp_seconds(F.lit(99 * 3600))
    kept = retention.retain_newest(df, "24 hours", 10, now=now, span=7)
    assert sorted(r.stream_seq for r in kept.collect()) == list(range(90, 100))
    kept, rejected = retention.retain_oldest(df, "24 hours", 10, now=now, span=7)
    assert sorted(r.stream_seq for r in kept.collect()) == list(range(75, 85))
    assert sorted(r.stream_seq for r in rejected.collect()) == list(range(85, 100))


def test_every_message_is_routed_or_rejected(spark):
    config = spark.createDataFrame(
        [(1, 10, "direct", 3), (2, 20, "direct", 0), (3, 30, "direct", None), (4, 40, "direct", 21), (5, 50, "direct", 20)],
        "revision int, t bigint, mode string, partition_count int",
    ).withColumn("effective_ts", F.timestamp_seconds("t"))
    rows = [(t, "acct-4") for t in range(5, 60, 5)]
    df = spark.createDataFrame(rows, "t bigint, key string").withColumn("ts", F.timestamp_seconds("t"))
    for bound in (1000, 0):
        good, bad = routing.split_routes(df, config, "S", max_broadcast_rows=bound)
        assert sorted(r.t for r in good.collect()) == [10, 15, 50, 55]
        reasons = {r.t: r.reject_reason for r in bad.collect()}
        assert sorted(reasons) == [5, 20, 25, 30, 35, 40, 45]
        assert reasons[5] == routing.NO_CONFIG and reasons[20] == routing.BAD_COUNT
    planned = replay.replay_plan(df, config, "S").count()
    assert planned + replay.unplanned_messages(df, config).count() == len(rows)


def odd_times(spark):
    """Messages with a burst at one time and one far away, and a config row for every second."""
    rows = [(n, f"acct-{n % 9}", 500 if n % 3 == 0 else n) for n in range(1_500)] + [(9_999, "acct-1", 10**7)]
    df = spark.createDataFrame(rows, "stream_seq bigint, key string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    config = [(k, 5 * k, "buffer" if k % 4 == 0 else "direct", (0, 3, None, 50, 7)[k % 5]) for k in range(1, 250)]
    log = spark.createDataFrame(config, "revision int, t bigint, mode string, partition_count int")
    return df.drop("t"), log.withColumn("effective_ts", F.timestamp_seconds("t")).drop("t")


def test_a_long_config_log_is_merged_in_bounded_slices(spark, monkeypatch):
    from partlog.plans import ordered

    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    df, config = odd_times(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    want = [sorted(map(tuple, part.collect()), key=str) for part in routing.split_routes(df, config, "S")]
    # One task each, so that a limit reads whole batches.
    once = config.coalesce(1).mapInArrow(counted, config.schema)
    merged = routing.split_routes(df, once, "S", max_broadcast_rows=10)
    got = [sorted(map(tuple, part.collect()), key=str) for part in merged]
    assert got == want and all(want)
    # Once to see that there are too many, and once to keep them.
    assert read.value <= 2 * config.count()


def test_every_message_is_planned_or_not(spark):
    df, config = odd_times(spark)
    planned, unplanned = replay.split_plan(df, config, "S")
    good, bad = planned.collect(), unplanned.collect()
    assert len(good) + len(bad) == df.count() and len(good) > 100
    assert sorted(r.stream_seq for r in [*good, *bad]) == sorted(r.stream_seq for r in df.collect())
    assert {r.reject_reason for r in bad} == {routing.NO_CONFIG, routing.BAD_COUNT}
    counts = {r.revision: r.partition_count for r in config.collect()}
    for r in good:
        assert counts[r.epoch] in (3, 7) and r.partition == int(r.key[5:]) % counts[r.epoch]
        assert r.subject == f"S.{r.partition:02d}"
