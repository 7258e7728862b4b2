"""User functions see whole keys and partitions, in order."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from partlog.operators import completeness, delivery, handlers, replay, reports


def test_a_key_streams_through_one_call(spark):
    def running(batches):
        total = 0
        for rows in batches:
            so_far = total + rows["sequence"].cumsum()
            total = int(so_far.iloc[-1])
            yield rows[["key", "stream_seq"]].assign(so_far=so_far)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(400).select(
            F.col("id").alias("stream_seq"),
            F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("key"),
            F.lit(1).cast("bigint").alias("sequence"),
        )
        got = handlers.process_by_key(df, running, "key string, stream_seq bigint, so_far bigint").toPandas()
        for _, rows in got.fillna("none").groupby("key"):
            assert list(rows.sort_values("stream_seq")["so_far"]) == list(range(1, 81))
        # Functions that stop early do not disturb the keys that follow.
        first = lambda batches: iter([next(batches).head(1)])
        got = handlers.process_by_key(df, first, df.schema).toPandas()
        assert sorted(got["stream_seq"]) == [0, 1, 2, 3, 4]

        def sizes(batches):
            seen = [list(rows["stream_seq"]) for rows in batches]
            flat = sum(seen, [])
            assert flat == sorted(flat)
            yield pd.DataFrame({"n": [len(flat)]})

        one = df.withColumn("key", F.concat(F.lit("acct-"), (F.col("stream_seq") % 3).cast("string")))
        got = handlers.process_by_partition(one, sizes, "n bigint", 3).toPandas()
        assert sorted(got["n"]) == [133, 133, 134]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pieces_are_whole_whatever_the_batches(spark):
    """Pieces over several batches, several pieces in one, NULLs beside large integers; few batches to Python."""
    big = (1 << 60) + 1
    n = F.col("id")
    df = spark.range(300).select(
        n.alias("stream_seq"),
        F.when(n % 3 > 0, n % 3).alias("key"),
        F.when(n % 50 != 7, n + big).alias("ts"),
        F.when(n % 50 != 9, n % 2 == 0).alias("flag"),
    )

    def summed(rows):
        kinds = f"{rows['ts'].dtype} {rows['flag'].dtype}"
        exact = rows["ts"].isna().any() or list(rows["ts"] - big) == list(rows["stream_seq"])
        listed = ",".join(map(str, rows["stream_seq"]))
        return rows[["key", "piece"]].head(1).assign(n=len(rows), kinds=kinds, exact=bool(exact), listed=listed)

    for size in (3, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            made = handlers.process_by_piece(df, summed, "key bigint, piece bigint, n int, kinds string, exact boolean, listed string", 7)
            got = {(r.key, r.piece): r for r in made.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
        assert len(got) == 3 * 15
        for key in (None, 1, 2):
            rows = [k for k in range(300) if k % 3 == (key or 0)]
            for piece in range(15):
                part, r = rows[7 * piece : 7 * piece + 7], got[key, piece]
                assert r.listed == ",".join(map(str, part)) and r.n == len(part) and r.exact
                ts = "float64" if any(k % 50 == 7 for k in part) else "int64"
                flag = "object" if any(k % 50 == 9 for k in part) else "bool"
                assert r.kinds == f"{ts} {flag}"


def test_only_holes_are_expanded(spark):
    expected = spark.createDataFrame([("a", 10), ("b", 3), ("none", 2), ("zero", 0), (None, 4)], "key string, expected bigint")
    rows = [("a", s) for s in (0, 2, 3, 3, 7, 12)] + [("b", 1), ("b", 2), ("b", 3), ("odd", 1), ("zero", 1)]
    received = spark.createDataFrame(rows, "key string, sequence bigint")
    for piece in (2, 100):
        got = {tuple(r) for r in completeness.missing_messages(expected, received, piece).collect()}
        want = {("a", s, "missing") for s in (1, 4, 5, 6, 8, 9, 10)}
        want |= {("none", 1, "missing"), ("none", 2, "missing")} | {(None, s, "missing") for s in range(1, 5)}
        want |= {("a", 0, "unexpected"), ("a", 12, "unexpected"), ("odd", 1, "unexpected"), ("zero", 1, "unexpected")}
        assert got == want


def test_percentiles_leave_out_nulls_and_stand_outliers(spark):
    rows = [(v,) for v in [None, None, 1, 2, *range(3, 100), 10**12]]
    df = spark.createDataFrame(rows, "latency_us bigint")
    got = reports.latency_percentiles(df).head()
    assert (got.p50, got.p95, got.p99) == (51, 96, 10**12)
    assert reports.latency_percentiles(df.limit(4)).head().p50 == 2


def test_percentiles_of_many_distinct_values(spark):
    """Only values near a rank are put in order; groups of any spread, and ties."""
    n = F.col("id")
    far = F.when(n == 7, F.lit(10**15)).otherwise(n * 7919 % 99_991)
    tied = F.when(n % 2 == 0, F.lit(5)).otherwise(n)
    df = spark.range(100_000).select(
        F.when(n % 3 > 0, F.concat(F.lit("g"), (n % 3).cast("string"))).alias("g"),
        F.when(n % 3 == 1, far).otherwise(tied).alias("latency_us"),
    )
    got = {r.g: r for r in reports.latency_percentiles(df, by=("g",), pcts=(0, 50, 99, 100)).collect()}
    for g, rows in df.toPandas().groupby("g", dropna=False)["latency_us"]:
        values = sorted(rows)
        r = got[None if pd.isna(g) else g]
        want = [values[min(len(values) * p // 100, len(values) - 1)] for p in (0, 50, 99, 100)]
        assert [r.p0, r.p50, r.p99, r.p100] == want
    keyed = df.select(F.struct("g").alias("_of"), "latency_us")
    brackets = reports._brackets(keyed, F.col("_of"), "latency_us", (50, 99))
    near = keyed.join(brackets, "_of").select("_of", "latency_us", F.explode("_brackets").alias("b"))
    inside = near.where("latency_us BETWEEN b._low AND b._high AND latency_us <> 5").groupBy("_of", "b._k").count()
    assert max(r["count"] for r in inside.collect()) < 100


def test_percentiles_when_a_sketch_misses(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("latency_us"), (F.col("id") % 2).alias("g"))
    want = sorted(map(tuple, reports.latency_percentiles(df, by=("g",)).collect()))
    brackets = reports._brackets

    def wrong(*args):
        off = lambda b: F.struct(b["_k"].alias("_k"), b["_rank"].alias("_rank"), (b["_low"] + 300).alias("_low"), (b["_high"] + 300).alias("_high"))
        return brackets(*args).withColumn("_brackets", F.transform("_brackets", off))

    monkeypatch.setattr(reports, "_brackets", wrong)
    assert sorted(map(tuple, reports.latency_percentiles(df, by=("g",)).collect())) == want


@pytest.mark.parametrize("n", range(1, 21))
def test_task_p_gets_partition_p(spark, n):
    df = spark.range(200).select(
        F.col("id").alias("stream_seq"), F.concat(F.lit("acct-"), F.col("id").cast("string")).alias("key")
    )

    def where(batches):
        from pyspark import TaskContext

        for rows in batches:
            yield rows[["partition"]].assign(task=TaskContext.get().partitionId())

    got = handlers.process_by_partition(df, where, "partition int, task int", n).collect()
    assert {(r.partition, r.task) for r in got} == {(p, p) for p in range(n)}


def test_append_keeps_the_first_of_an_id(spark):
    new = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "b", "v")], "stream_seq bigint, id string, t string")
    target = spark.createDataFrame([("b",)], "id string")
    got = delivery.idempotent_append(new, target, ["id"])
    assert sorted(r.t for r in got.collect()) == ["x", "z"]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_replay_tasks_stay_small_however_many_rows(spark, monkeypatch):
    """Tasks of a replay get a given number of rows, from a table, and the result is the same."""
    monkeypatch.setattr(delivery, "TASK_ROWS", 20)
    n = F.col("id")
    text = F.format_string('{"key":"acct-%d","sequence":%d}', n % 40, F.floor(n / 120))
    raw = spark.range(600).select(n.alias("stream_seq"), F.when(n % 50 == 3, F.lit("x")).otherwise(text).alias("data"))
    done = spark.createDataFrame([("replay-acct-7-1",), (None,)], "id string")
    good, bad = replay.replay_buffer(raw, 5, "S", done)
    assert good.rdd.getNumPartitions() >= 588 // 20
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "get_variant" not in plan
    assert bad.count() == 12 and {r.error for r in bad.collect()} == {"not a JSON value"}
    first = {}
    for k in range(600):
        if k % 50 != 3:
            first.setdefault(f"replay-acct-{k % 40}-{k // 120}", k)
    del first["replay-acct-7-1"]
    assert {r.id: r.stream_seq for r in good.collect()} == first
    assert good.count() == len(first)

    new = spark.createDataFrame([(1, "a"), (2, "a"), (2, None), (3, None), (None, "c"), (4, "b"), (4, "b")], "stream_seq bigint, id string")
    target = new.where("false").select("id")
    want = sorted(map(str, delivery.idempotent_append(new, target, ["id"]).collect()))
    assert want == sorted(map(str, delivery.idempotent_append(new, target, ["id"], rows=700).collect()))


def test_a_stalled_consumer_counts_its_backlog(spark):
    ids = "stream string, partition int, stream_seq bigint"
    published = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 2, 3)], ids)
    tries = spark.createDataFrame([("s", 0, 1, 5, True)], ids + ", attempt_ts bigint, acked boolean")
    consumers = spark.createDataFrame([("s", 0), ("s", 1), ("s", 7)], "stream string, partition int")
    info = delivery.consumer_info(published, tries, consumers=consumers)
    found = {r.partition: (r.delivered, r.pending, r.ack_pending) for r in info.collect()}
    assert found == {0: (1, 0, 0), 1: (0, 1, 0), 7: (0, 0, 0)}
    assert delivery.total_pending(info).head().total_pending == 1
    assert not delivery.stream_drained(published, tries, consumers).head().drained
    only = consumers.where("partition = 0")
    assert delivery.stream_drained(published, tries, only).head().drained
