"""Sliced windows equal plain windows, and spread a hot key."""

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from partlog.plans import ordered
from partlog.plans.bounds import at_most, join_small


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows of which a third belong to one key."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (n % 40).cast("string")))
    value = (n * 7919) % 1009
    return spark.range(3000).select(
        key.alias("key"),
        n.alias("pos"),
        value.alias("v"),
        F.when(value % 5 == 0, value).alias("sparse"),
        F.timestamp_seconds(n * 600).alias("ts"),
    )


def same(a, b):
    a = a.select(*b.columns)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("span", [None, 1, 37, 500])
@pytest.mark.parametrize("scope", [["key"], []])
def test_previous(rows, span, scope):
    w = Window.partitionBy(*scope).orderBy("pos")
    same(
        ordered.previous(rows, {"p": "v"}, scope, ["pos"], span=span),
        rows.withColumn("p", F.lag("v").over(w)),
    )


def test_previous_by_time(rows):
    w = Window.partitionBy("key").orderBy("ts")
    same(
        ordered.previous(rows, {"p": "v"}, ["key"], ["ts"], span=86_400_000_000),
        rows.withColumn("p", F.lag("v").over(w)),
    )


def test_previous_with_tie_break(rows):
    tied = rows.withColumn("day", F.floor(F.col("pos") / 50))
    w = Window.partitionBy("key").orderBy("day", "pos")
    want = tied.withColumn("p", F.lag("v").over(w))
    same(ordered.previous(tied, {"p": "v"}, ["key"], ["day", "pos"], span=4), want)
    same(ordered.previous(tied, {"p": "v"}, ["key"], ["day", "pos"], bucket="pos", span=20), want)


@pytest.mark.parametrize("span", [None, 37])
@pytest.mark.parametrize("descending", [False, True])
def test_carry_forward(rows, span, descending):
    w = Window.partitionBy("key").orderBy(F.desc("pos") if descending else F.asc("pos"))
    same(
        ordered.carry_forward(rows, {"f": "sparse"}, ["key"], ["pos"], span=span, descending=descending),
        rows.withColumn("f", F.last("sparse", ignorenulls=True).over(w)),
    )


@pytest.mark.parametrize("span", [None, 37])
def test_sum_and_number(rows, span):
    w = Window.partitionBy("key").orderBy("pos")
    same(
        ordered.running_sum(rows, "s", F.col("v"), ["key"], ["pos"], span=span),
        rows.withColumn("s", F.sum("v").over(w)),
    )
    same(
        ordered.number_rows(rows, "n", ["key"], ["pos"], span=span),
        rows.withColumn("n", F.row_number().over(w).cast("bigint")),
    )


@pytest.mark.parametrize("limit", [1, 7, 100, 5000])
@pytest.mark.parametrize("descending", [False, True])
def test_mark_first(rows, limit, descending):
    w = Window.partitionBy("key").orderBy(F.desc("pos") if descending else F.asc("pos"))
    same(
        ordered.mark_first(rows, "kept", limit, ["key"], "pos", 64, descending),
        rows.withColumn("kept", F.row_number().over(w) <= limit),
    )


def test_hot_key_is_spread(spark, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = ordered.previous(rows, {"p": "v"}, ["key"], ["pos"], span=64)
        hot = out.where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(hot) >= 6
    assert max(r["count"] for r in hot) < 500


def test_mark_first_does_not_shuffle_the_log(rows):
    plan = ordered.mark_first(rows, "kept", 5000, ["key"], "pos", 64)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    # Only the one boundary slice is sorted for a window; the rest is decided in place.
    assert physical.count("row_number()") == 1


def test_join_small_falls_back(spark):
    left, right = spark.range(100), spark.range(50).withColumn("x", F.lit(1))
    assert at_most(right, 50) and not at_most(right, 49)
    for bound in (10, 1000):
        joined = join_small(left, right, ["id"], "left", max_rows=bound)
        assert joined.where("x = 1").count() == 50
    plan = lambda b: join_small(left, right, ["id"], "left", b)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(1000) and "broadcast" not in plan(10)


def test_hot_groups_are_cut_and_others_are_not(rows, monkeypatch):
    """The same rows when only the hot key is sliced, also by a sparse order column."""
    monkeypatch.setattr(ordered, "HOT_ROWS", 200)
    df = rows.withColumn("nanos", F.col("pos") * 1_000_000_007).withColumn("one", F.lit(1))
    df = df.withColumn("key", F.when(F.col("key") != "k7", F.col("key")))
    for order in ("pos", "nanos", "ts"):
        w = Window.partitionBy("key").orderBy(order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        same(ordered.previous(df, {"p": "v"}, ["key"], [order]), df.withColumn("p", F.lag("v").over(w)))
        same(
            ordered.carry_forward(df, {"c": "sparse"}, ["key"], [order]),
            df.withColumn("c", F.last("sparse", ignorenulls=True).over(upto)),
        )
        same(
            ordered.running_sum(df, "t", F.col("v"), ["key"], [order]),
            df.withColumn("t", F.sum("v").over(upto)),
        )
        same(
            ordered.number_rows(df, "n", ["key"], [order]),
            df.withColumn("n", F.row_number().over(w).cast("bigint")),
        )


@pytest.mark.parametrize("span", [None, 4])
def test_null_scope(spark, span):
    df = spark.createDataFrame([(None, k, 10 * k) for k in range(1, 40)], "key string, pos bigint, v bigint")
    got = ordered.previous(df, {"p": "v"}, ["key"], ["pos"], span=span).orderBy("pos").collect()
    assert [r.p for r in got] == [None, *range(10, 390, 10)]


def test_cold_keys_take_one_read_and_one_shuffle(rows, spark):
    from partlog.operators import audit
    from partlog.plans.scratch import scratch_path

    path = scratch_path(spark, "rows")
    rows.select("key", F.col("v").alias("sequence"), F.col("pos").alias("arrival")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    audited = plan(audit.ordering_audit(df, scope=("key",)))
    assert audited.count("FileScan") == 1 and audited.count("Exchange hashpartitioning") == 1
    summed = plan(audit.summarize_sequences(df))
    assert summed.count("FileScan") == 1 and summed.count("Exchange hashpartitioning") <= 2


def slices(spark, monkeypatch, rows, order, hot=100):
    """Numbers of rows per slice of each group, checked to rise through the order."""
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    df = spark.createDataFrame(rows, "key string, t bigint, tie bigint")
    found = ordered.rank_slices(df, len(rows), ["key"], order).collect()
    assert len(found) == len(rows)
    held, last = Counter(), {}
    for r in sorted(found, key=lambda r: (r["key"] or "", *[r[c] for c in order])):
        assert r["_slice"] >= last.get(r["key"], 0)
        last[r["key"]] = r["_slice"]
        held[r["key"], r["_slice"]] += 1
    return held


def test_slices_are_bounded_by_rank(spark, monkeypatch):
    outlier = [("a", n, n) for n in range(10_000)] + [("a", 10**9, 0)]
    assert max(slices(spark, monkeypatch, outlier, ["t"]).values()) <= 50
    # A burst at one time is cut by the next order column.
    burst = [("a", 5 if n % 3 else n, n) for n in range(6_000)]
    assert max(slices(spark, monkeypatch, burst, ["t", "tie"]).values()) <= 50
    # Groups of unlike density and size, one of them without a name.
    mixed = [("a", n, n) for n in range(3_000)] + [(None, n * n * 10**9, n) for n in range(3_000)]
    mixed += [("c", -n, n) for n in range(200)]
    held = slices(spark, monkeypatch, mixed, ["t"])
    assert max(held.values()) <= 50 and {k for k, _ in held} == {"a", None, "c"}


def test_slices_from_a_sample_and_with_a_limit(spark, monkeypatch):
    """One row in five is drawn, and no more than about forty slices may be made."""
    monkeypatch.setattr(ordered, "SAMPLES", 100)
    rows = [("a", n * n, n) for n in range(20_000)]
    held = slices(spark, monkeypatch, rows, ["t"], hot=2_000)
    assert max(held.values()) <= 1_000 and 30 <= len(held) <= 50
    monkeypatch.setattr(ordered, "MOST_SLICES", 10)
    held = slices(spark, monkeypatch, rows, ["t"], hot=2_000)
    assert max(held.values()) <= 4_000 and 8 <= len(held) <= 13


def test_hot_groups_with_outliers_and_bursts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    rows = [("a", 7 if n % 2 else n, n, n % 11) for n in range(1_500)] + [("a", 10**12, 0, 5)]
    rows += [(None, n * n, n, n % 7) for n in range(700)] + [(f"k{n % 9}", n, n, n) for n in range(400)]
    df = spark.createDataFrame(rows, "key string, t bigint, tie bigint, v bigint")
    w = Window.partitionBy("key").orderBy("t", "tie")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.previous(df, {"p": "v"}, ["key"], ["t", "tie"]), df.withColumn("p", F.lag("v").over(w)))
    same(
        ordered.running_sum(df, "s", F.col("v"), ["key"], ["t", "tie"]),
        df.withColumn("s", F.sum("v").over(upto)),
    )
    down = Window.partitionBy("key").orderBy(F.desc("t"), F.desc("tie"))
    some = df.withColumn("x", F.when(F.col("v") > 5, F.col("v")))
    same(
        ordered.carry_forward(some, {"f": "x"}, ["key"], ["t", "tie"], descending=True),
        some.withColumn("f", F.last("x", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))),
    )


def test_a_hot_key_evaluates_the_input_twice(spark, monkeypatch):
    """Once for the count, once for the rows: whatever was computed before is not repeated."""
    from partlog.operators import audit

    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("a" if n % 3 else f"k{n % 5}", n, n) for n in range(900)]
    df = spark.createDataFrame(rows, "key string, arrival bigint, sequence bigint")
    df = df.mapInArrow(counted, df.schema)
    found = audit.ordering_audit(df, scope=("key",))
    assert found.count() == 900
    assert seen.value <= 2 * 900
    seen.value = 0
    assert audit.sequence_runs(df).count() > 0
    assert seen.value <= 2 * 900
