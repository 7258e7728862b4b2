"""Duplicate window and cooldown against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from partlog.operators import spacing


def kept_by_loop(points, window):
    kept, last = [], {}
    for id, t, pos in sorted(points, key=lambda p: (p[0], p[1], p[2])):
        if id not in last or t - last[id] >= window:
            last[id] = t
            kept.append(pos)
    return sorted(kept)


def frame(spark, points):
    df = spark.createDataFrame(points, "id string, t bigint, stream_seq bigint")
    return df.withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("fold_rows", [4096, 8, 0])
@pytest.mark.parametrize("seed, n, reach", [(1, 300, 20_000), (2, 400, 2_000), (3, 200, 100_000)])
def test_random_ids(spark, fold_rows, seed, n, reach):
    rnd = random.Random(seed)
    # One id holds a third of the rows.
    points = [("hot" if i % 3 == 0 else f"k{rnd.randrange(5)}", rnd.randrange(reach), i) for i in range(n)]
    got = spacing.dedup_window(frame(spark, points), window="2 minutes", fold_rows=fold_rows)
    assert sorted(r.stream_seq for r in got.collect()) == kept_by_loop(points, 120)


def test_copies_at_one_time(spark):
    points = [("a", 100, i) for i in range(50)] + [("a", 219, 50), ("a", 220, 51)]
    got = spacing.dedup_window(frame(spark, points))
    assert sorted(r.stream_seq for r in got.collect()) == [0, 51]


def test_window_counts_from_kept_rows(spark):
    # 90 s apart: every second one is kept, although each is close to the one before.
    points = [("a", 90 * i, i) for i in range(10)]
    got = spacing.dedup_window(frame(spark, points))
    assert sorted(r.stream_seq for r in got.collect()) == [0, 2, 4, 6, 8]


def test_scale_rule(spark):
    rows = [
        ("s", 0, 0, 3, 6000),  # above: up
        ("s", 10, 1, 3, 6000),  # within the cooldown
        ("s", 30, 2, 3, 5000),  # not above the mark
        ("s", 40, 3, 3, 499),  # below: down
        ("s", 80, 4, 1, 0),  # at the minimum
        ("s", 90, 5, 10, 9000),  # at the maximum
        ("s", 100, 6, 9, 5001),  # up
    ]
    df = spark.createDataFrame(rows, "stream string, t bigint, sample_seq bigint, partition_count bigint, lag bigint")
    got = spacing.scale_recommendations(df.withColumn("ts", F.timestamp_seconds("t")))
    assert sorted((r.sample_seq, r.step, r.desired) for r in got.collect()) == [(0, 1, 4), (3, -1, 2), (6, 1, 10)]


def test_positions_per_stream(spark):
    """Equal positions in two streams do not stand for each other; a NULL id is an id."""
    points = [("a", 0, 1), ("a", 5, 2), ("b", 0, 1), ("b", 500, 2), (None, 0, 1), (None, 9, 2)]
    for fold_rows in (1024, 0):
        got = spacing.dedup_window(frame(spark, points), window="2 minutes", fold_rows=fold_rows)
        kept = {(r.id, r.stream_seq) for r in got.collect()}
        assert kept == {("a", 1), ("b", 1), ("b", 2), (None, 1)}
