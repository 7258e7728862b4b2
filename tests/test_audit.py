"""Audit operators on small logs, including lists cut into pieces."""

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from partlog.operators import audit, completeness


def log_of(spark, **per_key):
    rows = [(k, s, 0, 1, i) for k, seqs in per_key.items() for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "key string, sequence bigint, partition int, run int, arrival bigint")


EXAMPLE = [1, 2, 3, 4, 50, 51, 52, 10, 11, 12]


def test_summary_example(spark):
    df = log_of(spark, a=EXAMPLE)
    assert audit.summarize_sequences(df).head().summary == "1-4, 50-52, 10-12"
    pieces = audit.summarize_sequences(df, runs_per_piece=2).orderBy("piece").collect()
    assert [p.summary for p in pieces] == ["1-4, 50-52", "10-12"]
    assert audit.summarize_sequences(df, span=3).head().summary == "1-4, 50-52, 10-12"


@pytest.mark.parametrize("seqs, want", [(EXAMPLE, "1-4, 50-52, 10-12"), ([], "[]"), ([5], "5"), ([1, 3, 4], "1, 3-4")])
def test_summary_of_list(spark, seqs, want):
    df = spark.createDataFrame([(seqs,)], "s array<bigint>")
    assert df.select(audit.summarize_list("s").alias("t")).head().t == want


def test_audit_compares_with_previous_arrival(spark):
    df = log_of(spark, a=[3, 5, 4, 5, 5, 9], b=[7])
    got = audit.ordering_audit(df).orderBy("key", "arrival").collect()
    assert [(r.status, r.missing) for r in got] == [
        ("ok", 0),
        ("gap", 1),
        ("violation", 0),
        ("ok", 0),
        ("violation", 0),
        ("gap", 3),
        ("ok", 0),
    ]
    (s,) = audit.ordering_summary(audit.ordering_audit(df)).collect()
    assert (s.received, s.violations, s.gaps, s.missing) == (7, 2, 2, 4)


def test_account_state_may_go_back(spark):
    (r,) = audit.account_sequences(log_of(spark, a=[1, 5, 2])).collect()
    assert (r.sequence, r.gaps, r.gap_total) == (2, 1, 3)


@pytest.fixture(scope="module")
def stored(spark, small):
    return spark.read.parquet(I.stored(I.delivered(spark, small), "delivered"))


@pytest.mark.parametrize(
    "fn", [audit.ordering_audit, audit.account_sequences, audit.sequence_runs, audit.position_check]
)
def test_slices_do_not_change_results(stored, fn):
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(fn(stored)) == rows(fn(stored, span=50))


def test_lists_in_pieces(spark):
    df = log_of(spark, a=EXAMPLE)
    pieces = audit.sequence_lists(df, piece_rows=4).orderBy("piece").collect()
    assert [list(p.sequences) for p in pieces] == [[1, 2, 3, 4], [50, 51, 52, 10], [11, 12]]


def test_messages_in_pieces(stored):
    df = stored
    pieces = audit.consumer_results(df, with_messages=True, order=("stream_seq", "arrival"), piece_rows=50)
    assert pieces.agg(F.max(F.size("messages"))).head()[0] == 50
    totals = {(r.run, r.partition): r.received for r in audit.consumer_results(df).collect()}
    assert {(r.run, r.partition): r.received for r in pieces.collect()} == totals
    assert pieces.agg(F.sum(F.size("messages"))).head()[0] == df.count()


def test_positions(spark):
    df = log_of(spark, ok=[3, 1, 2], dup=[1, 1, 2], skip=[1, 3], late=[2, 3])
    got = {r.key: (r.first_index, r.want_sequence, r.got_sequence) for r in audit.position_check(df).collect()}
    assert got == {"ok": (None, None, None), "dup": (1, 2, 1), "skip": (1, 2, 3), "late": (0, 1, 2)}


def test_completeness(spark):
    expected = spark.createDataFrame([("ok", 3), ("short", 4), ("dup", 2), ("none", 2), ("odd", 2)], "key string, expected bigint")
    df = log_of(spark, ok=[1, 2, 3], short=[1, 2], dup=[1, 2, 2], odd=[1, 3], extra=[1])
    got = {r.key: (r.missing, r.first_index) for r in completeness.completeness_report(expected, df).collect()}
    assert got == {"ok": (0, None), "short": (2, None), "dup": (-1, None), "none": (2, None), "odd": (0, 1), "extra": (None, None)}


def test_missing_messages(spark):
    expected = spark.createDataFrame([("a", 5), ("zero", 0)], "key string, expected bigint")
    got = completeness.missing_messages(expected, log_of(spark, a=[1, 2, 2, 9], zero=[1]))
    assert {(r.key, r.sequence, r.side) for r in got.collect()} == {
        ("a", 3, "missing"),
        ("a", 4, "missing"),
        ("a", 5, "missing"),
        ("a", 9, "unexpected"),
        ("zero", 1, "unexpected"),
    }
    assert completeness.expected_messages(expected, piece_rows=2).count() == 5


def test_examples_leave_duplicates_out(spark):
    df = audit.ordering_audit(log_of(spark, a=[2, 2, 1]))
    (r,) = audit.violation_examples(df).collect()
    assert (r.prev_sequence, r.sequence) == (2, 1)


def test_publish_order_hides_late_delivery(spark):
    df = log_of(spark, a=[2, 1, 3, 3]).withColumn("ts", F.col("sequence"))
    (r,) = audit.publish_order_check(df).collect()
    assert (r.received, r.violations, r.duplicates) == (4, 1, 1)
