"""Routing of keys, names and identities."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partlog.functions import keys


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()


def expected_partition(key: str, count: int) -> int:
    raw = key.encode()
    if count <= 1:
        return 0
    digits = len(raw) - len(raw.rstrip(b"0123456789"))
    if digits and int(raw[-digits:]) < 2**63:
        return int(raw[-digits:]) % count
    h = 0
    for byte in raw:
        h = (h * 31 + byte) % 2**32
    return h % count


@pytest.mark.parametrize(
    "key, count, want",
    [
        ("acct-0", 3, 0),
        ("acct-1", 3, 1),
        ("acct-5", 3, 2),
        ("acct-99", 5, 4),
        ("acct-7", 1, 0),
        ("acct-7", 0, 0),
        ("acct-7", -1, 0),
        ("acct--5", 10, 5),
        ("", 5, 0),
    ],
)
def test_partition_cases(spark, key, count, want):
    assert one(spark, p=keys.partition_for_key(F.lit(key), count)).p == want


def test_partition_of_any_text(spark):
    samples = ["abc", "héé", "日本", "acct-5\n", "x٣", "9223372036854775807", "9223372036854775808", "a1b2"]
    rows = [(k, c) for k in samples for c in (-1, 0, 1, 2, 3, 7, 20)]
    df = spark.createDataFrame(rows, "key string, n int")
    for r in df.withColumn("p", keys.partition_for_key("key", "n")).collect():
        assert r.p == expected_partition(r.key, r.n), r


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=12), min_size=1, max_size=50))
def test_partition_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "key string")
    for r in df.withColumn("p", keys.partition_for_key("key", 7)).collect():
        assert r.p == expected_partition(r.key, 7)


@pytest.mark.parametrize(
    "text, want",
    [("acct-42", 42), ("a1b2", 2), ("foo-99x", -1), ("", -1), ("007", 7), ("abc", -1), ("9" * 30, -1)],
)
def test_trailing_number(spark, text, want):
    assert one(spark, n=keys.extract_trailing_number(F.lit(text))).n == want


@pytest.mark.parametrize("p, want", [(0, "S.00"), (1, "S.01"), (9, "S.09"), (10, "S.10"), (100, "S.100")])
def test_subject(spark, p, want):
    assert one(spark, s=keys.subject_for_partition("S", p)).s == want


@pytest.mark.parametrize("p, want", [(0, "consumer-p0"), (5, "consumer-p5"), (42, "consumer-p42")])
def test_consumer_name(spark, p, want):
    assert one(spark, s=keys.consumer_name(p)).s == want


def test_ids(spark):
    r = one(
        spark,
        a=keys.publish_id(F.lit("acct-1"), F.lit(7), F.lit(99)),
        b=keys.replay_id(F.lit("acct-1"), F.lit(7)),
    )
    assert (r.a, r.b) == ("acct-1-7-99", "replay-acct-1-7")
    with pytest.raises(ValueError):
        keys.message_id("publish", "key", "sequence")
    with pytest.raises(ValueError):
        keys.message_id("other", "key", "sequence")


def test_stream_names(spark):
    r = one(spark, n=keys.stream_names(F.lit("ledger"))).n
    assert r.subject_prefix == "LEDGER"
    assert (r.buffer_subject, r.dlq_stream, r.kv_bucket) == ("LEDGER_BUFFER", "LEDGER_DLQ", "LEDGER_config")


def test_moved_keys(spark):
    df = spark.createDataFrame([(f"acct-{i}",) for i in range(6)] * 2, "key string")
    moved = {r.key: (r.old_partition, r.new_partition) for r in keys.moved_keys(df, 3, 1).collect()}
    assert moved == {"acct-1": (1, 0), "acct-2": (2, 0), "acct-4": (1, 0), "acct-5": (2, 0)}
