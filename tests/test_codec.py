"""Strict decoding, encoding, dead letters and stored state."""

import json

import pytest
from pyspark.sql import functions as F

from partlog import schema as S
from partlog.functions import codec, state
from partlog.sources.dead_letter import dead_letter

GOOD = {
    '{"key":"a"}': ("a", 0, "", 0, 0),
    "null": ("", 0, "", 0, 0),
    "{}": ("", 0, "", 0, 0),
    '{"key":null,"sequence":5,"ts":9}': ("", 5, "", 0, 9),
    ' {"key":"é","payload":"x\\ny"} ': ("é", 0, "x\ny", 0, 0),
    '{"key":"a","more":[1,{"b":2}]}': ("a", 0, "", 0, 0),
    '{"sequence":-9223372036854775808,"partition":19}': ("", -(2**63), "", 19, 0),
}
BAD = [
    "not-valid-json",
    "",
    " ",
    '{"key":"a"}x',
    '{"key":"a"}{"key":"b"}',
    '{"key":"a"},{"key":"b"}',
    '{"key":"a"}]',
    '{"key":"a"}, "n":{}',
    '{"key":1}',
    '{"key":true}',
    '{"key":{"a":1}}',
    '{"payload":["a"]}',
    '{"sequence":"1"}',
    '{"sequence":1.5}',
    '{"sequence":9223372036854775808}',
    '{"partition":3000000000}',
    "[]",
    '"x"',
    "7",
]


def test_decode(spark):
    rows = [(i, t) for i, t in enumerate([*GOOD, *BAD])]
    df = spark.createDataFrame(rows, "stream_seq bigint, data string")
    good, bad = codec.decode_messages(df)
    got = {r.stream_seq: (r.key, r.sequence, r.payload, r.partition, r.ts) for r in good.collect()}
    assert got == dict(enumerate(GOOD.values()))
    assert sorted(r.data for r in bad.collect()) == sorted(BAD)
    assert good.schema["partition"].dataType.simpleString() == "int"


def test_decode_bytes_and_null(spark):
    df = spark.createDataFrame([(b'{"key":"a"}',), (None,)], "data binary")
    good, bad = codec.decode_messages(df)
    assert [r.key for r in good.collect()] == ["a"]
    assert bad.count() == 1


def test_encode_round_trip(spark):
    df = spark.createDataFrame([("a-1", 3, 'q"\n', 2, 5), (None, None, None, None, None)], S.MESSAGE.simpleString()[7:-1].replace(":", " "))
    encoded = codec.encode_messages(df)
    texts = [r.data for r in encoded.collect()]
    assert list(json.loads(texts[0])) == ["key", "sequence", "payload", "partition", "ts"]
    assert json.loads(texts[1]) == {"key": "", "sequence": 0, "payload": "", "partition": 0, "ts": 0}
    good, bad = codec.decode_messages(encoded)
    assert bad.count() == 0
    assert {(r.key, r.sequence, r.payload, r.partition, r.ts) for r in good.collect()} == {
        ("a-1", 3, 'q"\n', 2, 5),
        ("", 0, "", 0, 0),
    }


def test_dead_letter(spark):
    df = spark.createDataFrame([("not-valid-json",)], "data string")
    _, bad = codec.decode_messages(df)
    (row,) = dead_letter(bad, S.REASON_UNMARSHAL, "S.00", 42).collect()
    assert bytes(row.data) == b"not-valid-json"
    assert (row.original_subject, row.reason, row.ts_ns) == ("S.00", "unmarshal_failure", 42)
    assert row.error
    with pytest.raises(ValueError):
        dead_letter(bad, "other", "S.00", 42)


def test_state_keys(spark):
    cases = {
        "pub.acct-1": ("producer", None, "acct-1"),
        "pub.a.b": ("producer", None, "a.b"),
        "cons.p3.acct-1": ("consumer", 3, "acct-1"),
        "cons.p3.a.b.c": ("consumer", 3, "a.b.c"),
        "cons.p3": (None, None, None),
        "other": (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "kv_key string")
    for r in df.select("kv_key", state.parse_state_key("kv_key").alias("k")).collect():
        assert (r.k.source, r.k.partition, r.k.key) == cases[r.kv_key]


def test_state_value(spark):
    text = '{"sequence":7,"partition":1,"source":"consumer","gaps":2,"gap_total":5,"violations":3}'
    r = spark.range(1).select(state.sequence_state_value(F.lit(text)).alias("v")).head().v
    assert (r.sequence, r.partition, r.source, r.gaps, r.gap_total, r.violations) == (7, 1, "consumer", 2, 5, 3)
    r = spark.range(1).select(state.sequence_state_value(F.lit('{"sequence":1}')).alias("v")).head().v
    assert (r.sequence, r.gaps, r.source) == (1, 0, "")


@pytest.mark.parametrize("text", ["", "junk", '{"sequence":"x"}', '{"sequence":1'])
def test_broken_state_value(spark, text):
    assert spark.range(1).select(state.sequence_state_value(F.lit(text)).alias("v")).head().v is None


def test_names_count_without_case(spark):
    rows = [('{"Key":"a","SEQUENCE":5}',), ('{"key":"b","KEY":"c"}',), ('{"Key":1}',), ('{"kEy":null,"other":1}',)]
    good, bad = codec.decode_messages(spark.createDataFrame(rows, "data string"))
    assert sorted((r.key, r.sequence) for r in good.collect()) == [("", 0), ("a", 5), ("c", 0)]
    assert sorted(r.data for r in bad.collect()) == ['{"Key":1}']


def test_the_last_value_of_a_repeated_name_counts(spark):
    cases = {
        '{"key":"a","key":"b"}': ("b", 0),
        '{"KEY":"a","key":"b","Key":"c","x":1,"x":2}': ("c", 0),
        '{"sequence":1,"key":"a","Sequence":7}': ("a", 7),
        # A null changes nothing, and all values must have the type of the field.
        '{"key":"a","key":null}': ("a", 0),
        '{"key":null,"KEY":"b"}': ("b", 0),
        '{"key":null,"key":null}': ("", 0),
        '{"key":1,"key":"b"}': None,
        '{"sequence":"1","sequence":1}': None,
        '{"key":"a","key":"b"}x': None,
        '{"key":"a","key":"b"},{}': None,
        "{'key':'a'}": None,
        '{"key":"a","sequence":NaN}': None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "data string")
    good, bad = codec.decode_messages(df.withColumn("text", F.col("data")))
    got = {r.text: (r.key, r.sequence) for r in good.collect()}
    assert got == {t: want for t, want in cases.items() if want is not None}
    assert {r.data for r in bad.collect()} == {t for t, want in cases.items() if want is None}
