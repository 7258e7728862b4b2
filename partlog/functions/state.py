"""Sequence reports as stored by producers and consumers: ``kv_key`` and JSON value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlog import schema as S
from partlog.functions.keys import _col


def parse_state_key(kv_key: Column | str) -> Column:
    """``pub.<key>`` or ``cons.p<N>.<key>`` as (source, partition, key); else NULL fields.

    Message keys may contain dots.
    """
    k = _col(kv_key)
    parts = F.split(k, r"\.", 3)
    is_pub = F.startswith(k, F.lit("pub."))
    is_cons = F.startswith(k, F.lit("cons.")) & (F.size(parts) == 3)
    partition = F.regexp_extract(F.get(parts, F.lit(1)), r"^p([0-9]+)\z", 1)
    return F.struct(
        F.when(is_pub, F.lit("producer")).when(is_cons, F.lit("consumer")).alias("source"),
        F.when(is_cons, F.nullif(partition, F.lit("")).try_cast("bigint")).alias("partition"),
        F.when(is_pub, F.substring(k, 5, 1 << 30)).when(is_cons, F.get(parts, F.lit(2))).alias("key"),
    )


def sequence_state_value(value_json: Column | str) -> Column:
    """Stored value as a struct; counters that were not written are 0.

    NULL for text that is not such a value.
    """
    broken = "_broken"
    schema = T.StructType([*S.SEQUENCE_STATE.fields, T.StructField(broken, T.StringType())])
    v = F.from_json(_col(value_json), schema, {"columnNameOfCorruptRecord": broken})
    zero = lambda name: F.coalesce(v[name], F.lit(0).cast("bigint")).alias(name)
    return F.when(
        v.isNotNull() & v[broken].isNull(),
        F.struct(
            zero("sequence"),
            zero("partition"),
            F.coalesce(v["source"], F.lit("")).alias("source"),
            zero("gaps"),
            zero("gap_total"),
            zero("violations"),
        ),
    )
