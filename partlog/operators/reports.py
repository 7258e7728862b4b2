"""Reports over logs, deliveries and stored sequence state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlog import schema as S
from partlog.functions.keys import stream_names
from partlog.functions.state import parse_state_key, sequence_state_value
from partlog.plans import ordered
from partlog.plans.bounds import at_most, join_small
from partlog.plans.scratch import cut_lineage

SKETCH = 10_000  # accuracy of the quantile sketch before exact percentiles


def stream_info(df: DataFrame, data: str = "data") -> DataFrame:
    """Messages and bytes per stream."""
    return df.groupBy("stream").agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.octet_length(data).cast("bigint")), F.lit(0).cast("bigint")).alias("bytes"),
    )


def latest_by_key(
    changelog: DataFrame, key: str = "key", value: str = "value", revision: str = "revision"
) -> DataFrame:
    """Current value per key: the one with the highest revision."""
    return changelog.groupBy(key).agg(
        F.max_by(value, revision).alias(value), F.max(revision).alias(revision)
    )


def sequence_state(kv: DataFrame) -> DataFrame:
    """Stored reports as rows (source, partition, key, sequence, gaps, gap_total, violations)."""
    parsed = kv.select(
        parse_state_key("kv_key").alias("k"), sequence_state_value("value_json").alias("v")
    )
    return parsed.where(F.col("k.source").isNotNull() & F.col("v").isNotNull()).select(
        "k.source",
        "v.partition",
        "k.key",
        "v.sequence",
        "v.gaps",
        "v.gap_total",
        "v.violations",
    )


def merge_consumed(state: DataFrame) -> DataFrame:
    """Per key the consumer report with the highest sequence; ties go to the lowest partition."""
    report = F.struct("partition", "sequence", "gaps", "gap_total", "violations")
    rank = F.struct(F.col("sequence"), (-F.col("partition")).alias("p"))
    return (
        state.where(F.col("source") == "consumer")
        .groupBy("key")
        .agg(F.max_by(report, rank).alias("r"))
        .select("key", "r.*")
    )


def published_sequences(state: DataFrame) -> DataFrame:
    return (
        state.where(F.col("source") == "producer")
        .groupBy("key")
        .agg(F.max("sequence").alias("sequence"))
    )


def lag_status(published: Column, consumed: Column, gap_total: Column) -> tuple[Column, Column]:
    """Status and severity of one key."""
    lag = published - consumed
    mismatch = consumed > published + S.MISMATCH_SLACK
    status = (
        F.when(gap_total > 0, F.lit("MISSING"))
        .when(mismatch, F.lit("MISMATCH"))
        .when(lag == 0, F.lit("IN SYNC"))
        .when(lag > S.LAG_WARN, F.lit("LAGGING"))
        .otherwise(F.lit("OK"))
    )
    severity = (
        F.when(mismatch | (lag > S.LAG_BAD), F.lit("bad"))
        .when(lag > S.LAG_WARN, F.lit("warn"))
        .otherwise(F.lit("ok"))
    )
    return status, severity


def sequence_report(published: DataFrame, consumed: DataFrame) -> DataFrame:
    """Published against consumed sequence per key; an absent side counts as 0.

    ``published`` has (key, sequence); ``consumed`` also partition, gaps, gap_total.
    """
    zero = F.lit(0).cast("bigint")
    pub = published.select("key", F.col("sequence").alias("_p"))
    cons = consumed.select("key", F.col("sequence").alias("_c"), "partition", "gaps", "gap_total")
    joined = pub.join(cons, "key", "full_outer").select(
        "key",
        F.coalesce("_p", zero).alias("published"),
        F.coalesce("_c", zero).alias("consumed"),
        "partition",
        F.coalesce("gaps", zero).alias("gaps"),
        F.coalesce("gap_total", zero).alias("gap_total"),
    )
    status, severity = lag_status(F.col("published"), F.col("consumed"), F.col("gap_total"))
    return joined.withColumns(
        {"lag": F.col("published") - F.col("consumed"), "status": status, "severity": severity}
    )


def throughput(
    df: DataFrame, by: Sequence[str] = (), published: str = "published_us", consumed: str = "consumed_us"
) -> DataFrame:
    """Messages, publish and end-to-end seconds and rates, and mean latency in microseconds.

    Times are BIGINT microseconds.  A rate over no time is NULL.
    """
    second = F.lit(1_000_000.0)
    publish = (F.max(published) - F.min(published)) / second
    end_to_end = (F.max(consumed) - F.min(published)) / second
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("messages"),
        publish.alias("publish_seconds"),
        end_to_end.alias("end_to_end_seconds"),
        F.try_divide(n, publish).alias("publish_rate"),
        F.try_divide(n, end_to_end).alias("end_to_end_rate"),
        F.avg(F.col(consumed) - F.col(published)).alias("mean_latency_us"),
    )


def _brackets(df: DataFrame, of: Column, value: str, pcts: Sequence[int]) -> DataFrame:
    """Per group the number of values and, per percentile, bounds around its rank."""
    near = 2 / SKETCH  # a sketch is off by one part in SKETCH of the ranks at most
    grid = sorted({min(max(p / 100 + d, 0.0), 1.0) for p in pcts for d in (-near, near)})
    place = lambda p, d: grid.index(min(max(p / 100 + d, 0.0), 1.0))
    sketch = df.groupBy(of).agg(
        F.count(F.lit(1)).alias("_total"), F.percentile_approx(value, grid, SKETCH).alias("_q")
    )
    whole = F.col("_total")
    each = [
        F.struct(
            F.lit(k).alias("_k"),
            F.least(F.floor(whole * p / 100), whole - 1).alias("_rank"),
            F.col("_q")[place(p, -near)].alias("_low"),
            F.col("_q")[place(p, near)].alias("_high"),
        )
        for k, p in enumerate(pcts)
    ]
    return sketch.select("_of", F.array(*each).alias("_brackets"))


def _picked(df: DataFrame, brackets: DataFrame, value: str) -> DataFrame:
    """(_of, _k, _v): the value at each rank, NULL if it is outside its bracket."""
    joined = join_small(df, brackets, ["_of"], "inner")
    near = joined.select("_of", F.col(value).alias("_v"), F.explode("_brackets").alias("b"))
    near = near.where(F.col("_v") <= F.col("b._high"))
    # Values below a bracket are only counted, as one row for each group and percentile.
    inside = F.when(F.col("_v") >= F.col("b._low"), F.col("_v")).alias("_v")
    counted = near.groupBy("_of", "b._k", "b._rank", inside).agg(F.count(F.lit(1)).alias("_n"))
    counted = cut_lineage(counted)
    upto = ordered.running_sum(counted, "_upto", F.col("_n"), ("_of", "_k"), ("_v",))
    below = F.max(F.when(F.col("_v").isNull(), F.col("_n")))
    first = F.min(F.when(F.col("_upto") > F.col("_rank"), F.col("_v")))
    found = upto.groupBy("_of", "_k", "_rank").agg(below.alias("_below"), first.alias("_v"))
    sure = F.coalesce("_below", F.lit(0)) <= F.col("_rank")
    return found.select("_of", "_k", F.when(sure, F.col("_v")).alias("_v"))


def _ranked(df: DataFrame, value: str, pcts: Sequence[int]) -> DataFrame:
    """(_of, _k, _v) from all distinct values of the given groups, in order."""
    counted = cut_lineage(df.groupBy("_of", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    upto = ordered.running_sum(counted, "_upto", F.col("_n"), ("_of",), ("_v",))
    totals = counted.groupBy("_of").agg(F.sum("_n").alias("_total"))
    upto = join_small(upto, totals, ["_of"], "inner")
    whole = F.col("_total")
    first = []
    for k, p in enumerate(pcts):
        rank = F.least(F.floor(whole * p / 100), whole - 1)
        value_at = F.min(F.when(F.col("_upto") > rank, F.col("_v")))
        first.append(F.struct(F.lit(k).alias("_k"), value_at.alias("_v")))
    return upto.groupBy("_of").agg(F.array(*first).alias("f")).select("_of", F.inline("f"))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, pcts: Sequence[int]) -> DataFrame:
    """The element at ``floor(n * pct / 100)`` of each group, in two passes over the values.

    A quantile sketch brackets each rank.  Then values below a bracket are counted, those
    above are dropped, and only those inside, a few in ten thousand whatever their spread,
    are put in order.  A group whose rank lies outside after all is put in order as a whole.
    """
    keyed = df.select(F.struct(*(by or [F.lit(1).alias("_all")])).alias("_of"), value)
    found = cut_lineage(_picked(keyed, _brackets(keyed, F.col("_of"), value, pcts), value))
    missed = found.where(F.col("_v").isNull()).select("_of").distinct()
    if not at_most(missed, 0):
        again = _ranked(join_small(keyed, missed, ["_of"], "left_semi"), value, pcts)
        found = join_small(found, missed, ["_of"], "left_anti").unionByName(again)
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("_v")))
    result = found.groupBy(*(["_of"] if by else [])).agg(*[at(k).alias(f"p{p}") for k, p in enumerate(pcts)])
    return result.select(*[F.col(f"_of.{c}") for c in by], *[f"p{p}" for p in pcts])


def latency_percentiles(
    df: DataFrame,
    by: Sequence[str] = (),
    value: str = "latency_us",
    pcts: Sequence[int] = (50, 95, 99),
    baseline: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Floor-rank percentiles per group: the element at ``floor(n * pct / 100)``, clamped.

    NULL values do not count.  With ``baseline`` (a value of the only ``by`` column) each
    percentile also gets its ratio to that group's.
    """
    by = list(by)
    df = df.where(F.col(value).isNotNull())
    if approximate:
        result = df.groupBy(*by).agg(
            *[F.percentile_approx(value, p / 100).alias(f"p{p}") for p in pcts]
        )
    else:
        result = exact_percentiles(df, by, value, pcts)
    if baseline is None:
        return result
    (group,) = by
    result = cut_lineage(result)
    for p in pcts:
        base = result.where(F.col(group) == baseline).select(f"p{p}").scalar()
        result = result.withColumn(f"p{p}_ratio", F.try_divide(F.col(f"p{p}"), base))
    return result


def active_partitions(df: DataFrame) -> DataFrame:
    """Sorted distinct partitions per stream (at most as many as a stream may have)."""
    distinct = df.select("stream", "partition").distinct()
    return distinct.groupBy("stream").agg(
        F.array_sort(F.collect_list("partition")).alias("partitions")
    )


def lag_windows(samples: DataFrame, every: str = S.LAG_INTERVAL, ts: str = "ts") -> DataFrame:
    """Total lag per stream and tumbling window.

    Each partition counts with its last sample in the window; the observed partition
    count is the one of the stream's last sample.
    """
    return lag_of_streams(last_samples(samples, every, ts))


def last_samples(samples: DataFrame, every: str = S.LAG_INTERVAL, ts: str = "ts") -> DataFrame:
    """The last sample of each partition and window: stream, partition, _w, _lag, _count, sample_seq."""
    lag = F.col("pending") + F.col("ack_pending")
    return newest_samples(
        samples.select(
            "stream",
            "partition",
            F.window(ts, every).alias("_w"),
            lag.alias("_lag"),
            F.col("partition_count").alias("_count"),
            "sample_seq",
        )
    )


def newest_samples(parts: DataFrame) -> DataFrame:
    """One row for each partition and window of ``last_samples`` of any parts of the samples."""
    return parts.groupBy("stream", "partition", "_w").agg(
        F.max_by("_lag", "sample_seq").alias("_lag"),
        F.max_by("_count", "sample_seq").alias("_count"),
        F.max("sample_seq").alias("sample_seq"),
    )


def lag_of_streams(last: DataFrame) -> DataFrame:
    """``lag_windows`` from the rows of ``last_samples``."""
    return (
        last.groupBy("stream", "_w")
        .agg(
            F.sum("_lag").alias("lag"),
            F.max_by("_count", "sample_seq").alias("partition_count"),
            F.max("sample_seq").alias("sample_seq"),
        )
        .select(
            "stream",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("ts"),
            "sample_seq",
            "partition_count",
            "lag",
        )
    )


def status_snapshot(
    config: DataFrame,
    direct: DataFrame,
    buffered: DataFrame,
    consumers: DataFrame,
    sequences: DataFrame,
    active: DataFrame,
    piece_keys: int,
) -> DataFrame:
    """The state of each stream of ``config`` (stream, partition_count, mode), in pieces.

    ``direct`` and ``buffered`` are ``stream_info`` results, ``consumers`` a ``consumer_info``
    result, ``sequences`` a ``sequence_report`` with a stream column, ``active`` an
    ``active_partitions`` result.  ``consumer_list`` has a stream's consumers by partition, of
    which there are at most as many as partitions.  ``sequences`` maps keys to their sequences,
    ``piece_keys`` of them in order in each row; names, totals and lists are in every piece,
    and a stream without keys has one.  A NULL key counts in the totals and is in no map.
    """
    zero = F.lit(0).cast("bigint")
    info = lambda df, name: df.select(
        "stream", F.col("messages").alias(f"{name}_messages"), F.col("bytes").alias(f"{name}_bytes")
    )
    entry = F.struct("partition", "name", "delivered", "pending", "ack_pending")
    running = consumers.groupBy("stream").agg(
        F.count(F.lit(1)).alias("consumers"),
        F.sum("delivered").alias("delivered"),
        F.sum("pending").alias("pending"),
        F.sum("ack_pending").alias("ack_pending"),
        F.array_sort(F.collect_list(entry)).alias("consumer_list"),
    )
    keys = sequences.groupBy("stream").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("published").alias("published"),
        F.sum("consumed").alias("consumed"),
        F.count_if(F.col("status") == "MISMATCH").alias("mismatched_keys"),
        F.count_if(F.col("gap_total") > 0).alias("gap_keys"),
    )
    lists = {"consumer_list": running.schema["consumer_list"].dataType, "partitions": active.schema["partitions"].dataType}
    parts = [info(direct, "direct"), info(buffered, "buffer"), running, keys, active]
    joined = config
    for part in parts:
        joined = joined.join(part, "stream", "left")
    added = [c for part in parts for c in part.columns if c != "stream" and c not in lists]
    totals = joined.select(
        "stream",
        stream_names("stream").alias("names"),
        "partition_count",
        (F.col("mode") == S.MODE_BUFFER).alias("buffering"),
        *[F.coalesce(c, zero).alias(c) for c in added],
        *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in lists.items()],
    )
    fields = ("published", "consumed", "partition", "gaps", "gap_total", "lag", "status")
    row = F.struct(F.col("key"), F.struct(*[f for f in fields if f in sequences.columns]))
    numbered = ordered.number_rows(sequences.where(F.col("key").isNotNull()), "_n", ("stream",), ("key",))
    piece = F.floor((F.col("_n") - 1) / piece_keys).alias("piece")
    maps = numbered.groupBy("stream", piece).agg(F.map_from_entries(F.array_sort(F.collect_list(row))).alias("sequences"))
    whole = totals.join(maps, "stream", "left")
    empty = F.map_from_entries(F.array().cast(T.ArrayType(_entry_type(maps.schema["sequences"].dataType))))
    return whole.withColumns(
        {"piece": F.coalesce("piece", zero), "sequences": F.coalesce("sequences", empty)}
    )


def _entry_type(kind: T.MapType) -> T.StructType:
    return T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])


def ttl_state(df: DataFrame, now: Column, ttl: Column, key: str = "kv_key") -> DataFrame:
    """Latest value per key, without keys idle for ``ttl`` or longer."""
    latest = df.groupBy(key).agg(
        F.max_by("value_json", "revision").alias("value_json"), F.max("ts").alias("ts")
    )
    return latest.where(F.col("ts") > now - ttl)
