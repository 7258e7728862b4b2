"""Which mode and partition count were in force, and where messages go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlog import schema as S
from partlog.functions.keys import partition_for_key, subject_for_partition
from partlog.plans import ordered
from partlog.plans.scratch import cut_lineage

CONFIG_ROWS = 20_000  # largest config log that is broadcast; a longer one is merged by time
NO_CONFIG = "no configuration"
BAD_COUNT = "unusable partition count"
CONFIG_SLICES = 20_000  # slices of time over a broadcast config log


def valid_config(
    log: DataFrame, count: str = "value", max_partitions: int = S.MAX_PARTITIONS
) -> DataFrame:
    """Keep rows whose count is an integer between 1 and the maximum."""
    n = F.col(count).try_cast("int")
    return log.withColumn("partition_count", n).where(
        F.col("partition_count").between(S.MIN_PARTITIONS, max_partitions)
    )


def config_history(changelog: DataFrame) -> DataFrame:
    """(revision, effective_ts, key, value) writes as mode and count after each write.

    Rows before the first valid count are left out; an unparsable or out-of-range count
    leaves the one before it in force.
    """
    mode = F.when(F.col("key") == S.KEY_MODE, F.col("value"))
    n = F.col("value").try_cast("int")
    count = F.when(
        (F.col("key") == S.KEY_PARTITION_COUNT) & n.between(S.MIN_PARTITIONS, S.MAX_PARTITIONS), n
    )
    marked = changelog.where(F.col("key").isin(S.KEY_MODE, S.KEY_PARTITION_COUNT))
    marked = marked.withColumns({"_mode": mode, "_count": count})
    filled = ordered.carry_forward(
        marked, {"mode": "_mode", "partition_count": "_count"}, (), ("revision",)
    )
    return filled.where(F.col("partition_count").isNotNull()).select(
        "revision",
        "effective_ts",
        F.coalesce("mode", F.lit(S.MODE_DIRECT)).alias("mode"),
        "partition_count",
    )


def with_next_direct(config_log: DataFrame) -> DataFrame:
    """Config rows with the replay target of each: the direct row at or after it."""
    opens = F.struct("revision", "partition_count")  # together: a count may be missing
    marked = config_log.withColumn("_opens", F.when(F.col("mode") == S.MODE_DIRECT, opens))
    filled = ordered.carry_forward(marked, {"_next": "_opens"}, (), ("revision",), descending=True)
    return filled.select(
        *config_log.columns,
        F.col("_next.revision").alias("epoch"),
        F.col("_next.partition_count").alias("epoch_count"),
    )


def _config_by_slice(
    df: DataFrame, config_log: DataFrame, columns: dict[str, str], ts: str
) -> DataFrame:
    """As-of lookup by a hash join on slices of time.

    Each config row is listed under every slice in which it is in force, so a message
    meets only the few rows of its own slice.  Slices are as wide as keeps their number
    within ``CONFIG_SLICES``.
    """
    at = ordered.as_long(config_log, "effective_ts")
    low, high = config_log.agg(F.min(at), F.max(at)).head()
    if low is None:
        types = {f.name: f.dataType for f in config_log.schema.fields}
        return df.select("*", *[F.lit(None).cast(types[c]).alias(n) for n, c in columns.items()])
    span = F.lit((high - low) // CONFIG_SLICES + 1)
    sliced = lambda t: t - F.pmod(t, span)
    # Everything after the last change shares one slice.
    last = sliced(F.lit(high)) + span
    by_time = Window.orderBy("_from", "revision")
    spans = (
        config_log.withColumn("_from", at)
        .withColumn("_to", F.lead("_from").over(by_time))
        .where(F.col("_to").isNull() | (F.col("_to") > F.col("_from")))
        .withColumn("_end", F.coalesce(sliced(F.col("_to") - 1), last))
        .select(
            F.explode(F.sequence(sliced(F.col("_from")), "_end", span)).alias("_slice"),
            "_from",
            "_to",
            *[F.col(c).alias(n) for n, c in columns.items()],
        )
    )
    t = ordered.as_long(df, ts)
    timed = df.withColumns({"_at": t, "_slice": F.least(sliced(t), last)})
    within = (
        (timed["_slice"] == spans["_slice"])
        & (F.col("_at") >= F.col("_from"))
        & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    )
    return timed.join(F.broadcast(spans), within, "left").select(*df.columns, *columns)


def config_at(
    df: DataFrame,
    config_log: DataFrame,
    columns: dict[str, str],
    ts: str = "ts",
    max_broadcast_rows: int = CONFIG_ROWS,
    span: int | None = None,
) -> DataFrame:
    """As-of lookup: add config columns in force at ``ts``; NULL before the first.

    The config log is written by operators and normally tiny.  It is read once: one of at
    most ``max_broadcast_rows`` is broadcast as slices of time; a larger one is written and
    merged into the stream by time.  Each slice of the merged stream hands one row on to the
    next, and slices are bounded by rank, so there is one short list of rows to carry through.
    """
    needed = dict.fromkeys(["revision", "effective_ts", *columns.values()])
    settings = config_log.select(*needed)
    few = settings.limit(max_broadcast_rows + 1).toArrow()
    if few.num_rows <= max_broadcast_rows:
        known = df.sparkSession.createDataFrame(few, settings.schema)
        return _config_by_slice(df, known, columns, ts)

    settings = cut_lineage(settings)
    packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    none = F.lit(None).cast("bigint")
    changes = settings.select(
        F.col("effective_ts").alias("_ts"),
        F.col("revision").cast("bigint").alias("_rev"),
        packed.alias("_config"),
    )
    rows = df.select(F.col(ts).alias("_ts"), none.alias("_rev"), F.struct(*df.columns).alias("_row"))
    merged = rows.unionByName(changes, allowMissingColumns=True)
    # Config rows sort before messages of the same time, in order of revision.  Messages of one
    # time need no order, but a burst of them must not make one slice large.
    merged = merged.withColumns(
        {"_tie": F.coalesce("_rev", F.lit((1 << 63) - 1)), "_spread": F.xxhash64("_row")}
    )
    bucket = None if span is None else "_ts"
    filled = ordered.carry_forward(
        merged, {"_now": "_config"}, (), ("_ts", "_tie", "_spread"), bucket=bucket, span=span
    )
    return filled.where(F.col("_row").isNotNull()).select("_row.*", *[f"_now.{n}" for n in columns])


def _with_route(df: DataFrame, prefix: str, key: str) -> DataFrame:
    partition = partition_for_key(key, "partition_count")
    routed = df.withColumn("partition", partition)
    direct = subject_for_partition(prefix, "partition")
    subject = F.when(F.col("mode") == S.MODE_BUFFER, F.lit(prefix + S.BUFFER_SUFFIX)).otherwise(direct)
    return routed.withColumn("subject", subject)


def route_messages(
    df: DataFrame,
    config_log: DataFrame,
    prefix: str,
    key: str = "key",
    ts: str = "ts",
    max_broadcast_rows: int = CONFIG_ROWS,
    span: int | None = None,
) -> DataFrame:
    """Add mode, partition count, partition and subject in force at publish time.

    Messages without a usable count are not among them; see ``split_routes``.
    """
    return split_routes(df, config_log, prefix, key, ts, max_broadcast_rows, span)[0]


def split_routes(
    df: DataFrame,
    config_log: DataFrame,
    prefix: str,
    key: str = "key",
    ts: str = "ts",
    max_broadcast_rows: int = CONFIG_ROWS,
    span: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(routed, rejected): every message is in one of them.

    A count is usable from 1 to the maximum.  Messages published before any config row, or
    under a count that is missing or out of range, are rejected with ``reject_reason``.
    """
    columns = {"mode": "mode", "partition_count": "partition_count"}
    known = config_at(df, config_log, columns, ts, max_broadcast_rows, span)
    n = F.col("partition_count")
    usable = F.coalesce(n.between(S.MIN_PARTITIONS, S.MAX_PARTITIONS), F.lit(False))
    why = F.when(n.isNull() & F.col("mode").isNull(), F.lit(NO_CONFIG)).otherwise(F.lit(BAD_COUNT))
    rejected = known.where(~usable).select(*df.columns, why.alias("reject_reason"))
    return _with_route(known.where(usable), prefix, key), rejected


def rejected_messages(df: DataFrame, config_log: DataFrame, ts: str = "ts") -> DataFrame:
    """Messages that ``route_messages`` leaves out, with ``reject_reason``."""
    return split_routes(df, config_log, "", ts=ts)[1]


def config_changes(snapshots: DataFrame, span: int | None = None) -> DataFrame:
    """Events where count or mode differ from the snapshot before, per stream.

    ``snapshots`` has (stream, sample_seq, partition_count, mode).
    """
    seen = ordered.previous(
        snapshots,
        {"old_count": "partition_count", "old_mode": "mode"},
        ("stream",),
        ("sample_seq",),
        span=span,
    )
    scaled = (F.col("old_count") > 0) & (F.col("old_count") != F.col("partition_count"))
    switched = F.col("old_mode") != F.col("mode")
    events = F.array_compact(
        F.array(
            F.when(
                scaled,
                F.format_string("scaled %d -> %d", F.col("old_count"), F.col("partition_count")),
            ),
            F.when(switched, F.concat(F.lit("switched to "), F.col("mode"))),
        )
    )
    return seen.select("stream", "sample_seq", F.explode(events).alias("event"))
