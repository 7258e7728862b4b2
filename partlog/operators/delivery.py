"""Delivery attempts: what is pending, unacknowledged, drained, due or given up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog import schema as S
from partlog.functions.keys import consumer_name
from partlog.plans.intervals import interval

MESSAGE_KEY = ("stream", "partition", "stream_seq")

TASK_ROWS = 250_000  # of a log, for a task that sorts or aggregates them

PENDING = "pending"
ACK_PENDING = "ack_pending"


def _per_message(deliveries: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per message; attempts are combined before the shuffle."""
    return deliveries.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max("attempt_ts").alias("last_attempt_ts"),
        F.bool_or("acked").alias("acked"),
    )


def _with_state(published: DataFrame, deliveries: DataFrame, ids: Sequence[str]) -> DataFrame:
    tried = _per_message(deliveries, ids)
    state = F.when(F.col("attempts").isNull(), F.lit(PENDING)).when(~F.col("acked"), F.lit(ACK_PENDING))
    return published.join(tried, list(ids), "left").withColumn("state", state)


def pending_messages(
    published: DataFrame, deliveries: DataFrame, ids: Sequence[str] = MESSAGE_KEY
) -> DataFrame:
    """Published messages never delivered (pending) or not acknowledged (ack_pending)."""
    state = _with_state(published, deliveries, ids)
    return state.where(F.col("state").isNotNull()).select(
        *published.columns, "state", F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts")
    )


def consumer_info(
    published: DataFrame,
    deliveries: DataFrame,
    ids: Sequence[str] = MESSAGE_KEY,
    consumers: DataFrame | None = None,
) -> DataFrame:
    """Per stream and partition: deliveries made, pending and ack_pending messages.

    ``consumers`` (stream, partition) lists those that exist.  Each gets a row, also one
    that has delivered nothing yet, whose whole backlog is pending, and one without
    messages; partitions without a consumer are left out.  If it is not given, those with
    a delivery are taken to be all.
    """
    state = _with_state(published, deliveries, ids)
    info = state.groupBy("stream", "partition").agg(
        F.coalesce(F.sum("attempts"), F.lit(0).cast("bigint")).alias("delivered"),
        F.count_if(F.col("state") == PENDING).alias("pending"),
        F.count_if(F.col("state") == ACK_PENDING).alias("ack_pending"),
    )
    if consumers is None:
        known = info.where("delivered > 0")
    else:
        zero = F.lit(0).cast("bigint")
        listed = consumers.select("stream", F.col("partition").cast(info.schema["partition"].dataType)).distinct()
        known = listed.join(info, ["stream", "partition"], "left").select(
            "stream", "partition", *[F.coalesce(c, zero).alias(c) for c in ("delivered", "pending", "ack_pending")]
        )
    return known.withColumn("name", consumer_name("partition"))


def total_pending(info: DataFrame) -> DataFrame:
    """Lag per stream; a missing consumer adds nothing."""
    return info.groupBy("stream").agg(
        F.sum(F.col("pending") + F.col("ack_pending")).alias("total_pending")
    )


def drained(
    published: DataFrame,
    deliveries: DataFrame,
    consumers: DataFrame,
    partitions: int | Column = S.MAX_PARTITIONS,
    ids: Sequence[str] = MESSAGE_KEY,
) -> DataFrame:
    """Per stream and partition below ``partitions``: nothing pending, nothing unacknowledged.

    ``consumers`` (stream, partition) lists those that exist, so a stalled one, which has
    delivered nothing, is not taken for one that has nothing to do.
    """
    info = consumer_info(published, deliveries, ids, consumers)
    empty = (F.col("pending") == 0) & (F.col("ack_pending") == 0)
    return info.where(F.col("partition") < partitions).select("stream", "partition", empty.alias("drained"))


def stream_drained(
    published: DataFrame,
    deliveries: DataFrame,
    consumers: DataFrame,
    partitions: int | Column = S.MAX_PARTITIONS,
    ids: Sequence[str] = MESSAGE_KEY,
) -> DataFrame:
    """The same for the whole stream."""
    each = drained(published, deliveries, consumers, partitions, ids)
    return each.groupBy("stream").agg(F.bool_and("drained").alias("drained"))


def redelivery_report(
    deliveries: DataFrame,
    now: Column,
    max_deliver: int = S.MAX_DELIVER,
    ack_wait: str = S.ACK_WAIT,
    ids: Sequence[str] = MESSAGE_KEY,
) -> DataFrame:
    """Attempts per message and what follows: acked, waiting, due, or the dead-letter reason."""
    overdue = F.col("last_attempt_ts") + interval(ack_wait) <= now
    status = (
        F.when(F.col("acked"), F.lit("acked"))
        .when(F.col("attempts") >= max_deliver, F.lit(S.REASON_MAX_DELIVERY))
        .when(overdue, F.lit("due"))
        .otherwise(F.lit("waiting"))
    )
    return _per_message(deliveries, ids).withColumn("status", status)


def idempotent_append(
    new: DataFrame, target: DataFrame, id_cols: Sequence[str], position: str = "stream_seq", rows: int | None = None
) -> DataFrame:
    """Rows of ``new`` whose id is not in ``target``, the earliest one of each id.

    With ``rows``, how many ``new`` has, tasks get about ``TASK_ROWS`` of them, however many
    there are; otherwise the session decides.
    """
    # A struct as join column finds NULL ids too.  Only ids and positions are aggregated;
    # the rows themselves are shuffled once.
    tasks = None if rows is None else max(-(-rows // TASK_ROWS), new.sparkSession.sparkContext.defaultParallelism)

    def dealt(df: DataFrame, *on: str) -> DataFrame:
        return df if tasks is None else df.repartition(tasks, *on)

    id_ = F.struct(*id_cols).alias("_id")
    first = dealt(new.select(id_, F.col(position).alias("_first")), "_id")
    first = first.groupBy("_id").agg(F.min("_first").alias("_first"))
    seen = dealt(target.select(id_), "_id").distinct()
    # By position too, so that copies of one id do not meet in a task.
    fresh = dealt(first.join(seen, "_id", "left_anti"), "_id", "_first")
    placed = dealt(new.withColumns({"_id": F.struct(*id_cols), "_first": F.col(position)}), "_id", "_first")
    return placed.join(fresh, ["_id", "_first"], "left_semi").select(*new.columns)
