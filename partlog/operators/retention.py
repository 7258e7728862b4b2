"""Limits by age and count, and purges, as filters and on stored logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlog import schema as S
from partlog.functions.keys import subject_for_partition
from partlog.plans import ordered
from partlog.plans.bounds import join_small
from partlog.plans.intervals import interval
from partlog.sources.rewrite import rewrite_log


def _within_age(df: DataFrame, max_age: str, scope: Sequence[str], ts: str, now: Column | None):
    """Rows not older than ``max_age`` before ``now``, or before the scope's newest row."""
    if now is not None:
        return df.where(F.col(ts) >= now - interval(max_age))
    newest = df.groupBy(*scope).agg(F.max(ts).alias("_newest"))
    joined = join_small(df, newest, scope, "inner")
    return joined.where(F.col(ts) >= F.col("_newest") - interval(max_age)).select(*df.columns)


def retain_newest(
    df: DataFrame,
    max_age: str = S.LOG_MAX_AGE,
    max_msgs: int = S.LOG_MAX_MESSAGES,
    scope: Sequence[str] = ("stream",),
    position: str = "stream_seq",
    ts: str = "ts",
    now: Column | None = None,
    span: int = ordered.ROW_SPAN,
) -> DataFrame:
    """Age limit, then the newest ``max_msgs`` rows per stream."""
    young = _within_age(df, max_age, scope, ts, now)
    marked = ordered.mark_first(young, "_kept", max_msgs, scope, position, span, descending=True)
    return marked.where("_kept").drop("_kept")


def retain_oldest(
    df: DataFrame,
    max_age: str = S.DEAD_LETTER_MAX_AGE,
    max_msgs: int = S.DEAD_LETTER_MAX_MESSAGES,
    scope: Sequence[str] = ("stream",),
    position: str = "stream_seq",
    ts: str = "ts",
    now: Column | None = None,
    span: int = ordered.ROW_SPAN,
) -> tuple[DataFrame, DataFrame]:
    """Age limit, then the oldest ``max_msgs`` rows per stream; later rows are rejected."""
    young = _within_age(df, max_age, scope, ts, now)
    marked = ordered.mark_first(young, "_kept", max_msgs, scope, position, span)
    return marked.where("_kept").drop("_kept"), marked.where("NOT _kept").drop("_kept")


def apply_purges(
    df: DataFrame, purges: DataFrame, subject: str = "subject", position: str = "stream_seq"
) -> DataFrame:
    """Drop rows up to the last purge of their subject or of the whole stream.

    ``purges`` has (subject, purge_seq); a NULL subject purges the whole stream.
    """
    everywhere = purges.where(F.col("subject").isNull()).agg(F.max("purge_seq").alias("s")).scalar()
    kept = df.where(F.col(position) > F.coalesce(everywhere, F.lit(-1)))
    by_subject = (
        purges.where(F.col("subject").isNotNull())
        .groupBy(F.col("subject").alias(subject))
        .agg(F.max("purge_seq").alias("_purged"))
    )
    joined = join_small(kept, by_subject, [subject], "left")
    return joined.where(F.col(position) > F.coalesce("_purged", F.lit(-1))).select(*df.columns)


def purge_log(spark: SparkSession, path: str, purges: DataFrame, prefix: str) -> int:
    """``apply_purges`` on a stored log; gives the number of files that were replaced.

    Subjects are those of the log's partitions.  Files without a purged row stay as they are.
    """

    def keep(log: DataFrame) -> DataFrame:
        named = log.withColumn("subject", subject_for_partition(prefix, "partition"))
        return apply_purges(named, purges).drop("subject")

    return rewrite_log(spark, path, keep)


def retain_log(
    spark: SparkSession,
    path: str,
    now: Column,
    max_age: str = S.LOG_MAX_AGE,
    max_msgs: int = S.LOG_MAX_MESSAGES,
    span: int = ordered.ROW_SPAN,
) -> int:
    """``retain_newest`` on a stored log of one stream; gives the number of files replaced.

    ``now`` is a fixed time, so that a run that is repeated decides alike.
    """

    def keep(log: DataFrame) -> DataFrame:
        timed = log.withColumns({"_stream": F.lit(1), "_time": F.timestamp_micros(F.expr("ts div 1000"))})
        return retain_newest(timed, max_age, max_msgs, ("_stream",), ts="_time", now=now, span=span).drop("_stream", "_time")

    return rewrite_log(spark, path, keep)
