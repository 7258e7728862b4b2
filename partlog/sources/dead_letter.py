"""Rejected rows with the reason, as a table of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog import schema as S

REASONS = (S.REASON_UNMARSHAL, S.REASON_MAX_DELIVERY, S.REASON_REPLAY_FAILED)


def dead_letter(
    bad: DataFrame,
    reason: str,
    subject: str | Column,
    now_ns: int | Column,
    raw: str = "data",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Dead-letter rows: the raw data unchanged, with reason, subject, time and error."""
    if reason not in REASONS:
        raise ValueError(f"unknown dead-letter reason: {reason}")
    subject = F.lit(subject) if isinstance(subject, str) else subject
    now_ns = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    error = F.col("error") if "error" in bad.columns else F.lit(None)
    return bad.select(
        *keep,
        F.col(raw).cast("binary").alias("data"),
        subject.alias("original_subject"),
        F.lit(reason).alias("reason"),
        now_ns.cast("bigint").alias("ts_ns"),
        error.cast("string").alias("error"),
    )


def write_dead_letters(dead: DataFrame, path: str) -> None:
    dead.write.mode("append").parquet(path)
