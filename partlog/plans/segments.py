"""Mergeable summaries of the order of a log.

A segment says of one stretch of a group's rows what a later reader needs: where it starts
and ends, and the violations, gaps and missing sequences inside.  Two segments of which one
lies before the other combine into the segment of both, since all that is new is the step
from the end of one to the start of the other.  So rows may be summed up in slices, slices in
groups and groups in a state, in any grouping that keeps their order, and no task ever holds
the rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlog.plans import ordered

COUNTS = ["received", "violations", "gaps", "missing"]
ENDS = ["first_sequence", "last_sequence", "last"]


def _step(sequence: Column, before: Column) -> list[Column]:
    """violations, gaps and missing of one step; nothing before gives none."""
    missing = F.when(sequence > before + 1, sequence - before - 1)
    zero = F.lit(0).cast("bigint")
    return [
        F.when(sequence <= before, 1).otherwise(0).cast("bigint"),
        F.when(sequence > before + 1, 1).otherwise(0).cast("bigint"),
        F.coalesce(missing.cast("bigint"), zero),
    ]


def _summed(steps: Sequence[str] = ("_v", "_g", "_m")) -> list[Column]:
    return [F.sum(c).alias(n) for c, n in zip(steps, COUNTS[1:])]


def segments(df: DataFrame, by: Sequence[str], order: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """One segment for each group ``by``; ``carried`` columns of its last row are in ``last``."""
    w = Window.partitionBy(*by).orderBy(*order)
    steps = _step(F.col("sequence"), F.lag("sequence").over(w))
    rank = ordered.as_long(df, order[0]) if len(order) == 1 else F.struct(*order)
    kept = F.struct(*carried) if carried else F.lit(None).cast("string")
    return (
        df.select(*by, "sequence", kept.alias("_c"), rank.alias("_r"), *[s.alias(n) for s, n in zip(steps, ("_v", "_g", "_m"))])
        .groupBy(*by)
        .agg(
            F.min_by("sequence", "_r").cast("bigint").alias("first_sequence"),
            F.max_by("sequence", "_r").cast("bigint").alias("last_sequence"),
            F.max_by("_c", "_r").alias("last"),
            F.count(F.lit(1)).alias("received"),
            *_summed(),
        )
    )


def merge(parts: DataFrame, scope: Sequence[str], place: str) -> DataFrame:
    """One segment for each ``scope`` from several that follow each other by ``place``."""
    w = Window.partitionBy(*scope).orderBy(place)
    steps = _step(F.col("first_sequence"), F.lag("last_sequence").over(w))
    inner = [(F.col(n) + s).alias(c) for n, s, c in zip(COUNTS[1:], steps, ("_v", "_g", "_m"))]
    return (
        parts.select(*scope, place, *ENDS, "received", *inner)
        .groupBy(*scope)
        .agg(
            F.min_by("first_sequence", place).alias("first_sequence"),
            F.max_by("last_sequence", place).alias("last_sequence"),
            F.max_by("last", place).alias("last"),
            F.sum("received").alias("received"),
            *_summed(),
        )
    )


def summarize(
    df: DataFrame,
    scope: Sequence[str],
    order: Sequence[str],
    carried: Sequence[str] = (),
    span: int | None = None,
) -> DataFrame:
    """One segment for each ``scope``; a group that is too large for a task in slices first."""
    scope = list(scope)

    def sliced(part: DataFrame) -> DataFrame:
        return merge(segments(part, [*scope, ordered.SLICE], order, carried), scope, ordered.SLICE)

    if span is not None:
        return sliced(ordered.cut(df, order[0], span))
    return ordered.by_heat(df, scope, order, lambda part: segments(part, scope, order, carried), sliced)
