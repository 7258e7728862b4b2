"""Keep rows that lie at least a window after the last kept row of their group.

This is the duplicate window of a message id and the cooldown of a scaling rule.
What is kept depends on what was kept before, so it is not a ``lag``.  Two facts make
it parallel: a row that follows its predecessor by the window or more is always kept,
which cuts a group into independent sessions; and inside a session the kept rows are
a chain of "first row at least a window later" pointers.  Groups and sessions of few
rows are folded as arrays; for long sessions the chain is found by doubling the pointers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog import schema as S
from partlog.plans import ordered
from partlog.plans.bounds import at_most, join_small
from partlog.plans.intervals import micros
from partlog.plans.scratch import cut_lineage

FOLD_ROWS = 1_024  # distinct times of one group or session folded as an array


def _fold(points: DataFrame, group: Sequence[str], spacing: int) -> DataFrame:
    """Kept points of groups that are known to be small; adds (_t, _tie) to the group."""
    start = F.array().cast("array<struct<_t:bigint,_tie:bigint>>")
    last = lambda kept: F.get(kept, F.size(kept) - 1)["_t"]
    far = lambda kept, p: F.coalesce(p["_t"] - last(kept) >= spacing, F.lit(True))
    step = lambda kept, p: F.when(far(kept, p), F.concat(kept, F.array(p))).otherwise(kept)
    listed = points.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_t", "_tie"))).alias("_all"))
    return listed.select(*group, F.inline(F.aggregate("_all", start, step)))


def _chain(points: DataFrame, group: list[str], spacing: int) -> DataFrame:
    """Kept (group, _t) of long sessions by pointer doubling.

    ``points`` has distinct (group, _t, _head).  Each round doubles the length of the
    pointers, so a chain of n rows takes about log2(n) rounds.
    """
    # Next point: the first one at or after _t + window in the same session.
    probes = points.select(*group, (F.col("_t") + spacing).alias("_at"), F.col("_t").alias("_from"))
    targets = points.select(*group, F.col("_t").alias("_at"), F.col("_t").alias("_to"))
    both = probes.unionByName(targets, allowMissingColumns=True)
    both = both.withColumn("_probe", F.col("_from").isNotNull().cast("int"))
    # Read backwards in time, a probe must come after a target at the same instant.
    both = both.withColumn("_tie", -F.col("_probe"))
    nearest = ordered.carry_forward(
        both, {"_next": "_to"}, group, ("_at", "_tie"), bucket="_at", span=max(spacing // 16, 1), descending=True
    )
    jumps = cut_lineage(
        nearest.where((F.col("_probe") == 1) & F.col("_next").isNotNull()).select(
            *group, F.col("_from").alias("_t"), "_next"
        )
    )
    kept = cut_lineage(points.where("_t = _head").select(*group, "_t"))
    known = kept.count()
    while True:
        reached = kept.join(jumps, [*group, "_t"]).select(*group, F.col("_next").alias("_t"))
        kept = cut_lineage(kept.unionByName(reached).distinct())
        total = kept.count()
        if total == known:
            return kept
        known = total
        onward = jumps.select(*group, F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        jumps = cut_lineage(
            jumps.join(onward, [*group, "_next"]).select(*group, "_t", F.col("_far").alias("_next"))
        )


def _long_groups(
    points: DataFrame, scope: list[str], spacing: int, fold_rows: int
) -> DataFrame:
    """Kept (scope, _t, _tie) of groups too large to fold, session by session."""
    order = ("_t",)
    span = min(spacing, ordered.TIME_SPAN)
    seen = ordered.previous(points, {"_before": "_t"}, scope, order, span=span)
    opens = F.col("_before").isNull() | (F.col("_t") - F.col("_before") >= spacing)
    seen = seen.withColumn("_opens", F.when(opens, F.col("_t"))).drop("_before")
    points = cut_lineage(
        ordered.carry_forward(seen, {"_head": "_opens"}, scope, order, span=span).drop("_opens")
    )
    group = [*scope, "_head"]
    sizes = points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max("_t").alias("_end"))
    # A session shorter than the window keeps its first row only.
    lasting = sizes.where(F.col("_end") - F.col("_head") >= spacing)
    brief = sizes.where(F.col("_end") - F.col("_head") < spacing).select(*group)
    heads = points.where("_t = _head").join(brief, group).select(*scope, "_t", "_tie")
    small = points.join(lasting.where(F.col("_n") <= fold_rows).select(*group), group)
    kept = heads.unionByName(_fold(small, group, spacing).select(*scope, "_t", "_tie"))
    long = lasting.where(F.col("_n") > fold_rows).select(*group)
    if at_most(long, 0):
        return kept
    chained = _chain(points.join(long, group), group, spacing)
    return kept.unionByName(points.join(chained, [*group, "_t"]).select(*scope, "_t", "_tie"))


def thin_by_spacing(
    df: DataFrame,
    scope: Sequence[str],
    ts: str,
    tie: str,
    window: str,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Rows kept under the rule above.  ``tie`` is an integer, unique within the scope.

    Of rows of one group at the same time the one with the lowest ``tie`` counts.
    """
    spacing = micros(window)
    # One struct column for the scope: joins on it find NULL values too.
    timed = df.withColumns({"_scope": F.struct(*scope), "_t": ordered.as_long(df, ts)})
    scope = ["_scope"]
    points = cut_lineage(
        timed.groupBy(*scope, "_t").agg(F.min(F.col(tie).cast("bigint")).alias("_tie"))
    )
    sizes = points.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > fold_rows).select(*scope)
    if at_most(large, 0):
        kept = _fold(points, scope, spacing)
    else:
        few = join_small(points, large, scope, "left_anti")
        many = cut_lineage(join_small(points, large, scope, "left_semi"))
        kept = _fold(few, scope, spacing).unionByName(_long_groups(many, scope, spacing, fold_rows))
    rows = timed.withColumn("_tie", F.col(tie).cast("bigint"))
    return rows.join(kept.select(*scope, "_tie"), [*scope, "_tie"], "left_semi").select(*df.columns)


def dedup_window(
    df: DataFrame,
    id: str = "id",
    window: str = S.DEDUP_WINDOW,
    ts: str = "ts",
    position: str = "stream_seq",
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Drop a row if a kept row with its id lies less than the window before it."""
    return thin_by_spacing(df, [id], ts, position, window, fold_rows)


def scale_recommendations(
    lag: DataFrame,
    high: int = S.LAG_HIGH_WATER,
    low: int = S.LAG_LOW_WATER,
    min_partitions: int = S.DEFAULT_MIN_PARTITIONS,
    max_partitions: int = S.DEFAULT_MAX_PARTITIONS,
    cooldown: str = S.COOLDOWN,
    ts: str = "ts",
    position: str = "sample_seq",
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """One step up above the high mark, one down below the low mark, with a cooldown.

    ``lag`` has (stream, ts, sample_seq, partition_count, lag); the count is the one
    observed, so recommendations are not fed back into it.
    """
    count, pending = F.col("partition_count"), F.col("lag")
    step = F.when((pending > high) & (count < max_partitions), F.lit(1)).when(
        (pending < low) & (count > min_partitions), F.lit(-1)
    )
    asked = lag.withColumn("step", step).where(F.col("step").isNotNull())
    kept = thin_by_spacing(asked, ["stream"], ts, position, cooldown, fold_rows)
    return kept.withColumn("desired", F.col("partition_count") + F.col("step"))
