"""Ordered (window-style) computations that survive a hot group.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key into one
task.  That is fine for groups of at most ``HOT_ROWS`` rows, which are counted first
(map-side combined) and take the plain window: one read, one shuffle.  A larger group is
cut into slices of its order column, so that the shuffle is on (scope, slice); what a
slice needs from the slices before it is one summary row per slice, computed with
map-side aggregation, chained over the few slices of a scope, and joined back on (scope,
slice), which reuses the big side's partitioning.  Both ways give the same rows.

A given ``span`` cuts every group.  An empty scope is one group.  Without a span, slices
are bounded by rank, about four for each ``HOT_ROWS`` rows of a hot group, whatever the
unit and spread of the order columns.  Counting is a job of its own, run when an operator
is called, and so is writing the rows if there is a hot group.

``bucket`` names the order column that is cut (default: the first).  Order columns
before it become part of the slice key as they are; columns after it only break
ties.  If the bucket column is a unique integer, a slice holds at most ``span``
rows.  Scope columns may be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_SPAN = 1 << 20  # positions per slice of an integer order column
TIME_SPAN = 3_600_000_000  # microseconds per slice of a timestamp order column

HOT_ROWS = 1 << 20  # larger groups are sliced
MOST_SLICES = 20_000  # of all groups together
SAMPLES = 256  # rows behind each bound of a slice
RANKED = "ranked"  # as a span: ``rank_slices`` has been there

SLICE = _SLICE = "_slice"
_OF, _AT, _HOT = "_of", "_at", "_hot"
_ALL = ["_all"]  # the scope of a table without groups
_GROUP = "_group"  # scope and slice as one column, so that joins find NULL values too


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))


def as_long(df: DataFrame, name: str) -> Column:
    """Order column as BIGINT; timestamps as microseconds."""
    if is_time(df, name):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("bigint")


def cut(df: DataFrame, bucket: str, span: int) -> DataFrame:
    """Add ``_slice``: ranges of ``span`` of one order column."""
    position = as_long(df, bucket)
    return df.withColumn(_SLICE, position - F.pmod(position, F.lit(span)))


class _Sliced:
    """A DataFrame with its slice columns, windows and summary ordering."""

    def __init__(self, df, scope, order, bucket, span, descending=False):
        self.columns = df.columns
        self.scope = list(scope)
        if span == RANKED:  # the slice is there already, and counts through the whole order
            self.slices, self.df = [_SLICE], df
        else:
            bucket = bucket or order[0]
            self.slices = [*order[: order.index(bucket)], _SLICE]
            self.df = cut(df, bucket, span)
        names = list(dict.fromkeys([*self.scope, *self.slices]))
        self.df = self.df.withColumn(_GROUP, F.struct(*names))
        self.group = [_GROUP]
        self.descending = descending
        self.window = Window.partitionBy(*self.group).orderBy(*map(self._sorted, order))
        # A single long keeps max_by/min_by in a hash aggregate.
        self.rank = as_long(df, order[0]) if len(order) == 1 else F.struct(*order)

    def _sorted(self, name: str) -> Column:
        return F.desc(name) if self.descending else F.asc(name)

    def last(self, value: Column) -> Column:
        return (F.min_by if self.descending else F.max_by)(value, self.rank)

    def attach(self, local: DataFrame, carries: dict[str, Column], summary: DataFrame) -> DataFrame:
        """Join per-slice carry-ins, computed over the slices of each scope."""
        inner = lambda name: f"{_GROUP}.{name}"
        chain = Window.partitionBy(*map(inner, self.scope)).orderBy(*[self._sorted(inner(n)) for n in self.slices])
        chain = chain.rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.select(*self.group, *[c.over(chain).alias(n) for n, c in carries.items()])
        known = F.coalesce(*[F.col(n).isNotNull() for n in carries])
        for name in list(carries)[1:]:
            known = known | F.col(name).isNotNull()
        return local.join(carry.where(known), self.group, "left")


def _sizes(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    return df.select(F.struct(*scope).alias(_OF)).groupBy(_OF).agg(F.count(F.lit(1)).alias("_n"))


def by_heat(
    df: DataFrame,
    scope: Sequence[str],
    order: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    sliced: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``plain`` for groups that fit into a task, ``sliced`` for the others, cut by rank.

    ``sliced`` gets a column ``_slice`` and works with ``span=RANKED``; if it keeps that
    column, it is dropped at the end.  Without a large group, one count over the scope columns
    is all that comes before ``plain``.  With one, ``df`` is evaluated once more, and written:
    its parts, the sample behind the slices and the summaries read what was written.
    """
    from partlog.plans.bounds import BROADCAST_ROWS
    from partlog.plans.scratch import scratch_path

    hot = _sizes(df, scope).where(F.col("_n") > HOT_ROWS)
    found = hot.limit(BROADCAST_ROWS + 1).toArrow()  # one row for each large group
    if not found.num_rows:
        return plain(df)
    if found.num_rows <= BROADCAST_ROWS:
        rows = sum(found.column("_n").to_pylist())
        few = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))
    else:
        rows, few = hot.agg(F.sum("_n")).head()[0], hot
    marked = df.withColumn(_OF, F.struct(*scope)).join(few, _OF, "left")
    path = scratch_path(df.sparkSession, "by-heat")
    parted = marked.withColumn(_HOT, F.col("_n").isNotNull())
    parted.drop(_OF, "_n").write.partitionBy(_HOT).parquet(path)
    fields = [*df.schema.fields, T.StructField(_HOT, T.BooleanType())]
    held = df.sparkSession.read.schema(T.StructType(fields)).parquet(path)
    small = plain(held.where(~F.col(_HOT)).drop(_HOT))
    large = sliced(rank_slices(held.where(_HOT).drop(_HOT), rows, scope, order))
    return small.unionByName(large.select(*small.columns))


def rank_slices(df: DataFrame, rows: int, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_slice``: slices of each group with about as many rows each, rising in ``order``.

    Bounds are ranks of a sample, whole tuples of the order columns, so neither an outlier
    nor a burst at one value makes a slice large; only rows that tie in all order columns
    stay together.  The sample is drawn by a hash of those columns, ``SAMPLES`` rows for each
    slice, which keeps slices below twice their mean size.  There are at most ``MOST_SLICES``
    of them whatever the size of the log, so bounds may be broadcast.  A row finds its slice
    among the coarse bounds of its group first, and then among the fine ones below it.
    """
    from partlog.plans.scratch import cut_lineage

    size = max(HOT_ROWS // 4, -(-rows // MOST_SLICES))
    rate = max(1, size // SAMPLES)
    step = max(1, size // rate)
    at = F.struct(*order).alias(_AT)
    drawn = df.where(F.pmod(F.xxhash64(*scope, *order), F.lit(rate)) == 0)
    by_rank = Window.partitionBy(_OF).orderBy(_AT)
    ranked = drawn.select(F.struct(*scope).alias(_OF), at).withColumn("_k", F.row_number().over(by_rank) - 1)
    bounds = ranked.where((F.col("_k") % step == 0) & (F.col("_k") > 0)).select(_OF, _AT).distinct()
    bounds = bounds.withColumn(_SLICE, F.row_number().over(by_rank))
    bounds = cut_lineage(bounds)
    coarse_step = max(1, int(MOST_SLICES**0.5))
    coarse = bounds.where(F.col(_SLICE) % coarse_step == 0)
    marked = _below(df.withColumn(_OF, F.struct(*scope)).withColumn(_AT, at), coarse, [_OF], "_coarse")
    marked = marked.withColumn("_coarse", F.floor(F.col("_coarse") / coarse_step))
    fine = bounds.withColumn("_coarse", F.floor(F.col(_SLICE) / coarse_step))
    found = _below(marked, fine, [_OF, "_coarse"], "_fine")
    least = F.col("_coarse") * coarse_step
    return found.select(*df.columns, F.greatest(F.coalesce("_fine", F.lit(0)), least).cast("bigint").alias(_SLICE))


def _below(df: DataFrame, bounds: DataFrame, on: list[str], name: str) -> DataFrame:
    """Add the number of the last of ``bounds`` that is not above a row; 0 before the first."""
    next_ = F.lead(_AT).over(Window.partitionBy(*on).orderBy(_AT))
    low = bounds.select(*[F.col(c).alias(f"_b{c}") for c in on], F.col(_AT).alias("_low"), next_.alias("_next"), F.col(_SLICE).alias(name))
    inside = (F.col(_AT) >= F.col("_low")) & (F.col("_next").isNull() | (F.col(_AT) < F.col("_next")))
    for c in on:
        inside = inside & (F.col(c) == F.col(f"_b{c}"))
    found = df.join(F.broadcast(low), inside, "left").drop(*[f"_b{c}" for c in on], "_low", "_next")
    return found.withColumn(name, F.coalesce(name, F.lit(0)))


def _window(df: DataFrame, scope: Sequence[str], order: Sequence[str], descending: bool = False):
    direction = F.desc if descending else F.asc
    return Window.partitionBy(*scope).orderBy(*map(direction, order))


def previous(
    df: DataFrame,
    values: dict[str, str],
    scope: Sequence[str],
    order: Sequence[str],
    bucket: str | None = None,
    span: int | Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add, per ``{new: source}``, the source value of the row before (``lag``).

    Sources must not be NULL.
    """
    if span is None and not scope:
        part = df.withColumn("_all", F.lit(1))
        return previous(part, values, _ALL, order, bucket, None, descending).drop(*_ALL)
    if span is None:
        w = _window(df, scope, order, descending)
        return by_heat(
            df,
            scope,
            order,
            lambda part: part.select("*", *[F.lag(c).over(w).alias(n) for n, c in values.items()]),
            lambda part: previous(part, values, scope, order, bucket, RANKED, descending),
        )
    s = _Sliced(df, scope, order, bucket, span, descending)
    local = s.df.select("*", *[F.lag(c).over(s.window).alias(n) for n, c in values.items()])
    summary = s.df.groupBy(*s.group).agg(*[s.last(F.col(c)).alias(f"_t_{n}") for n, c in values.items()])
    joined = s.attach(local, {f"_c_{n}": F.last(f"_t_{n}") for n in values}, summary)
    return joined.select(*s.columns, *[F.coalesce(n, f"_c_{n}").alias(n) for n in values])


def carry_forward(
    df: DataFrame,
    values: dict[str, str],
    scope: Sequence[str],
    order: Sequence[str],
    bucket: str | None = None,
    span: int | Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add, per ``{new: source}``, the last non-NULL source value up to this row."""
    if span is None and not scope:
        part = df.withColumn("_all", F.lit(1))
        return carry_forward(part, values, _ALL, order, bucket, None, descending).drop(*_ALL)
    if span is None:
        w = _window(df, scope, order, descending).rowsBetween(Window.unboundedPreceding, 0)
        newest = lambda c: F.last(c, ignorenulls=True).over(w)
        return by_heat(
            df,
            scope,
            order,
            lambda part: part.select("*", *[newest(c).alias(n) for n, c in values.items()]),
            lambda part: carry_forward(part, values, scope, order, bucket, RANKED, descending),
        )
    s = _Sliced(df, scope, order, bucket, span, descending)
    upto = s.window.rowsBetween(Window.unboundedPreceding, 0)
    local = s.df.select(
        "*", *[F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in values.items()]
    )
    summary = s.df.groupBy(*s.group).agg(
        *[
            (F.min_by if descending else F.max_by)(
                F.col(c), F.when(F.col(c).isNotNull(), s.rank)
            ).alias(f"_t_{n}")
            for n, c in values.items()
        ]
    )
    joined = s.attach(local, {f"_c_{n}": F.last(f"_t_{n}", ignorenulls=True) for n in values}, summary)
    return joined.select(*s.columns, *[F.coalesce(n, f"_c_{n}").alias(n) for n in values])


def running_sum(
    df: DataFrame,
    out: str,
    value: Column,
    scope: Sequence[str],
    order: Sequence[str],
    bucket: str | None = None,
    span: int | Column | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over the rows up to and including this one."""
    if span is None and not scope:
        part = df.withColumn("_all", F.lit(1))
        return running_sum(part, out, value, _ALL, order, bucket).drop(*_ALL)
    if span is None:
        w = _window(df, scope, order).rowsBetween(Window.unboundedPreceding, 0)
        return by_heat(
            df,
            scope,
            order,
            lambda part: part.withColumn("_amount", value).withColumn(out, F.sum("_amount").over(w)).drop("_amount"),
            lambda part: running_sum(part, out, value, scope, order, bucket, RANKED),
        )
    s = _Sliced(df.withColumn("_amount", value), scope, order, bucket, span)
    upto = s.window.rowsBetween(Window.unboundedPreceding, 0)
    local = s.df.withColumn("_local", F.sum("_amount").over(upto))
    summary = s.df.groupBy(*s.group).agg(F.sum("_amount").alias("_t"))
    joined = s.attach(local, {"_before": F.sum("_t")}, summary)
    total = F.col("_local") + F.coalesce("_before", F.lit(0))
    return joined.select(*df.columns, total.alias(out))


def number_rows(
    df: DataFrame,
    out: str,
    scope: Sequence[str],
    order: Sequence[str],
    bucket: str | None = None,
    span: int | Column | None = None,
) -> DataFrame:
    """Add a 1-based row number per scope (``row_number``)."""
    if span is None and not scope:
        part = df.withColumn("_all", F.lit(1))
        return number_rows(part, out, _ALL, order, bucket).drop(*_ALL)
    if span is None:
        number = F.row_number().over(_window(df, scope, order)).cast("bigint")
        return by_heat(
            df,
            scope,
            order,
            lambda part: part.withColumn(out, number),
            lambda part: number_rows(part, out, scope, order, bucket, RANKED),
        )
    s = _Sliced(df, scope, order, bucket, span)
    local = s.df.withColumn("_local", F.row_number().over(s.window))
    summary = s.df.groupBy(*s.group).agg(F.count(F.lit(1)).alias("_t"))
    joined = s.attach(local, {"_before": F.sum("_t")}, summary)
    number = F.col("_local").cast("bigint") + F.coalesce("_before", F.lit(0))
    return joined.select(*df.columns, number.alias(out))


def mark_first(
    df: DataFrame,
    out: str,
    limit: int,
    scope: Sequence[str],
    position: str,
    span: int = ROW_SPAN,
    descending: bool = False,
) -> DataFrame:
    """Flag the first ``limit`` rows per scope by a unique integer ``position``.

    Only the slice in which the limit falls is ranked; all other rows are decided by
    comparing their slice with one cut-off row per scope, so the log is not shuffled.
    """
    from partlog.plans.bounds import join_small

    s = _Sliced(df, scope, [position], None, span, descending)
    chain = Window.partitionBy(*s.scope).orderBy(s._sorted(_SLICE))
    sizes = s.df.groupBy(*s.scope, _SLICE).agg(F.count(F.lit(1)).alias("_n"))
    upto = sizes.withColumn("_upto", F.sum("_n").over(chain))
    # First slice at which the running count passes the limit, and the room left in it.
    over = F.col("_upto") > limit
    first = F.max if descending else F.min
    cut = upto.where(over).groupBy(*s.scope).agg(
        first(_SLICE).alias("_cut"),
        (F.lit(limit) - F.min(F.col("_upto") - F.col("_n"))).alias("_room"),
    )
    marked = join_small(s.df, cut, s.scope, "left")
    before = F.col(_SLICE) > F.col("_cut") if descending else F.col(_SLICE) < F.col("_cut")
    decided = marked.where(F.col("_cut").isNull() | (F.col(_SLICE) != F.col("_cut")))
    decided = decided.select(*df.columns, F.coalesce(before, F.lit(True)).alias(out))
    ranked = marked.where(F.col(_SLICE) == F.col("_cut"))
    ranked = ranked.select(*df.columns, (F.row_number().over(s.window) <= F.col("_room")).alias(out))
    return decided.unionByName(ranked)
