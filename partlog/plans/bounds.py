"""Checks of size before something is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog.plans.scratch import cut_lineage

BROADCAST_ROWS = 100_000  # narrow rows: a few MB


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows; stops counting beyond them."""
    return df.limit(rows + 1).count() <= rows


def join_small(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equi-join with a side that is usually small, such as one row per stream.

    That side is written once, since it is mostly an aggregate of the whole log, and
    counted.  It is broadcast only within the bound; otherwise a shuffle join is left to
    adaptive execution, which splits skewed partitions.
    """
    on = list(on)
    right = cut_lineage(right)
    if at_most(right, max_rows):
        right = F.broadcast(right)
    return left.join(right, on, how)
