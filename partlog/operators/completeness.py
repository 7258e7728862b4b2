"""What was expected against what arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog.operators.audit import position_check
from partlog.plans import ordered
from partlog.plans.bounds import BROADCAST_ROWS, at_most
from partlog.plans.scratch import cut_lineage

EXPAND_ROWS = 100_000  # sequences generated per row when expected counts are expanded


def completeness_report(expected: DataFrame, received: DataFrame, span: int | None = None) -> DataFrame:
    """Per key: expected and received counts, missing, and the first wrong position.

    ``expected`` has (key, expected).  ``missing`` is the difference of the counts and
    negative if there are extra copies.  Positions are checked only where the counts
    agree.  Keys that nobody expected are shown with ``expected`` NULL.
    """
    checked = position_check(received, span=span)
    n, got = F.col("expected"), F.coalesce("received", F.lit(0).cast("bigint"))
    same = n == got
    return expected.join(checked, "key", "full_outer").select(
        "key",
        n.cast("bigint").alias("expected"),
        got.alias("received"),
        (n - got).cast("bigint").alias("missing"),
        F.when(same, F.col("first_index")).alias("first_index"),
        F.when(same, F.col("want_sequence")).alias("want_sequence"),
        F.when(same, F.col("got_sequence")).alias("got_sequence"),
    )


def _expand(ranges: DataFrame, piece_rows: int) -> DataFrame:
    """Each number of the ranges (key, side, low, high) as ``sequence``.

    A range is first cut into pieces and the pieces are spread, so that a long one is not
    expanded by one task.
    """
    pieces = ranges.where("low <= high").select(
        "key",
        "side",
        "high",
        F.explode(F.sequence("low", "high", F.lit(piece_rows).cast("bigint"))).alias("_from"),
    )
    # A given number, because adaptive execution would merge these short rows again.
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.least(F.col("high"), F.col("_from") + (piece_rows - 1))
    spread = pieces.repartition(tasks, "key", "_from")
    return spread.select("key", F.explode(F.sequence("_from", to)).alias("sequence"), "side")


def expected_messages(expected: DataFrame, piece_rows: int = EXPAND_ROWS) -> DataFrame:
    """(key, sequence) for 1..expected per key."""
    one = F.lit(1).cast("bigint")
    high = F.col("expected").cast("bigint").alias("high")
    ranges = expected.select("key", F.lit("missing").alias("side"), one.alias("low"), high)
    return _expand(ranges, piece_rows).drop("side")


def missing_messages(
    expected: DataFrame, received: DataFrame, piece_rows: int = EXPAND_ROWS, span: int | None = None
) -> DataFrame:
    """(key, sequence, side): ``missing`` were expected only, ``unexpected`` received only.

    Only the holes between received sequences, and what is left after the last, are
    expanded, so the work follows what arrived and what is missing.  The log is read once for
    the count of large keys and once for all the rest: expected numbers are joined to it, and
    one pass in order of sequence finds holes, copies and what nobody expected.
    """
    wanted = expected.select(F.struct("key").alias("_of"), F.col("expected").cast("bigint").alias("_n"))
    wanted = cut_lineage(wanted)
    few = F.broadcast(wanted) if at_most(wanted, BROADCAST_ROWS) else wanted
    arrived = received.select(F.struct("key").alias("_of"), F.col("sequence").cast("bigint").alias("sequence"))
    known = arrived.where("sequence IS NOT NULL").join(few, "_of", "left")
    odd = F.coalesce((F.col("sequence") < 1) | (F.col("sequence") > F.col("_n")), F.lit(True))
    # The number that was expected stands behind all that arrived, and closes the last hole.
    ends = wanted.where("_n > 0").select("_of", (F.col("_n") + 1).alias("sequence"), F.lit(False).alias("_odd"))
    points = known.select("_of", "sequence", odd.alias("_odd")).unionByName(ends)
    linked = ordered.previous(points, {"_before": "sequence"}, ("_of", "_odd"), ("sequence",), span=span)
    first = F.col("_before").isNull() | (F.col("_before") < F.col("sequence"))
    low = F.coalesce("_before", F.lit(0).cast("bigint")) + 1
    ranges = linked.select(
        F.col("_of.key").alias("key"),
        F.when(F.col("_odd"), F.lit("unexpected")).otherwise(F.lit("missing")).alias("side"),
        F.when(F.col("_odd"), F.col("sequence")).otherwise(low).alias("low"),
        # A copy of an unexpected one is an empty range, as is a copy of one that was expected.
        F.when(F.col("_odd") & first, F.col("sequence")).otherwise(F.col("sequence") - 1).alias("high"),
    )
    return _expand(ranges, piece_rows)
