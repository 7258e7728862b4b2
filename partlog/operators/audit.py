"""Order audit of delivered messages: violations, gaps, duplicates, runs, positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlog.functions.keys import _col
from partlog.plans import ordered, segments

RUN_SCOPE = ("run", "partition", "key")
PIECE_ROWS = 10_000  # elements of one emitted list; longer ones continue in the next piece


def judge(df: DataFrame) -> DataFrame:
    """Add ``status`` and ``missing`` from ``prev_sequence`` and ``sequence``."""
    previous, sequence = F.col("prev_sequence"), F.col("sequence")
    status = (
        F.when(previous.isNull(), F.lit("ok"))
        .when(sequence <= previous, F.lit("violation"))
        .when(sequence > previous + 1, F.lit("gap"))
        .otherwise(F.lit("ok"))
    )
    missing = F.when(sequence > previous + 1, sequence - previous - 1)
    return df.withColumns({"status": status, "missing": F.coalesce(missing, F.lit(0).cast("bigint"))})


def ordering_audit(
    df: DataFrame,
    scope: Sequence[str] = RUN_SCOPE,
    order: Sequence[str] = ("arrival",),
    span: int | None = None,
) -> DataFrame:
    """Compare each message with the previous arrival in its scope.

    Adds ``prev_sequence``, ``status`` (violation, gap, ok) and ``missing``.  The
    comparison is with the previous arrival, not with the highest sequence so far.
    """
    return judge(ordered.previous(df, {"prev_sequence": "sequence"}, scope, order, span=span))


def _counters() -> list[Column]:
    return [
        F.count_if(F.col("status") == "violation").alias("violations"),
        F.count_if(F.col("status") == "gap").alias("gaps"),
        F.coalesce(F.sum("missing"), F.lit(0).cast("bigint")).alias("missing"),
    ]


def ordering_summary(audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return audit.groupBy(*by).agg(F.count(F.lit(1)).alias("received"), *_counters())


def violations_by_key(audit: DataFrame) -> DataFrame:
    """Per-key counters of the keys that have any finding."""
    counted = audit.groupBy("key").agg(*_counters())
    return counted.where((F.col("violations") > 0) | (F.col("gaps") > 0))


def account_sequences(
    df: DataFrame, order: Sequence[str] = ("arrival",), span: int | None = None
) -> DataFrame:
    """Per key over all runs and partitions: last arrived sequence, gaps and gap total.

    Violations do not count here, and the last sequence may be lower than earlier ones.
    """
    found = segments.summarize(df, ("key",), order, ("partition",), span)
    return found.select(
        "key",
        F.col("last_sequence").alias("sequence"),
        "last.partition",
        "gaps",
        F.col("missing").alias("gap_total"),
    )


def consumer_results(
    df: DataFrame,
    with_messages: bool = False,
    order: Sequence[str] = ("arrival",),
    piece_rows: int = PIECE_ROWS,
    span: int | None = None,
) -> DataFrame:
    """Messages received per consumer run and partition.

    ``received`` is always the total.  With messages, the list comes in pieces of at most
    ``piece_rows`` messages in ``order``, one row per piece.  The first order column
    should be (nearly) unique within the partition, as a log position is.
    """
    totals = df.groupBy("run", "partition").agg(F.count(F.lit(1)).alias("received"))
    if not with_messages:
        return totals
    totals = totals.select(F.struct("run", "partition").alias("_of"), "received")
    fields = ("key", "sequence", "payload")
    numbered = ordered.number_rows(df, "_pos", ("run", "partition"), order, span=span)
    piece = F.floor((F.col("_pos") - 1) / piece_rows).alias("piece")
    in_order = F.array_sort(F.collect_list(F.struct("_pos", *fields)))
    return (
        numbered.groupBy("run", "partition", piece)
        .agg(in_order.alias("_m"))
        .withColumn("_of", F.struct("run", "partition"))
        .join(totals, "_of")
        .select(
            "run",
            "partition",
            "piece",
            "received",
            F.transform("_m", lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("messages"),
        )
    )


def duplicates(df: DataFrame) -> DataFrame:
    """(key, sequence) pairs that arrived more than once, with the number of extra copies."""
    return (
        df.groupBy("key", "sequence")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .withColumn("extra", F.col("copies") - 1)
    )


def position_check(df: DataFrame, span: int | None = None) -> DataFrame:
    """Per key, whether the sorted sequences are exactly 1..n, and the first mismatch.

    ``first_index`` is the 0-based position at which ``got_sequence`` was found
    instead of ``want_sequence``; all three are NULL for a key without mismatch.
    """
    counted = df.groupBy("key", "sequence").agg(F.count(F.lit(1)).alias("_n"))
    upto = ordered.running_sum(counted, "_upto", F.col("_n"), ("key",), ("sequence",), span=span)
    before = F.col("_upto") - F.col("_n")
    # The first copy is off its position, or it is right and the second copy is not.
    index = F.when(F.col("sequence") != before + 1, before).when(F.col("_n") > 1, before + 1)
    return (
        upto.withColumn("_index", index)
        .groupBy("key")
        .agg(
            F.sum("_n").alias("received"),
            F.min("_index").alias("first_index"),
            F.min_by("sequence", "_index").alias("got_sequence"),
        )
        .select(
            "key",
            "received",
            "first_index",
            (F.col("first_index") + 1).alias("want_sequence"),
            "got_sequence",
            F.col("first_index").isNull().alias("complete"),
        )
    )


def sequence_runs(
    df: DataFrame,
    scope: Sequence[str] = ("key",),
    order: Sequence[str] = ("arrival",),
    span: int | None = None,
) -> DataFrame:
    """Maximal runs of consecutive sequences in arrival order, one row per run."""
    starts = F.when(F.col("sequence") == F.col("_prev") + 1, 0).otherwise(1)

    def plain(part: DataFrame) -> DataFrame:
        by = Window.partitionBy(*scope).orderBy(*order)
        seen = part.withColumn("_prev", F.lag("sequence").over(by))
        upto = by.rowsBetween(Window.unboundedPreceding, 0)
        return seen.withColumn("_starts", starts).withColumn("run_no", F.sum("_starts").over(upto)).drop("_starts")

    def sliced(part: DataFrame, span: int | str | None = ordered.RANKED) -> DataFrame:
        seen = ordered.previous(part, {"_prev": "sequence"}, scope, order, span=span)
        return ordered.running_sum(seen, "run_no", starts, scope, order, span=span)

    if span is None and scope:
        numbered = ordered.by_heat(df, scope, order, plain, sliced)
    else:
        numbered = sliced(df, span)
    # Inside a run the sequence rises by one, so its ends are its extremes.
    return numbered.groupBy(*scope, "run_no").agg(
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
    )


def summarize_sequences(
    df: DataFrame,
    scope: Sequence[str] = ("key",),
    order: Sequence[str] = ("arrival",),
    runs_per_piece: int = PIECE_ROWS,
    span: int | None = None,
) -> DataFrame:
    """Runs as text such as ``1-4, 50-52, 10-12``.

    One row per scope and piece of at most ``runs_per_piece`` runs.
    """
    first, last = F.col("first_sequence"), F.col("last_sequence")
    text = F.when(first == last, first.cast("string")).otherwise(
        F.concat_ws("-", first.cast("string"), last.cast("string"))
    )
    runs = sequence_runs(df, scope, order, span).withColumn("_text", text)
    piece = F.floor((F.col("run_no") - 1) / runs_per_piece).alias("piece")
    in_order = F.array_sort(F.collect_list(F.struct("run_no", "_text")))
    joined = F.array_join(F.transform(in_order, lambda r: r["_text"]), ", ")
    return runs.groupBy(*scope, piece).agg(joined.alias("summary"))


def summarize_list(sequences: Column | str) -> Column:
    """The same text for an array column; an empty array gives ``[]``."""
    seqs = _col(sequences)
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")
    new_run = lambda s: F.struct(s.cast("bigint").alias("first"), s.cast("bigint").alias("last"))

    def extend(runs: Column, s: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        longer = F.struct(last["first"].alias("first"), s.cast("bigint").alias("last"))
        kept = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))
        consecutive = F.coalesce(s == last["last"] + 1, F.lit(False))
        return F.when(consecutive, F.concat(kept, F.array(longer))).otherwise(
            F.concat(runs, F.array(new_run(s)))
        )

    text = lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(
        F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))
    )
    runs = F.aggregate(seqs, empty, extend)
    return F.when(F.size(seqs) == 0, F.lit("[]")).otherwise(
        F.array_join(F.transform(runs, text), ", ")
    )


def assign_sequence(df: DataFrame, order: Sequence[str], span: int | None = None) -> DataFrame:
    """Number the messages of each key from 1."""
    return ordered.number_rows(df, "sequence", ("key",), order, span=span)


def publish_order_check(
    df: DataFrame, order: Sequence[str] = ("ts", "arrival"), span: int | None = None
) -> DataFrame:
    """Audit in publish-time order, with duplicate copies, as one summary row.

    Sorting by publish time first means that late delivery alone is never reported.
    """
    audit = ordering_audit(df, scope=("key",), order=order, span=span)
    totals = audit.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("status") == "violation").alias("violations"),
    )
    extra = duplicates(df).agg(F.coalesce(F.sum("extra"), F.lit(0).cast("bigint")).alias("duplicates"))
    return totals.select("received", "violations", extra.scalar().alias("duplicates"))


def violation_examples(
    audit: DataFrame, k: int = 10, order: Sequence[str] = ("partition", "key", "arrival")
) -> DataFrame:
    """The first ``k`` places where a sequence is lower than the one before it.

    Equal sequences are duplicates and not shown here.
    """
    return (
        audit.where(F.col("sequence") < F.col("prev_sequence"))
        .select(*order, "prev_sequence", "sequence")
        .orderBy(*order)
        .limit(k)
    )


def sequence_lists(
    df: DataFrame,
    scope: Sequence[str] = ("partition", "key"),
    order: Sequence[str] = ("arrival",),
    piece_rows: int = PIECE_ROWS,
    span: int | None = None,
) -> DataFrame:
    """Sequences in arrival order, as lists of at most ``piece_rows`` elements per row."""
    numbered = ordered.number_rows(df, "_pos", scope, order, span=span)
    piece = F.floor((F.col("_pos") - 1) / piece_rows).alias("piece")
    in_order = F.array_sort(F.collect_list(F.struct("_pos", "sequence")))
    return numbered.groupBy(*scope, piece).agg(
        F.transform(in_order, lambda r: r["sequence"]).alias("sequences")
    )
