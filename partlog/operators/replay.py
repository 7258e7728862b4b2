"""Repartitioning a log and replaying what was buffered meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog import schema as S
from partlog.functions.codec import decode_messages
from partlog.functions.keys import partition_for_key, replay_id, subject_for_partition
from partlog.operators.delivery import idempotent_append
from partlog.operators.routing import BAD_COUNT, CONFIG_ROWS, NO_CONFIG, config_at, with_next_direct
from partlog.plans import ordered
from partlog.plans.scratch import scratch_path, stored
from partlog.sources.dead_letter import dead_letter
from partlog.sources.log import read_log, write_log

PHASE_REPLAY = 0
PHASE_DIRECT = 1


def check_count(n: int) -> int:
    if not S.MIN_PARTITIONS <= n <= S.MAX_PARTITIONS:
        raise ValueError(f"partition count must be {S.MIN_PARTITIONS}..{S.MAX_PARTITIONS}, got {n}")
    return n


def split_plan(
    df: DataFrame,
    config_log: DataFrame,
    prefix: str,
    key: str = "key",
    ts: str = "ts",
    max_broadcast_rows: int = CONFIG_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(planned, unplanned): every message is in one of them.

    Messages published before the first config row, or whose epoch has a count that is missing
    or not from 1 to the maximum, are unplanned, with ``reject_reason``.
    """
    columns = {"mode": "mode", "epoch": "epoch", "epoch_count": "epoch_count"}
    known = config_at(df, with_next_direct(config_log), columns, ts, max_broadcast_rows)
    has_epoch = F.col("epoch").isNotNull()
    usable = F.coalesce(F.col("epoch_count").between(S.MIN_PARTITIONS, S.MAX_PARTITIONS), F.lit(False))
    why = F.when(F.col("mode").isNull(), F.lit(NO_CONFIG)).when(has_epoch & ~usable, F.lit(BAD_COUNT))
    unplanned = known.select(*df.columns, why.alias("reject_reason")).where(F.col("reject_reason").isNotNull())
    phase = F.when(F.col("mode") == S.MODE_BUFFER, PHASE_REPLAY).otherwise(PHASE_DIRECT)
    partition = F.when(has_epoch, partition_for_key(key, "epoch_count"))
    planned = known.where(why.isNull()).withColumns({"phase": phase, "partition": partition})
    subject = F.when(has_epoch, subject_for_partition(prefix, "partition"))
    return planned.drop("mode", "epoch_count").withColumn("subject", subject), unplanned


def unplanned_messages(
    df: DataFrame, config_log: DataFrame, ts: str = "ts", max_broadcast_rows: int = CONFIG_ROWS
) -> DataFrame:
    """Messages that ``replay_plan`` leaves out, with ``reject_reason``."""
    return split_plan(df, config_log, "", ts=ts, max_broadcast_rows=max_broadcast_rows)[1]


def replay_plan(
    df: DataFrame,
    config_log: DataFrame,
    prefix: str,
    key: str = "key",
    ts: str = "ts",
    max_broadcast_rows: int = CONFIG_ROWS,
) -> DataFrame:
    """Give each message its epoch, phase, partition and subject.

    An epoch is named by the revision of the direct-mode config row that opens it.
    Messages published while buffering belong to the next epoch, before its direct
    messages and under its count.  While no next epoch exists, epoch, partition and
    subject are NULL.  Messages without a usable configuration are in ``unplanned_messages``.
    """
    return split_plan(df, config_log, prefix, key, ts, max_broadcast_rows)[0]


def delivery_order(df: DataFrame, span: int = ordered.ROW_SPAN) -> DataFrame:
    """Add ``position`` within the partition: by epoch, replay before direct, log order."""
    return ordered.number_rows(
        df, "position", ("partition",), ("epoch", "phase", "stream_seq"), bucket="stream_seq", span=span
    )


def sort_for_delivery(df: DataFrame) -> DataFrame:
    """The same order as a physical layout, one contiguous range of a partition per task."""
    order = ("partition", "epoch", "phase", "stream_seq")
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def union_logs(direct: DataFrame, buffered: DataFrame) -> DataFrame:
    """One log from direct and replayed rows; both carry ``epoch``."""
    return direct.withColumn("phase", F.lit(PHASE_DIRECT)).unionByName(
        buffered.withColumn("phase", F.lit(PHASE_REPLAY)), allowMissingColumns=True
    )


def rekey_buffer(
    buffer: DataFrame, new_count: int, prefix: str, raw: str = "data", path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(decoded rows with partition under ``new_count``, subject and id; rejected rows).

    Decoding costs more than all the rest, so its result is written to the folder ``path``
    (default: a new one in the shared folder) and read from there.
    """
    check_count(new_count)
    path = path or scratch_path(buffer.sparkSession, "decoded")
    good, bad = decode_messages(buffer, raw, lambda df: stored(df, path))
    keyed = good.withColumn("partition", partition_for_key("key", new_count))
    named = {"subject": subject_for_partition(prefix, "partition"), "id": replay_id("key", "sequence")}
    return keyed.withColumns(named), bad


def replay_buffer(
    buffer: DataFrame,
    new_count: int,
    prefix: str,
    target: DataFrame | None = None,
    raw: str = "data",
    extra_id: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Decode and re-key buffered raw rows; returns (replayed, rejected).

    ``buffer`` has (stream_seq, raw).  Replayed rows get their partition under
    ``new_count``, subject and ``id``; of equal ids the first is kept, and ids already in
    ``target`` are left out.  ``extra_id`` columns tell apart producer restarts that
    count from 1 again.  Rejected rows never stop the replay.
    """
    keyed, bad = rekey_buffer(buffer, new_count, prefix, raw)
    seen = target if target is not None else keyed.limit(0)
    return idempotent_append(keyed, seen, ["id", *extra_id], rows=keyed.count()), bad


def reject_buffer(bad: DataFrame, subject: str, now_ns) -> DataFrame:
    return dead_letter(bad, S.REASON_UNMARSHAL, subject, now_ns)


def replay_summary(replayed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Replayed and dead-lettered rows per epoch and partition (NULL for rejects)."""
    outcome = lambda df, name: df.select(
        "epoch",
        (F.col("partition") if "partition" in df.columns else F.lit(None)).cast("int").alias("partition"),
        F.lit(name).alias("outcome"),
    )
    both = outcome(replayed, "replayed").unionByName(outcome(rejected, "dead_lettered"))
    return both.groupBy("epoch", "partition", "outcome").agg(F.count(F.lit(1)).alias("messages"))


def rekey(df: DataFrame, n: int) -> DataFrame:
    """The log's rows under ``n`` partitions."""
    return df.withColumn("partition", partition_for_key("key", check_count(n)))


def repartition_log(spark, path_in: str, path_out: str, n: int, old_count: int | None = None) -> bool:
    """Rewrite a log to ``n`` partitions in a new folder; order within a key is kept.

    Nothing is written, and False returned, if the count stays the same.  The caller
    switches readers to the new folder.
    """
    check_count(n)
    if n == old_count:
        return False
    write_log(rekey(read_log(spark, path_in), n), path_out, mode="error")
    return True
