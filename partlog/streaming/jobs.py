"""Streaming jobs with file sinks that a restart cannot double.

Every micro-batch overwrites its own folder ``batch_id=<n>``.  If a batch is repeated
after a failure, it replaces what the failed attempt left.

What one batch has to know of those before it is a ``StateTable``: a batch reads the rows of
its own keys there, and writes those that it changed.  A key may have any number of rows in a
batch; they are summed up in slices, and one row for the key reaches the state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlog import schema as S
from partlog.functions.codec import decode_messages
from partlog.operators.audit import RUN_SCOPE, judge
from partlog.operators.delivery import idempotent_append
from partlog.operators.replay import check_count, rekey_buffer
from partlog.operators.reports import lag_of_streams, last_samples, newest_samples, stream_info
from partlog.operators.routing import split_routes
from partlog.operators.spacing import thin_by_spacing
from partlog.plans import ordered, segments
from partlog.plans.id_store import IdStore
from partlog.plans.intervals import micros
from partlog.plans.scratch import cut_lineage, scratch_path
from partlog.plans.state_table import StateTable, remove
from partlog.sources.dead_letter import dead_letter

AVAILABLE_NOW = {"availableNow": True}


def put_batch(df: DataFrame, path: str, batch_id: int, by: str | None = None) -> None:
    """Write one micro-batch's folder, replacing an earlier attempt."""
    writer = df.write.mode("overwrite")
    if by is not None:
        writer = writer.partitionBy(by)
    writer.parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All micro-batches of a sink, with ``batch_id``."""
    return spark.read.option("mergeSchema", "false").parquet(path)


def held(each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Read the source once for a micro-batch that is used more than once."""

    def once(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            each(batch, batch_id)
        finally:
            batch.unpersist()

    return once


def _start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger, mode="append"):
    return (
        df.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def update_stream(df: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Write what each micro-batch of an update-mode stream changed."""
    each = lambda batch, batch_id: put_batch(batch, out, batch_id)
    return _start(df, each, checkpoint, trigger, "update")


def route_stream(
    df: DataFrame,
    load_config: Callable[[SparkSession], DataFrame],
    prefix: str,
    out: str,
    rejected: str,
    checkpoint: str,
    trigger: dict | None = None,
):
    """``split_routes`` on a stream: routed and rejected messages into a table each.

    The config log is read again for every micro-batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        config = load_config(batch.sparkSession)
        good, bad = split_routes(batch, config, prefix)
        put_batch(good, out, batch_id)
        put_batch(bad, rejected, batch_id)

    return _start(df, held(each), checkpoint, trigger)


def decode_stream(
    df: DataFrame,
    good_path: str,
    dead_path: str,
    subject: str,
    checkpoint: str,
    now_ns: int | None = None,
    trigger: dict | None = None,
):
    """Decoded messages into one table, rejected rows into the dead-letter table."""

    def each(batch: DataFrame, batch_id: int) -> None:
        good, bad = decode_messages(batch)
        now = F.lit(now_ns) if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
        put_batch(good, good_path, batch_id)
        put_batch(dead_letter(bad, S.REASON_UNMARSHAL, subject, now), dead_path, batch_id)

    return _start(df, held(each), checkpoint, trigger)


def audit_batches(
    df: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    scope: Sequence[str] = RUN_SCOPE,
    order: str = "arrival",
    span: int | None = None,
    trigger: dict | None = None,
):
    """``ordering_audit`` on a stream: each row with the one before it, over all micro-batches.

    A micro-batch is audited as a batch, so a hot key is cut into slices.  Late rows are
    findings, so there is no watermark and nothing is dropped.  The state is the last
    sequence of every scope.
    """
    scope = list(scope)
    last = T.StructType(
        [*[df.schema[c] for c in scope], T.StructField("sequence", T.LongType()), T.StructField(order, T.LongType())]
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        table = StateTable(batch.sparkSession, state, last, scope)
        before = table.read(batch_id - 1, batch.select(*scope))
        # What was known before sorts before everything in this batch.
        rows = batch.withColumn("_new", F.lit(1)).unionByName(
            before.withColumn("_new", F.lit(0)), allowMissingColumns=True
        )
        bucket = None if span is None else order
        linked = ordered.previous(
            rows, {"prev_sequence": "sequence"}, scope, ("_new", order), bucket=bucket, span=span
        )
        put_batch(judge(linked.where("_new = 1").drop("_new")), out, batch_id)
        newest = batch.groupBy(*scope).agg(
            F.max_by("sequence", order).alias("sequence"), F.max(order).cast("bigint").alias(order)
        )
        table.commit(batch_id, newest)

    return _start(df, held(each), checkpoint, trigger)


ACCOUNT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "key")]
    + [
        T.StructField(n, T.LongType())
        for n in ("first_sequence", "last_sequence", "partition", *segments.COUNTS, "seen_us")
    ]
)


def _accounts(batch: DataFrame, before: DataFrame, order: str, now: Column) -> DataFrame:
    """Rows of ``ACCOUNT`` for the keys of a batch: what was known, and then the batch."""
    scope = ["source", "key"]
    new = segments.summarize(batch, scope, (order,), ("partition",)).withColumn("_place", F.lit(1))
    known = before.select(*scope, *segments.ENDS[:2], F.struct("partition").alias("last"), *segments.COUNTS)
    both = known.withColumn("_place", F.lit(0)).unionByName(new)
    merged = segments.merge(both, scope, "_place")
    return merged.select(
        *scope, *segments.ENDS[:2], "last.partition", *segments.COUNTS, now.alias("seen_us")
    ).select(*ACCOUNT.names)


def _account_rows(df: DataFrame, key: str, order: str, source: str) -> DataFrame:
    """The columns that accounts need; partition and source may be absent."""
    partition = F.col("partition") if "partition" in df.columns else F.lit(None)
    origin = F.col("source") if "source" in df.columns else F.lit(source)
    return df.select(
        origin.alias("source"),
        F.col(key).alias("key"),
        order,
        F.col("sequence").cast("bigint").alias("sequence"),
        partition.cast("bigint").alias("partition"),
    )


def _reported(accounts: DataFrame, expired: bool) -> DataFrame:
    return accounts.select(
        "source",
        "key",
        F.col("last_sequence").alias("sequence"),
        "partition",
        "gaps",
        F.col("missing").alias("gap_total"),
        "violations",
        F.lit(expired).alias("expired"),
    )


def account_stream(
    df: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    ttl: str = S.STATE_TTL,
    key: str = "key",
    order: str = "arrival",
    source: str = "consumer",
    clock: Callable[[], Column] | None = None,
    trigger: dict | None = None,
):
    """Account of each source and key: last sequence and partition, gaps, gap total, violations.

    Counts compare each arrival with the one before it, over all micro-batches, as
    ``account_sequences`` does.  A micro-batch writes the accounts that changed, and once more,
    as expired, those without messages for ``ttl``, which are then forgotten.  Without a column
    ``source`` all rows have the given one; without ``partition`` it is NULL.  ``clock`` gives
    the time in microseconds.
    """
    idle = micros(ttl)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = StateTable(spark, state, ACCOUNT, ["source", "key"])
        time = clock() if clock else F.unix_micros(F.current_timestamp())
        now = spark.range(1).select(time.cast("bigint").alias("t")).head()["t"]
        rows = _account_rows(batch, key, order, source)
        old = F.col("seen_us") <= now - idle
        known = table.read(batch_id - 1, rows.select("source", "key"))
        # A key that comes back after its time starts anew; it was reported when that time ended.
        changed = cut_lineage(_accounts(rows, known.where(~old), order, F.lit(now)))
        gone = cut_lineage(table.read_where(batch_id - 1, old))
        put_batch(_reported(changed, False).unionByName(_reported(gone, True)), out, batch_id)
        back = changed.select(F.struct("source", "key").alias("_of"))
        forgotten = gone.withColumn("_of", F.struct("source", "key")).join(back, "_of", "left_anti")
        table.commit(batch_id, changed, forgotten)

    return _start(df, held(each), checkpoint, trigger)


def dedup_stream(
    df: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    id: str = "id",
    window: str = S.DEDUP_WINDOW,
    delay: str = "0 seconds",
    ts: str = "ts",
    position: str = "stream_seq",
    trigger: dict | None = None,
):
    """``dedup_window`` on a stream, with the same result however the input is cut.

    The time of the last kept row of each id is carried from batch to batch, for as long as
    it can still matter: the window, and ``delay`` for rows that come late.  Nothing is
    dropped for being late: a row that lies the window or more before the last kept one of
    its id is kept too.
    """
    spacing, patience = micros(window), micros(window) + micros(delay)
    last = T.StructType([df.schema[id], T.StructField("_last", T.LongType())])

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = StateTable(spark, state, last, [id])
        before = cut_lineage(table.read(batch_id - 1, batch.select(id)).select(F.struct(id).alias("_id"), "_last"))
        timed = batch.withColumns({"_id": F.struct(id), "_at": ordered.as_long(batch, ts)})
        far = F.col("_last").isNull() | (F.abs(F.col("_at") - F.col("_last")) >= spacing)
        open_ = timed.join(before, "_id", "left").where(far).select(*batch.columns)
        kept = thin_by_spacing(open_, [id], ts, position, window)
        put_batch(kept, out, batch_id)
        kept = spark.read.schema(batch.schema).parquet(f"{out}/batch_id={batch_id}")
        newest = kept.select(F.struct(id).alias("_id"), ordered.as_long(kept, ts).alias("_last"))
        met = newest.unionByName(before.join(newest.select("_id"), "_id", "left_semi"))
        known = met.groupBy("_id").agg(F.max("_last").alias("_last")).select(f"_id.{id}", "_last")
        now = newest.agg(F.max("_last")).head()[0]
        past = None if now is None else F.col("_last") <= now - patience
        table.commit(batch_id, known, expired=past)

    return _start(df, held(each), checkpoint, trigger)


STREAM_TOTALS = "stream string, messages bigint, bytes bigint"


def _totals_table(spark: SparkSession, state: str) -> StateTable:
    schema = spark.createDataFrame([], STREAM_TOTALS).schema
    return StateTable(spark, f"{state}/streams", schema, ["stream"])


def status_stream(
    df: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    key: str = "key",
    order: str = "arrival",
    source: str = "consumer",
    trigger: dict | None = None,
):
    """Messages and bytes per stream and the account of each key, kept up to date.

    A micro-batch writes what changed: totals below ``<out>/streams``, accounts below
    ``<out>/accounts``.  ``latest_status`` and ``latest_accounts`` have all of both.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        streams = _totals_table(spark, state)
        new = stream_info(batch)
        before = streams.read(batch_id - 1, new.select("stream"))
        totals = before.unionByName(new).groupBy("stream").agg(
            F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes")
        )
        totals = cut_lineage(totals)
        rows = _account_rows(batch, key, order, source)
        table = StateTable(spark, f"{state}/accounts", ACCOUNT, ["source", "key"])
        known = table.read(batch_id - 1, rows.select("source", "key"))
        accounts = cut_lineage(_accounts(rows, known, order, F.lit(0).cast("bigint")))
        put_batch(totals, f"{out}/streams", batch_id)
        put_batch(_reported(accounts, False).drop("expired"), f"{out}/accounts", batch_id)
        streams.commit(batch_id, totals)
        table.commit(batch_id, accounts)

    return _start(df, held(each), checkpoint, trigger)


def latest_status(spark: SparkSession, state: str) -> DataFrame:
    """stream, messages and bytes of all batches so far."""
    table = _totals_table(spark, state)
    return table.read(table.latest())


def latest_accounts(spark: SparkSession, state: str) -> DataFrame:
    """``account_sequences`` of all batches so far, with source and violations."""
    table = StateTable(spark, f"{state}/accounts", ACCOUNT, ["source", "key"])
    return _reported(table.read(table.latest()), False).drop("expired")


LAST_SAMPLES = ("stream", "partition", "_w", "_lag", "_count", "sample_seq")
WINDOW = ("stream", "_w")


def lag_stream(
    df: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    every: str = S.LAG_INTERVAL,
    ts: str = "ts",
    trigger: dict | None = None,
):
    """``lag_windows`` on a stream: nothing is late, and open windows count as they are.

    A micro-batch writes the windows that it changed, from the last samples of their
    partitions; ``latest_lag_windows`` has all windows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        new = cut_lineage(last_samples(batch, every, ts).select(*LAST_SAMPLES))
        table = StateTable(batch.sparkSession, state, new.schema, LAST_SAMPLES[:3], by=WINDOW)
        # A window that changed counts with all its partitions.
        before = table.read(batch_id - 1, new.select(*WINDOW))
        whole = cut_lineage(newest_samples(before.unionByName(new)).select(*LAST_SAMPLES))
        put_batch(lag_of_streams(whole), out, batch_id)
        table.commit(batch_id, whole)

    return _start(df, held(each), checkpoint, trigger)


def latest_lag_windows(spark: SparkSession, state: str) -> DataFrame:
    """``lag_windows`` of all samples so far."""
    table = StateTable.opened(spark, state, LAST_SAMPLES[:3], by=WINDOW)
    return lag_of_streams(table.read(table.latest()))


REPLAYED = "stream_seq bigint, key string, sequence bigint, payload string, ts bigint, subject string, id string, batch_id int, partition int"


def replay_stream(
    buffer: DataFrame,
    out: str,
    dead_path: str,
    n: int,
    prefix: str,
    checkpoint: str,
    now_ns: int | None = None,
    trigger: dict | None = None,
    ids: str | None = None,
):
    """Drain a buffer of (stream_seq, data) into ``out`` under ``n`` partitions.

    It resumes where it stopped.  A message is written once: repeated batches replace
    themselves, and ids of other batches are left out.  Those are kept in ``ids`` (default:
    a folder beside ``out``), where a batch opens only what may hold one of its own.
    """
    check_count(n)
    spark = buffer.sparkSession
    # An empty sink can be read before the first batch.
    spark.createDataFrame([], REPLAYED).write.mode("ignore").parquet(out)
    seen = T.StructType([T.StructField("id", T.StringType())])

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = IdStore(spark, ids or f"{out}-ids", seen)
        # A batch may be a few files; decoding them is work for all tasks.
        decoded = scratch_path(spark, "decoded")
        keyed, bad = rekey_buffer(batch.repartition("stream_seq"), n, prefix, path=decoded)
        # The store after the batch before: a failed attempt of this one does not count.
        known = store.known(batch_id - 1, keyed.select("id"))
        good = idempotent_append(keyed, known, ["id"], rows=keyed.count())
        now = F.lit(now_ns) if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
        put_batch(dead_letter(bad, S.REASON_UNMARSHAL, prefix + S.BUFFER_SUFFIX, now), dead_path, batch_id)
        # Ranges of (partition, position), so that files follow each other in log order.
        order = ("partition", "stream_seq")
        placed = good.repartitionByRange(*order).sortWithinPartitions(*order)
        put_batch(placed, out, batch_id, "partition")
        written = spark.read.schema(REPLAYED).option("basePath", out).parquet(f"{out}/batch_id={batch_id}")
        store.add(batch_id, written.select("id"))
        remove(spark, decoded)

    return _start(buffer, each, checkpoint, trigger)
