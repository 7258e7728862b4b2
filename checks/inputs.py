"""Message-log inputs that Spark derives from the given tables.

Losses, late rows and duplicates are put in by rule, so that every operator has
something to find.  All rows of ``events`` take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlog.operators.audit import assign_sequence, ordering_audit
from partlog.plans.scratch import scratch_path

PREFIX = "LEDGER"
SENT_SINCE, SEEN_SINCE = "2024-01-30 00:00:00", "2024-01-29 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def acct(user_id: str = "user_id") -> Column:
    return F.concat(F.lit("acct-"), F.col(user_id).cast("string"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The producer's log: one message per event, numbered per user."""
    sent = events(spark, sf_dir).select(
        F.col("event_id").alias("stream_seq"),
        "ts",
        acct().alias("key"),
        "user_id",
        F.col("event_type").alias("payload"),
    )
    return assign_sequence(sent, ("stream_seq",))


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrived: 11ths lost, 7ths late, 13ths twice; (key, arrival) is unique."""
    seq = F.col("sequence")
    copies = F.when(seq % 13 == 0, F.array(F.lit(0), F.lit(6))).otherwise(F.array(F.lit(0)))
    late = F.when(seq % 7 == 0, F.lit(35)).otherwise(F.lit(0))
    first_run = seq <= 30
    return (
        published(spark, sf_dir)
        .where(seq % 11 != 0)
        .withColumn("_copy", F.explode(copies))
        .select(
            "stream_seq",
            "ts",
            "key",
            "sequence",
            "payload",
            F.when(first_run, 1).otherwise(2).alias("run"),
            F.when(first_run, F.col("user_id") % 3).otherwise(F.col("user_id") % 5).alias("partition"),
            (seq * 10 + F.col("_copy") + late).alias("arrival"),
        )
    )


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of messages sent per key."""
    sent = events(spark, sf_dir).groupBy(acct().alias("key")).agg(F.count(F.lit(1)).alias("expected"))
    return sent


def config_log(spark: SparkSession) -> DataFrame:
    """Two repartitions, 3 to 5 to 2, each with a buffered half day."""
    rows = [
        (1, "2024-01-01 00:00:00", "direct", 3),
        (2, "2024-01-10 00:00:00", "buffer", 3),
        (3, "2024-01-10 12:00:00", "direct", 5),
        (4, "2024-01-20 00:00:00", "buffer", 5),
        (5, "2024-01-20 12:00:00", "direct", 2),
    ]
    df = spark.createDataFrame(rows, "revision int, effective_ts string, mode string, partition_count int")
    return df.withColumn("effective_ts", F.col("effective_ts").cast("timestamp_ntz"))


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long settings history: every event is a write of a mode or a count, some unusable."""
    count = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(
        F.floor(F.col("value") / 5).cast("string")
    )
    is_mode = F.col("event_type") == "click"
    mode = F.when(F.col("value") > 30, F.lit("buffer")).otherwise(F.lit("direct"))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("revision"),
        F.col("ts").alias("effective_ts"),
        F.when(is_mode, F.lit("mode")).otherwise(F.lit("partition_count")).alias("key"),
        F.when(is_mode, mode).otherwise(count).alias("value"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the message columns and nanosecond times."""
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return published(spark, sf_dir).select(
        "stream_seq", "key", "sequence", "payload", F.lit(0).alias("partition"), nanos.alias("ts")
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text with three kinds of bad rows."""
    n = F.col("stream_seq")
    text = F.concat(
        F.lit('{"key":"'),
        F.col("key"),
        F.lit('","sequence":'),
        F.col("sequence").cast("string"),
        F.lit(',"payload":"'),
        F.col("payload"),
        F.lit('","partition":0,"ts":'),
        n.cast("string"),
        F.lit("}"),
    )
    data = (
        F.when(n % 97 == 0, F.lit("not-valid-json"))
        .when(n % 89 == 0, F.lit('{"key":1,"sequence":1}'))
        .when(n % 83 == 0, F.lit('{"key":"a"}x'))
        .otherwise(text)
    )
    return published(spark, sf_dir).select("stream_seq", data.alias("data"))


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published messages as one stream per payload, three partitions each."""
    return published(spark, sf_dir).select(
        F.col("payload").alias("stream"),
        (F.col("user_id") % 3).alias("partition"),
        "stream_seq",
        "key",
        "sequence",
        "ts",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 to 6 attempts per message, the last one acked except for every 17th."""
    n = F.col("stream_seq")
    tries = 1 + n % 6
    return (
        stream_log(spark, sf_dir)
        .where(F.col("sequence") % 11 != 0)
        .withColumn("attempt", F.explode(F.sequence(F.lit(1).cast("bigint"), tries)))
        .select(
            "stream",
            "partition",
            "stream_seq",
            "key",
            "sequence",
            "attempt",
            (F.col("ts") + F.make_dt_interval(secs=(30 * (F.col("attempt") - 1)).cast("decimal(18,6)"))).alias(
                "attempt_ts"
            ),
            ((F.col("attempt") == tries) & (n % 17 != 0)).alias("acked"),
        )
    )


def lag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_type").alias("stream"),
        (F.col("user_id") % 3).alias("partition"),
        F.col("event_id").alias("sample_seq"),
        "ts",
        (1 + F.col("user_id") % 10).alias("partition_count"),
        F.floor(F.col("value") * 50).alias("pending"),
        (F.col("event_id") % 100).alias("ack_pending"),
    )


def purges(spark: SparkSession) -> DataFrame:
    rows = [("LEDGER.00", 100), ("LEDGER.01", 40), (None, 20)]
    return spark.createDataFrame(rows, "subject string, purge_seq bigint")


def kv_state(spark: SparkSession, sf_dir: str, expired: bool = False) -> DataFrame:
    """Sequence reports as the producer and the consumers store them.

    Consumers write their counters, but zeros are left out, and those of partition 0 are of an
    older kind that writes none.  Reports that were not renewed in time have expired; they are
    there only if ``expired`` is set.
    """
    quoted = lambda name, value: F.when(value > 0, F.concat(F.lit(f',"{name}":'), value.cast("string")))
    text = lambda *parts: F.concat_ws("", *parts, F.lit("}"))
    since = lambda t: F.lit(True) if expired else F.col("ts") > F.lit(t).cast("timestamp_ntz")
    sent = (
        published(spark, sf_dir)
        .groupBy("key")
        .agg(F.max("sequence").cast("string").alias("n"), F.max("ts").alias("ts"))
        .where(since(SENT_SINCE))
        .select(
            F.concat(F.lit("pub."), "key").alias("kv_key"),
            text(F.lit('{"sequence":'), "n", F.lit(',"source":"producer"')).alias("value_json"),
        )
    )
    p = F.col("partition").cast("string")
    counts = {"gaps": "gaps", "gap_total": "total", "violations": "violations"}
    counters = F.concat_ws("", *[quoted(name, F.col(c)) for name, c in counts.items()])
    seen = (
        ordering_audit(delivered(spark, sf_dir), scope=("partition", "key"))
        .groupBy("key", "partition")
        .agg(
            F.max("sequence").cast("string").alias("n"),
            F.max("ts").alias("ts"),
            F.count_if(F.col("status") == "gap").alias("gaps"),
            F.sum("missing").alias("total"),
            F.count_if(F.col("status") == "violation").alias("violations"),
        )
        .where(since(SEEN_SINCE))
        .select(
            F.concat(F.lit("cons.p"), p, F.lit("."), "key").alias("kv_key"),
            text(
                F.lit('{"sequence":'),
                "n",
                F.lit(',"partition":'),
                p,
                F.lit(',"source":"consumer"'),
                F.when(F.col("partition") > 0, counters),
            ).alias("value_json"),
        )
    )
    return sent.unionByName(seen)


def stored(df: DataFrame, name: str) -> str:
    """Write a table into the shared scratch folder and return its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path
