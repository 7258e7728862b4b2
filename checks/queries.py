"""One query per operator, each with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks.sql import statement
from partlog import schema as S
from partlog.functions import codec, keys, state
from partlog.operators import audit, completeness, delivery, handlers, replay, reports
from partlog.operators import retention, routing, spacing
from partlog.plans import segments
from partlog.plans.scratch import scratch_path
from partlog.sources import dead_letter as dl
from partlog.sources import log
from partlog.streaming import jobs, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW_NS = 1_700_000_000_000_000_000


def query(sql: str | None = None, recursive: str = ""):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = statement(sql, recursive)
        return fn

    return register


def run(*started) -> None:
    for q in started:
        q.awaitTermination()


# ---- scans, sources, sinks ----------------------------------------------------------

LOG_COLUMNS = "stream_seq, key, sequence, payload, CAST(partition AS INTEGER) AS partition, ts"


def _message_log(spark, d) -> str:
    path = scratch_path(spark, "log")
    log.write_log(replay.rekey(I.messages(spark, d), 3), path)
    return path


@query(
    "SELECT stream_seq, key, sequence, payload, CAST(user_id % 3 AS INTEGER) AS partition,"
    " epoch_us(ts) * 1000 AS ts FROM published WHERE user_id % 3 IN (0, 2)"
)
def read_log(spark, d):
    """Partition-pruned scan."""
    return log.read_log(spark, _message_log(spark, d), partitions=[0, 2])


@query(
    "SELECT CAST(user_id % 3 AS INTEGER) AS partition, count(*) AS messages,"
    " min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY ALL"
)
def write_log(spark, d):
    return (
        log.read_log(spark, _message_log(spark, d))
        .groupBy("partition")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.min("stream_seq").alias("first_seq"),
            F.max("stream_seq").alias("last_seq"),
        )
    )


@query(
    "SELECT stream_seq, key, sequence, payload, CAST(user_id % 3 AS INTEGER) AS partition,"
    " epoch_us(ts) * 1000 AS ts FROM published"
)
def read_log_stream(spark, d):
    """Streaming scan in small micro-batches, appended to a second log."""
    source = _message_log(spark, d)
    out, ckpt = scratch_path(spark, "copy"), scratch_path(spark, "ckpt")
    run(log.write_log_stream(log.read_log_stream(spark, source, max_files=4), out, ckpt))
    return log.read_log(spark, out)


@query(
    "SELECT CAST(user_id % 5 AS INTEGER) AS partition, count(*) AS messages,"
    " CAST(sum(sequence) AS BIGINT) AS sequence_sum FROM published GROUP BY ALL"
)
def write_log_stream(spark, d):
    source = I.stored(I.messages(spark, d), "messages")
    out, ckpt = scratch_path(spark, "log"), scratch_path(spark, "ckpt")
    stream = log.read_log_stream(spark, source)
    run(log.write_log_stream(replay.rekey(stream, 5), out, ckpt))
    return (
        log.read_log(spark, out)
        .groupBy("partition")
        .agg(F.count(F.lit(1)).alias("messages"), F.sum("sequence").alias("sequence_sum"))
    )


@query("SELECT * FROM good")
def decode_messages(spark, d):
    return codec.decode_messages(I.raw_messages(spark, d))[0]


@query("SELECT stream_seq, key, sequence, payload, 0 AS partition, CAST(0 AS BIGINT) AS ts FROM published")
def decode_repeated_names(spark, d):
    """Messages that give names twice, in other cases and with nulls: the last value counts."""
    pair = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = F.col("sequence").cast("string")
    fields = [
        pair("key", quoted(F.lit("old"))),
        pair("Sequence", F.lit("1")),
        pair("payload", quoted(F.col("payload"))),
        pair("KEY", quoted(F.col("key"))),
        pair("sequence", number),
        pair("payload", F.lit("null")),
    ]
    data = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return codec.decode_messages(I.published(spark, d).select("stream_seq", data.alias("data")))[0]


@query("SELECT * FROM bad")
def decode_rejects(spark, d):
    return codec.decode_messages(I.raw_messages(spark, d))[1]


@query(
    """SELECT stream_seq, concat('{"key":"', key, '","sequence":', sequence, ',"payload":"', payload,
    '","partition":0,"ts":', ts, '}') AS data FROM messages"""
)
def encode_messages(spark, d):
    return codec.encode_messages(I.messages(spark, d))


@query(
    f"""SELECT stream_seq, data, 'LEDGER_BUFFER' AS original_subject, 'unmarshal_failure' AS reason,
      {NOW_NS} AS ts_ns, error FROM bad
    UNION ALL
    SELECT stream_seq, concat(key, '-', sequence), format('LEDGER.{{:02d}}', partition),
      'max_delivery_exhausted', {NOW_NS}, NULL
    FROM stream_log JOIN attempts USING (stream, partition, stream_seq) WHERE attempts >= 5 AND NOT acked
    UNION ALL
    SELECT stream_seq, concat(key, '-', sequence), subject, 'replay_publish_failed', {NOW_NS}, 'no route'
    FROM planned WHERE phase = 0 AND partition = 4"""
)
def dead_letter(spark, d):
    """All three reasons in one dead-letter table."""
    bad = codec.decode_messages(I.raw_messages(spark, d))[1]
    text = F.concat_ws("-", "key", F.col("sequence").cast("string"))
    exhausted = (
        delivery.redelivery_report(I.deliveries(spark, d), F.col("last_attempt_ts"))
        .where(F.col("status") == S.REASON_MAX_DELIVERY)
        .join(I.stream_log(spark, d), list(delivery.MESSAGE_KEY))
        .select("stream_seq", text.alias("data"), keys.subject_for_partition(I.PREFIX, "partition").alias("s"))
    )
    failed = (
        replay.replay_plan(I.published(spark, d), I.config_log(spark), I.PREFIX)
        .where("phase = 0 AND partition = 4")
        .select("stream_seq", text.alias("data"), F.col("subject").alias("s"), F.lit("no route").alias("error"))
    )
    at = ("stream_seq",)
    dead = dl.dead_letter(bad, S.REASON_UNMARSHAL, I.PREFIX + S.BUFFER_SUFFIX, NOW_NS, keep=at)
    dead = dead.unionByName(
        dl.dead_letter(exhausted, S.REASON_MAX_DELIVERY, F.col("s"), NOW_NS, keep=at)
    )
    dead = dead.unionByName(dl.dead_letter(failed, S.REASON_REPLAY_FAILED, F.col("s"), NOW_NS, keep=at))
    return dead.withColumn("data", F.col("data").cast("string"))


@query("SELECT * FROM changelog")
def read_config_log(spark, d):
    path = I.stored(I.changelog(spark, d).withColumn("effective_ts", F.col("effective_ts").cast("timestamp")), "config")
    return log.read_config_log(spark, path).withColumn("effective_ts", F.col("effective_ts").cast("timestamp_ntz"))


@query("SELECT * FROM changelog")
def read_config_log_stream(spark, d):
    path = I.stored(I.changelog(spark, d).withColumn("effective_ts", F.col("effective_ts").cast("timestamp")), "config")
    out, ckpt = scratch_path(spark, "config"), scratch_path(spark, "ckpt")
    stream = log.read_config_log(spark, path, streaming=True)
    run(
        stream.writeStream.format("parquet")
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start(out)
    )
    return log.read_config_log(spark, out).withColumn("effective_ts", F.col("effective_ts").cast("timestamp_ntz"))


# ---- projections and scalar functions -----------------------------------------------

ALL_KEYS = """(SELECT c_name AS key FROM customer UNION ALL SELECT p_name FROM part
    UNION ALL SELECT n_name FROM nation UNION ALL SELECT text FROM conversations)"""
HASH = """list_reduce([CAST(concat('0x', substr(hex(encode(key)), 2 * i - 1, 2)) AS BIGINT)
    for i in range(1, strlen(key) + 1)], lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT))"""
DIGITS = "TRY_CAST(nullif(regexp_extract(key, '([0-9]+)\\z', 1), '') AS BIGINT)"


def _all_keys(spark, d) -> DataFrame:
    column = lambda t, c: I.table(spark, d, t).select(F.col(c).alias("key"))
    return (
        column("customer", "c_name")
        .unionByName(column("part", "p_name"))
        .unionByName(column("nation", "n_name"))
        .unionByName(column("conversations", "text"))
    )


@query(f"SELECT key, coalesce({DIGITS}, -1) AS number FROM {ALL_KEYS}")
def extract_trailing_number(spark, d):
    return _all_keys(spark, d).select("key", keys.extract_trailing_number("key").alias("number"))


@query(f"SELECT key, {HASH} AS hash FROM {ALL_KEYS}")
def key_hash31(spark, d):
    return _all_keys(spark, d).select("key", keys.key_hash31("key").alias("hash"))


@query(
    f"""SELECT key, n AS partition_count, CAST(CASE WHEN n <= 1 THEN 0
      ELSE coalesce(number % n, hash % n) END AS INTEGER) AS partition
    FROM (SELECT key, {DIGITS} AS number, {HASH} AS hash FROM {ALL_KEYS})
    CROSS JOIN (SELECT unnest([0, 1, 3, 5, 20]) AS n)"""
)
def partition_for_key(spark, d):
    counts = F.explode(F.array(*map(F.lit, (0, 1, 3, 5, 20)))).alias("partition_count")
    return (
        _all_keys(spark, d)
        .select("key", counts)
        .withColumn("partition", keys.partition_for_key("key", "partition_count"))
    )


@query("SELECT event_id, format('LEDGER.{:02d}', user_id % 20) AS subject FROM events")
def subject_for_partition(spark, d):
    return I.events(spark, d).select(
        "event_id", keys.subject_for_partition(I.PREFIX, F.col("user_id") % 20).alias("subject")
    )


@query("SELECT event_id, concat('consumer-p', user_id % 20) AS name FROM events")
def consumer_name(spark, d):
    return I.events(spark, d).select("event_id", keys.consumer_name(F.col("user_id") % 20).alias("name"))


@query(
    """SELECT stream_seq, concat(key, '-', sequence, '-', stream_seq) AS publish_id,
    concat('replay-', key, '-', sequence) AS replay_id FROM published"""
)
def message_id(spark, d):
    return I.published(spark, d).select(
        "stream_seq",
        keys.message_id("publish", "key", "sequence", "stream_seq").alias("publish_id"),
        keys.message_id("replay", "key", "sequence").alias("replay_id"),
    )


@query(
    """SELECT event_id, upper(event_type) AS stream_name, upper(event_type) AS subject_prefix,
    upper(event_type) || '_BUFFER' AS buffer_stream, upper(event_type) || '_BUFFER' AS buffer_subject,
    upper(event_type) || '_DLQ' AS dlq_stream, upper(event_type) || '_DLQ' AS dlq_subject,
    upper(event_type) || '_config' AS kv_bucket FROM events"""
)
def stream_names(spark, d):
    return I.events(spark, d).select("event_id", keys.stream_names("event_type").alias("n")).select("event_id", "n.*")


def _dotted_state(spark, d):
    """All keys ever stored, and the same ones with dots inside the message key or another root."""
    kv = I.kv_state(spark, d, expired=True)
    dotted = kv.withColumn("kv_key", F.concat("kv_key", F.lit(".eu.west")))
    other = kv.withColumn("kv_key", F.concat(F.lit("x"), "kv_key"))
    return kv.unionByName(dotted).unionByName(other)


@query(
    """SELECT kv_key, source, partition, key FROM all_state_keys
    UNION ALL SELECT kv_key || '.eu.west', source, partition, key || '.eu.west' FROM all_state_keys
    UNION ALL SELECT 'x' || kv_key, NULL, NULL, NULL FROM all_state_keys"""
)
def parse_state_key(spark, d):
    return _dotted_state(spark, d).select("kv_key", state.parse_state_key("kv_key").alias("k")).select("kv_key", "k.*")


@query(
    """SELECT kv_key, sequence, coalesce(partition, 0) AS partition, source,
    gaps, gap_total, violations FROM state_keys"""
)
def sequence_state_value(spark, d):
    kv = I.kv_state(spark, d)
    return kv.select("kv_key", state.sequence_state_value("value_json").alias("v")).select("kv_key", "v.*")


@query(
    """SELECT DISTINCT concat('acct-', user_id) AS key, CAST(user_id % 3 AS INTEGER) AS old_partition,
    CAST(user_id % 5 AS INTEGER) AS new_partition FROM events WHERE user_id % 3 <> user_id % 5"""
)
def moved_keys(spark, d):
    sent = I.events(spark, d).select(I.acct().alias("key"))
    return keys.moved_keys(sent, 3, 5)


# ---- filters, retention, purge --------------------------------------------------------


@query(
    """SELECT *, TRY_CAST(value AS INTEGER) AS partition_count FROM changelog
    WHERE key = 'partition_count' AND TRY_CAST(value AS INTEGER) BETWEEN 1 AND 20"""
)
def valid_config(spark, d):
    return routing.valid_config(I.changelog(spark, d).where(F.col("key") == S.KEY_PARTITION_COUNT))


@query(
    """SELECT revision, effective_ts, coalesce(mode, 'direct') AS mode, partition_count FROM (
      SELECT revision, effective_ts, last_value(CASE WHEN key = 'mode' THEN value END IGNORE NULLS) OVER w AS mode,
        last_value(CASE WHEN key = 'partition_count' AND TRY_CAST(value AS INTEGER) BETWEEN 1 AND 20
          THEN TRY_CAST(value AS INTEGER) END IGNORE NULLS) OVER w AS partition_count
      FROM changelog WINDOW w AS (ORDER BY revision)) WHERE partition_count IS NOT NULL"""
)
def config_history(spark, d):
    return routing.config_history(I.changelog(spark, d))


RETENTION = """SELECT * FROM stream_log WHERE ts >= (
    SELECT max(m.ts) FROM stream_log m WHERE m.stream = stream_log.stream) - INTERVAL '20' DAY"""


@query(f"SELECT * FROM ({RETENTION}) QUALIFY row_number() OVER (PARTITION BY stream ORDER BY stream_seq DESC) <= 300")
def retain_newest(spark, d):
    return retention.retain_newest(I.stream_log(spark, d), "20 days", 300)


@query(
    f"""SELECT *, row_number() OVER (PARTITION BY stream ORDER BY stream_seq) <= 300 AS kept
    FROM ({RETENTION})"""
)
def retain_oldest(spark, d):
    kept, rejected = retention.retain_oldest(I.stream_log(spark, d), "20 days", 300)
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))


@query(
    """SELECT stream_seq, key, subject FROM routed
    WHERE stream_seq > coalesce((SELECT max(purge_seq) FROM purges WHERE subject IS NULL), -1)
    AND stream_seq > coalesce((SELECT max(purge_seq) FROM purges p WHERE p.subject = routed.subject), -1)"""
)
def apply_purges(spark, d):
    routed = _routed(spark, d).select("stream_seq", "key", "subject")
    return retention.apply_purges(routed, I.purges(spark))


STORED_SQL = """SELECT stream_seq, key, sequence, payload, CAST(user_id % 3 AS INTEGER) AS partition,
    epoch_us(ts) * 1000 AS ts FROM published"""


@query(
    f"""SELECT * FROM ({STORED_SQL}) WHERE stream_seq > coalesce((SELECT max(purge_seq) FROM purges WHERE subject IS NULL), -1)
    AND stream_seq > coalesce((SELECT max(purge_seq) FROM purges p WHERE p.subject = format('LEDGER.{{:02d}}', partition)), -1)"""
)
def purge_log(spark, d):
    """A stored log after its files with purged rows are replaced."""
    path = _message_log(spark, d)
    retention.purge_log(spark, path, I.purges(spark), I.PREFIX)
    return log.read_log(spark, path)


@query(
    f"""SELECT * FROM ({STORED_SQL}) WHERE ts >= (SELECT max(epoch_us(ts)) * 1000 FROM published) - CAST(20 * 86400 AS BIGINT) * 1000000000
    ORDER BY stream_seq DESC LIMIT 500"""
)
def retain_log(spark, d):
    """A stored log after a limit by age and count."""
    path = _message_log(spark, d)
    newest = I.published(spark, d).agg(F.max("ts").cast("timestamp")).scalar()
    retention.retain_log(spark, path, newest, "20 days", 500, span=1000)
    return log.read_log(spark, path)


# ---- joins ----------------------------------------------------------------------------


def _routed(spark, d, **options):
    return routing.route_messages(I.published(spark, d), I.config_log(spark), I.PREFIX, **options)


ROUTED_SQL = "SELECT stream_seq, ts, key, user_id, sequence, payload, mode, partition_count, partition, subject FROM routed"


@query(ROUTED_SQL)
def route_messages(spark, d):
    return _routed(spark, d)


def _patchy_config(spark) -> DataFrame:
    """Starts late, and holds counts that cannot be used."""
    rows = [("2024-01-05", 3), ("2024-01-10", 0), ("2024-01-12", 21), ("2024-01-15", None), ("2024-01-20", 2)]
    df = spark.createDataFrame(
        [(k, t, "direct", n) for k, (t, n) in enumerate(rows, 1)],
        "revision int, effective_ts string, mode string, partition_count int",
    )
    return df.withColumn("effective_ts", F.col("effective_ts").cast("timestamp_ntz"))


@query(
    """SELECT stream_seq, key, CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'no configuration'
      ELSE 'unusable partition count' END AS reject_reason FROM published
    WHERE ts < TIMESTAMP '2024-01-05' OR (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')"""
)
def rejected_messages(spark, d):
    bad = routing.rejected_messages(I.published(spark, d), _patchy_config(spark))
    return bad.select("stream_seq", "key", "reject_reason")


@query(ROUTED_SQL)
def route_messages_merge(spark, d):
    """The way taken when the config log is too large to broadcast."""
    return _routed(spark, d, max_broadcast_rows=0)


@query(
    """SELECT p.*, c.mode, c.partition_count, CAST(p.user_id % c.partition_count AS INTEGER) AS partition,
      CASE WHEN c.mode = 'buffer' THEN 'LEDGER_BUFFER'
      ELSE format('LEDGER.{:02d}', p.user_id % c.partition_count) END AS subject
    FROM published p ASOF JOIN (SELECT effective_ts, coalesce(mode, 'direct') AS mode, partition_count FROM (
      SELECT effective_ts, last_value(CASE WHEN key = 'mode' THEN value END IGNORE NULLS) OVER w AS mode,
        last_value(CASE WHEN key = 'partition_count' AND TRY_CAST(value AS INTEGER) BETWEEN 1 AND 20
          THEN TRY_CAST(value AS INTEGER) END IGNORE NULLS) OVER w AS partition_count
      FROM changelog WINDOW w AS (ORDER BY revision)) WHERE partition_count IS NOT NULL) c
    ON p.ts >= c.effective_ts"""
)
def route_by_changelog(spark, d):
    """Routing under a config log as long as the message log."""
    return routing.route_messages(
        I.published(spark, d), routing.config_history(I.changelog(spark, d)), I.PREFIX
    )


def _accounts(spark, d):
    return audit.account_sequences(I.delivered(spark, d))


@query(
    """SELECT key, coalesce(p.sequence, 0) AS published, coalesce(c.sequence, 0) AS consumed, partition,
      coalesce(gaps, 0) AS gaps, coalesce(gap_total, 0) AS gap_total,
      coalesce(p.sequence, 0) - coalesce(c.sequence, 0) AS lag,
      CASE WHEN coalesce(gap_total, 0) > 0 THEN 'MISSING'
        WHEN coalesce(c.sequence, 0) > coalesce(p.sequence, 0) + 5 THEN 'MISMATCH'
        WHEN coalesce(p.sequence, 0) = coalesce(c.sequence, 0) THEN 'IN SYNC'
        WHEN coalesce(p.sequence, 0) - coalesce(c.sequence, 0) > 10 THEN 'LAGGING' ELSE 'OK' END AS status,
      CASE WHEN coalesce(c.sequence, 0) > coalesce(p.sequence, 0) + 5
          OR coalesce(p.sequence, 0) - coalesce(c.sequence, 0) > 50 THEN 'bad'
        WHEN coalesce(p.sequence, 0) - coalesce(c.sequence, 0) > 10 THEN 'warn' ELSE 'ok' END AS severity
    FROM (SELECT key, max(sequence) AS sequence FROM published GROUP BY key) p
    FULL JOIN accounts c USING (key)"""
)
def sequence_report(spark, d):
    sent = I.published(spark, d).groupBy("key").agg(F.max("sequence").alias("sequence"))
    return reports.sequence_report(sent, _accounts(spark, d))


@query(
    """SELECT key, published, consumed, partition, gaps, gap_total, published - consumed AS lag,
      CASE WHEN gap_total > 0 THEN 'MISSING' WHEN consumed > published + 5 THEN 'MISMATCH'
        WHEN published = consumed THEN 'IN SYNC' WHEN published - consumed > 10 THEN 'LAGGING' ELSE 'OK' END AS status,
      CASE WHEN consumed > published + 5 OR published - consumed > 50 THEN 'bad'
        WHEN published - consumed > 10 THEN 'warn' ELSE 'ok' END AS severity
    FROM (SELECT key, coalesce(p.sequence, 0) AS published, coalesce(c.sequence, 0) AS consumed, partition,
        coalesce(gaps, 0) AS gaps, coalesce(gap_total, 0) AS gap_total
      FROM (SELECT key, sequence FROM state_keys WHERE source = 'producer') p
      FULL JOIN consumed c USING (key))"""
)
def sequence_report_stored(spark, d):
    """From stored state with counters, some reports of which have expired."""
    rows = reports.sequence_state(I.kv_state(spark, d))
    return reports.sequence_report(reports.published_sequences(rows), reports.merge_consumed(rows))


@query(
    """SELECT key, expected, coalesce(received, 0) AS received, expected - coalesce(received, 0) AS missing,
      CASE WHEN expected = received THEN first_index END AS first_index,
      CASE WHEN expected = received THEN first_index + 1 END AS want_sequence,
      CASE WHEN expected = received THEN got_sequence END AS got_sequence
    FROM expected FULL JOIN positions USING (key)"""
)
def completeness_report(spark, d):
    return completeness.completeness_report(I.expected(spark, d), I.delivered(spark, d))


@query("SELECT stream, partition, stream_seq, key, sequence, ts, state, attempts FROM delivery_state WHERE state IS NOT NULL")
def pending_messages(spark, d):
    return delivery.pending_messages(I.stream_log(spark, d), I.deliveries(spark, d))


@query(
    """SELECT key, sequence, min(arrival) AS arrival, arg_min(payload, arrival) AS payload FROM delivered
    WHERE (key, sequence) NOT IN (SELECT (key, sequence) FROM published WHERE user_id % 4 = 0)
    GROUP BY key, sequence"""
)
def idempotent_append(spark, d):
    """Deliveries, some twice, into a target that has every fourth user already."""
    new = I.delivered(spark, d).select("key", "sequence", "arrival", "payload")
    target = I.published(spark, d).where("user_id % 4 = 0")
    return delivery.idempotent_append(new, target, ["key", "sequence"], position="arrival")


STALLED = """(SELECT p.stream, p.partition,
      count(*) FILTER (p.partition = 2 OR s.state = 'pending') AS pending,
      count(*) FILTER (p.partition <> 2 AND s.state = 'ack_pending') AS ack_pending,
      CAST(coalesce(sum(s.attempts) FILTER (p.partition <> 2), 0) AS BIGINT) AS delivered
    FROM delivery_state p JOIN delivery_state s USING (stream, partition, stream_seq)
    GROUP BY p.stream, p.partition)"""


def _stalled(spark, d):
    """Partition 2 of every stream has a consumer that has delivered nothing."""
    sent, tried = I.stream_log(spark, d), I.deliveries(spark, d).where("partition <> 2")
    return sent, tried, sent.select("stream", "partition").distinct()


def _stalled_info(spark, d):
    sent, tried, consumers = _stalled(spark, d)
    return delivery.consumer_info(sent, tried, consumers=consumers)


@query(f"SELECT stream, partition, pending = 0 AND ack_pending = 0 AS drained FROM {STALLED}")
def drained(spark, d):
    return delivery.drained(*_stalled(spark, d))


@query(
    f"SELECT stream, partition, delivered, pending, ack_pending, concat('consumer-p', partition) AS name FROM {STALLED}"
)
def consumer_info_stalled(spark, d):
    return _stalled_info(spark, d)


@query(f"SELECT stream, CAST(sum(pending + ack_pending) AS BIGINT) AS total_pending FROM {STALLED} GROUP BY stream")
def total_pending_stalled(spark, d):
    return delivery.total_pending(_stalled_info(spark, d))


@query(f"SELECT stream, bool_and(pending = 0 AND ack_pending = 0) AS drained FROM {STALLED} GROUP BY stream")
def stream_drained_stalled(spark, d):
    return delivery.stream_drained(*_stalled(spark, d))


@query("SELECT stream, bool_and(pending = 0 AND ack_pending = 0) AS drained FROM consumer_counts GROUP BY stream")
def stream_drained(spark, d):
    sent = I.stream_log(spark, d)
    return delivery.stream_drained(sent, I.deliveries(spark, d), sent.select("stream", "partition").distinct())


# ---- aggregations -----------------------------------------------------------------------

SUMMARY = """count(*) AS received, count(*) FILTER (status = 'violation') AS violations,
    count(*) FILTER (status = 'gap') AS gaps, CAST(sum(missing) AS BIGINT) AS missing"""


def _audit(spark, d):
    return audit.ordering_audit(I.delivered(spark, d))


@query(f"SELECT partition, {SUMMARY} FROM audit_run GROUP BY partition")
def ordering_summary(spark, d):
    return audit.ordering_summary(_audit(spark, d), by=("partition",))


@query(f"SELECT {SUMMARY} FROM audit_key")
def ordering_totals(spark, d):
    return audit.ordering_summary(audit.ordering_audit(I.delivered(spark, d), scope=("key",)))


@query("SELECT * FROM accounts")
def account_sequences(spark, d):
    return _accounts(spark, d)


@query(
    """SELECT key, violations, gaps, missing FROM (SELECT key, """
    + SUMMARY
    + """ FROM audit_run GROUP BY key) WHERE violations > 0 OR gaps > 0"""
)
def violations_by_key(spark, d):
    return audit.violations_by_key(_audit(spark, d))


@query("SELECT run, partition, count(*) AS received FROM delivered GROUP BY run, partition")
def consumer_results(spark, d):
    return audit.consumer_results(I.delivered(spark, d))


@query(
    """SELECT run, partition, (n - 1) // 500 AS piece, received,
      string_agg(concat(key, ':', sequence, ':', payload), ' ' ORDER BY n) AS messages
    FROM (SELECT *, row_number() OVER (PARTITION BY run, partition ORDER BY stream_seq, arrival) AS n,
      count(*) OVER (PARTITION BY run, partition) AS received FROM delivered)
    GROUP BY ALL"""
)
def consumer_messages(spark, d):
    """With the message lists, in pieces of 500."""
    listed = audit.consumer_results(
        I.delivered(spark, d), with_messages=True, order=("stream_seq", "arrival"), piece_rows=500
    )
    text = F.transform(
        "messages", lambda m: F.concat_ws(":", m["key"], m["sequence"].cast("string"), m["payload"])
    )
    return listed.withColumn("messages", F.array_join(text, " "))


@query(
    "SELECT subject AS stream, count(*) AS messages, CAST(sum(strlen(data)) AS BIGINT) AS bytes"
    " FROM routed JOIN raw_messages USING (stream_seq) GROUP BY subject"
)
def stream_info(spark, d):
    data = I.raw_messages(spark, d)
    routed = _routed(spark, d).select("stream_seq", F.col("subject").alias("stream"))
    return reports.stream_info(routed.join(data, "stream_seq"))


def _consumer_info(spark, d):
    return delivery.consumer_info(I.stream_log(spark, d), I.deliveries(spark, d))


@query("SELECT * FROM consumer_counts")
def consumer_info(spark, d):
    return _consumer_info(spark, d)


@query("SELECT key, arg_max(payload, stream_seq) AS value, max(stream_seq) AS revision FROM published GROUP BY key")
def latest_by_key(spark, d):
    written = I.published(spark, d).select("key", F.col("payload").alias("value"), F.col("stream_seq").alias("revision"))
    return reports.latest_by_key(written)


@query("SELECT * FROM consumed")
def merge_consumed(spark, d):
    return reports.merge_consumed(reports.sequence_state(I.kv_state(spark, d)))


@query("SELECT stream, CAST(sum(pending + ack_pending) AS BIGINT) AS total_pending FROM consumer_counts GROUP BY stream")
def total_pending(spark, d):
    return delivery.total_pending(_consumer_info(spark, d))


TIMES = """(SELECT stream, epoch_us(ts) AS published_us, epoch_us(last_attempt_ts) AS consumed_us,
    epoch_us(last_attempt_ts) - epoch_us(ts) + stream_seq % 1000 AS latency_us
    FROM stream_log JOIN attempts USING (stream, partition, stream_seq))"""


def _times(spark, d):
    last = I.deliveries(spark, d).groupBy(*delivery.MESSAGE_KEY).agg(F.max("attempt_ts").alias("_last"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (
        I.stream_log(spark, d)
        .join(last, list(delivery.MESSAGE_KEY))
        .select(
            "stream",
            us("ts").alias("published_us"),
            us("_last").alias("consumed_us"),
            (us("_last") - us("ts") + F.col("stream_seq") % 1000).alias("latency_us"),
        )
    )


@query(
    f"""SELECT stream, count(*) AS messages, round((max(published_us) - min(published_us)) / 1e6, 3) AS publish_seconds,
      round((max(consumed_us) - min(published_us)) / 1e6, 3) AS end_to_end_seconds,
      round(count(*) / nullif((max(published_us) - min(published_us)) / 1e6, 0), 6) AS publish_rate,
      round(count(*) / nullif((max(consumed_us) - min(published_us)) / 1e6, 0), 6) AS end_to_end_rate,
      round(avg(consumed_us - published_us), 1) AS mean_latency_us
    FROM {TIMES} GROUP BY stream"""
)
def throughput(spark, d):
    digits = {"publish_seconds": 3, "end_to_end_seconds": 3, "publish_rate": 6, "end_to_end_rate": 6, "mean_latency_us": 1}
    rates = reports.throughput(_times(spark, d), by=("stream",))
    return rates.withColumns({c: F.round(c, n) for c, n in digits.items()})


PERCENTILES = f"""SELECT stream, max(latency_us) FILTER (r = least(n * 50 // 100, n - 1)) AS p50,
    max(latency_us) FILTER (r = least(n * 95 // 100, n - 1)) AS p95,
    max(latency_us) FILTER (r = least(n * 99 // 100, n - 1)) AS p99
    FROM (SELECT stream, latency_us, row_number() OVER (PARTITION BY stream ORDER BY latency_us) - 1 AS r,
          count(*) OVER (PARTITION BY stream) AS n FROM {TIMES}) GROUP BY stream"""


@query(
    f"""SELECT q.*, round(p50 / (SELECT CAST(p50 AS DOUBLE) FROM q WHERE stream = 'view'), 6) AS p50_ratio,
      round(p95 / (SELECT CAST(p95 AS DOUBLE) FROM q WHERE stream = 'view'), 6) AS p95_ratio,
      round(p99 / (SELECT CAST(p99 AS DOUBLE) FROM q WHERE stream = 'view'), 6) AS p99_ratio FROM q""",
    recursive=f"q AS ({PERCENTILES})",
)
def latency_percentiles(spark, d):
    found = reports.latency_percentiles(_times(spark, d), by=("stream",), baseline="view")
    return found.withColumns({f"p{p}_ratio": F.round(f"p{p}_ratio", 6) for p in (50, 95, 99)})


@query(PERCENTILES.replace("SELECT stream, max", "SELECT max", 1).replace("PARTITION BY stream ORDER", "ORDER").replace("OVER (PARTITION BY stream)", "OVER ()").replace(") GROUP BY stream", ")"))
def latency_percentiles_overall(spark, d):
    return reports.latency_percentiles(_times(spark, d))


@query("SELECT key, sequence, count(*) AS copies, count(*) - 1 AS extra FROM delivered GROUP BY key, sequence HAVING count(*) > 1")
def duplicates(spark, d):
    return audit.duplicates(I.delivered(spark, d))


def _raw_epochs(spark, d):
    """Buffered raw messages with the epoch that replays them."""
    plan = replay.replay_plan(I.published(spark, d), I.config_log(spark), I.PREFIX)
    buffered = plan.where(F.col("phase") == replay.PHASE_REPLAY).select("stream_seq", "epoch")
    return I.raw_messages(spark, d).join(buffered, "stream_seq")


@query(
    """SELECT epoch, partition, CASE WHEN partition IS NULL THEN 'dead_lettered' ELSE 'replayed' END AS outcome,
      count(*) AS messages
    FROM (SELECT p.epoch, CASE WHEN g.stream_seq IS NULL THEN NULL ELSE p.partition END AS partition
          FROM planned p LEFT JOIN good g USING (stream_seq) WHERE p.phase = 0)
    GROUP BY epoch, partition"""
)
def replay_summary(spark, d):
    good, bad = codec.decode_messages(_raw_epochs(spark, d))
    counts = F.when(F.col("epoch") == 3, 5).otherwise(2)
    return replay.replay_summary(good.withColumn("partition", keys.partition_for_key("key", counts)), bad)


@query("SELECT stream, array_to_string(list_sort(list(DISTINCT partition)), ',') AS partitions FROM stream_log GROUP BY stream")
def active_partitions(spark, d):
    found = reports.active_partitions(I.stream_log(spark, d))
    return found.withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


STREAM_KEYS = """(SELECT p.stream, p.key, p.published, coalesce(c.consumed, 0) AS consumed, c.partition,
      coalesce(c.gaps, 0) AS gaps, coalesce(c.gap_total, 0) AS gap_total,
      CAST(row_number() OVER (PARTITION BY p.stream ORDER BY p.key) - 1 AS BIGINT) // 10 AS piece
    FROM (SELECT payload AS stream, key, max(sequence) AS published FROM published GROUP BY ALL) p
    LEFT JOIN (SELECT payload AS stream, key, arg_max(sequence, arrival) AS consumed, arg_max(partition, arrival) AS partition,
        count(*) FILTER (missing > 0) AS gaps, CAST(sum(missing) AS BIGINT) AS gap_total
      FROM (SELECT *, greatest(coalesce(sequence - lag(sequence) OVER (PARTITION BY payload, key ORDER BY arrival) - 1, 0), 0)
        AS missing FROM delivered) GROUP BY ALL) c USING (stream, key))"""
KEY_STATUS = """CASE WHEN gap_total > 0 THEN 'MISSING' WHEN consumed > published + 5 THEN 'MISMATCH'
    WHEN published = consumed THEN 'IN SYNC' WHEN published - consumed > 10 THEN 'LAGGING' ELSE 'OK' END"""


def _stream_sequences(spark, d):
    """Sequences of each stream and key, with the gaps of what arrived."""
    sent = I.stream_log(spark, d).groupBy("stream", "key").agg(F.max("sequence").alias("published"))
    seen = I.delivered(spark, d).withColumn("stream", F.col("payload"))
    arrived = segments.summarize(seen, ("stream", "key"), ("arrival",), ("partition",)).select(
        "stream",
        "key",
        F.col("last_sequence").alias("consumed"),
        "last.partition",
        "gaps",
        F.col("missing").alias("gap_total"),
    )
    counts = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("consumed", "gaps", "gap_total")}
    both = sent.join(arrived, ["stream", "key"], "left").withColumns(counts)
    status, _ = reports.lag_status(F.col("published"), F.col("consumed"), F.col("gap_total"))
    return both.withColumns({"lag": F.col("published") - F.col("consumed"), "status": status})


def _status(spark, d):
    routed = _routed(spark, d).withColumn("stream", F.col("payload"))
    config = routed.groupBy("stream").agg(
        F.max_by("partition_count", "stream_seq").alias("partition_count"),
        F.max_by("mode", "stream_seq").alias("mode"),
    )
    held = routed.select("stream", "stream_seq", "mode").join(I.raw_messages(spark, d), "stream_seq")
    info = lambda mode: reports.stream_info(held.where(F.col("mode") == mode))
    return reports.status_snapshot(
        config,
        info("direct"),
        info("buffer"),
        _consumer_info(spark, d),
        _stream_sequences(spark, d),
        reports.active_partitions(I.stream_log(spark, d)),
        piece_keys=10,
    )


@query(
    f"""SELECT c.stream, upper(c.stream) AS prefix, upper(c.stream) || '_DLQ' AS dlq,
      c.partition_count, c.mode = 'buffer' AS buffering, coalesce(di.n, 0) AS direct_messages,
      coalesce(di.b, 0) AS direct_bytes, coalesce(bi.n, 0) AS buffer_messages, coalesce(bi.b, 0) AS buffer_bytes,
      coalesce(k.consumers, 0) AS consumers, coalesce(k.delivered, 0) AS delivered,
      coalesce(k.pending, 0) AS pending, coalesce(k.ack_pending, 0) AS ack_pending,
      coalesce(k.listed, '') AS consumer_list, a.partitions,
      coalesce(s.keys, 0) AS keys, coalesce(s.published, 0) AS published, coalesce(s.consumed, 0) AS consumed,
      coalesce(s.mismatched, 0) AS mismatched_keys, coalesce(s.gap_keys, 0) AS gap_keys, coalesce(s.pieces, 1) AS pieces
    FROM (SELECT payload AS stream, arg_max(partition_count, stream_seq) AS partition_count,
            arg_max(mode, stream_seq) AS mode FROM routed GROUP BY payload) c
    LEFT JOIN (SELECT payload AS stream, count(*) AS n, CAST(sum(strlen(data)) AS BIGINT) AS b
          FROM routed JOIN raw_messages USING (stream_seq) WHERE mode = 'direct' GROUP BY payload) di USING (stream)
    LEFT JOIN (SELECT payload AS stream, count(*) AS n, CAST(sum(strlen(data)) AS BIGINT) AS b
          FROM routed JOIN raw_messages USING (stream_seq) WHERE mode = 'buffer' GROUP BY payload) bi USING (stream)
    LEFT JOIN (SELECT stream, count(*) AS consumers, CAST(sum(delivered) AS BIGINT) AS delivered,
            CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(ack_pending) AS BIGINT) AS ack_pending,
            string_agg(concat(name, ':', delivered, '/', pending, '/', ack_pending), ' ' ORDER BY partition) AS listed
          FROM consumer_counts GROUP BY stream) k USING (stream)
    LEFT JOIN (SELECT stream, array_to_string(list_sort(list(DISTINCT partition)), ',') AS partitions
          FROM stream_log GROUP BY stream) a USING (stream)
    LEFT JOIN (SELECT stream, count(*) AS keys, CAST(sum(published) AS BIGINT) AS published,
            CAST(sum(consumed) AS BIGINT) AS consumed, count(*) FILTER ({KEY_STATUS} = 'MISMATCH') AS mismatched,
            count(*) FILTER (gap_total > 0) AS gap_keys, count(DISTINCT piece) AS pieces
          FROM {STREAM_KEYS} GROUP BY stream) s USING (stream)"""
)
def status_snapshot(spark, d):
    """One row per stream: what all its pieces say, with lists as text."""
    found = _status(spark, d)
    one = found.withColumns(
        {
            "prefix": F.col("names.subject_prefix"),
            "dlq": F.col("names.dlq_stream"),
            "consumer_list": F.array_join(
                F.transform(
                    "consumer_list",
                    lambda c: F.concat(
                        c["name"],
                        F.lit(":"),
                        F.concat_ws("/", *[c[n].cast("string") for n in ("delivered", "pending", "ack_pending")]),
                    ),
                ),
                " ",
            ),
            "partitions": F.array_join(F.col("partitions").cast("array<string>"), ","),
        }
    ).drop("names", "sequences")
    same = [c for c in one.columns if c != "piece"]
    return one.groupBy(*same).agg(F.count(F.lit(1)).alias("pieces"))


@query(
    f"""SELECT stream, piece, key, published, consumed, partition, gaps, gap_total, published - consumed AS lag,
      {KEY_STATUS} AS status FROM {STREAM_KEYS}"""
)
def status_snapshot_sequences(spark, d):
    """The maps of all pieces, a row for each key."""
    found = _status(spark, d).select("stream", "piece", F.explode("sequences").alias("key", "s"))
    return found.select("stream", "piece", "key", "s.*")


# ---- ordered ------------------------------------------------------------------------------

AUDIT_SQL = "SELECT key, run, partition, arrival, sequence, prev_sequence, status, missing FROM audit_run"
AUDIT_COLUMNS = ["key", "run", "partition", "arrival", "sequence", "prev_sequence", "status", "missing"]


@query(AUDIT_SQL)
def ordering_audit(spark, d):
    return _audit(spark, d).select(*AUDIT_COLUMNS)


@query(
    "SELECT key, received, first_index, first_index + 1 AS want_sequence, got_sequence,"
    " first_index IS NULL AS complete FROM positions"
)
def position_check(spark, d):
    return audit.position_check(I.delivered(spark, d))


@query("SELECT * FROM runs")
def sequence_runs(spark, d):
    return audit.sequence_runs(I.delivered(spark, d))


@query(
    """SELECT key, CAST((run_no - 1) // 10000 AS BIGINT) AS piece, string_agg(CASE WHEN first_sequence = last_sequence
      THEN CAST(first_sequence AS VARCHAR) ELSE concat(first_sequence, '-', last_sequence) END, ', ' ORDER BY run_no) AS summary
    FROM runs GROUP BY ALL"""
)
def summarize_sequences(spark, d):
    return audit.summarize_sequences(I.delivered(spark, d))


@query("SELECT stream_seq, key, sequence FROM published")
def assign_sequence(spark, d):
    sent = I.events(spark, d).select(F.col("event_id").alias("stream_seq"), I.acct().alias("key"))
    return audit.assign_sequence(sent, ("stream_seq",))


@query(
    """SELECT count(*) AS received, count(*) FILTER (sequence <= p) AS violations,
      count(*) - count(DISTINCT (key, sequence)) AS duplicates
    FROM (SELECT *, lag(sequence) OVER (PARTITION BY key ORDER BY ts, arrival) AS p FROM delivered)"""
)
def publish_order_check(spark, d):
    return audit.publish_order_check(I.delivered(spark, d))


@query(
    """SELECT stream, sample_seq, unnest(list_filter([
        CASE WHEN old_count > 0 AND old_count <> partition_count THEN format('scaled {} -> {}', old_count, partition_count) END,
        CASE WHEN old_mode <> mode THEN 'switched to ' || mode END], lambda e: e IS NOT NULL)) AS event
    FROM (SELECT *, lag(partition_count) OVER w AS old_count, lag(mode) OVER w AS old_mode
      FROM (SELECT stream, sample_seq, partition_count, CASE WHEN pending > 1000 THEN 'buffer' ELSE 'direct' END AS mode
            FROM lag_samples) WINDOW w AS (PARTITION BY stream ORDER BY sample_seq))"""
)
def config_changes(spark, d):
    mode = F.when(F.col("pending") > 1000, F.lit("buffer")).otherwise(F.lit("direct"))
    return routing.config_changes(
        I.lag_samples(spark, d).select("stream", "sample_seq", "partition_count", mode.alias("mode"))
    )


# ---- sort, top-k, set operations -----------------------------------------------------------

PLANNED_SQL = "SELECT stream_seq, ts, key, user_id, sequence, payload, epoch, phase, partition, subject FROM planned"


def _planned(spark, d, **options):
    return replay.replay_plan(I.published(spark, d), I.config_log(spark), I.PREFIX, **options)


@query(
    """SELECT partition, epoch, phase, stream_seq,
    row_number() OVER (PARTITION BY partition ORDER BY epoch, phase, stream_seq) AS position FROM planned"""
)
def delivery_order(spark, d):
    return replay.delivery_order(_planned(spark, d).select("partition", "epoch", "phase", "stream_seq"))


@query(
    "SELECT partition, key, arrival, prev_sequence, sequence FROM audit_run"
    " WHERE sequence < prev_sequence ORDER BY partition, key, arrival LIMIT 10"
)
def violation_examples(spark, d):
    return audit.violation_examples(_audit(spark, d))


@query(
    """SELECT partition, key, CAST((n - 1) // 10000 AS BIGINT) AS piece, string_agg(sequence, ',' ORDER BY n) AS sequences
    FROM (SELECT *, row_number() OVER (PARTITION BY partition, key ORDER BY arrival) AS n FROM delivered) GROUP BY ALL"""
)
def sequence_lists(spark, d):
    listed = audit.sequence_lists(I.delivered(spark, d))
    return listed.withColumn("sequences", F.array_join(F.col("sequences").cast("array<string>"), ","))


@query(
    """SELECT stream_seq, key, sequence, epoch, phase FROM planned"""
)
def union_logs(spark, d):
    planned = _planned(spark, d).select("stream_seq", "key", "sequence", "epoch", "phase")
    part = lambda phase: planned.where(F.col("phase") == phase).drop("phase")
    return replay.union_logs(part(replay.PHASE_DIRECT), part(replay.PHASE_REPLAY))


@query(
    """SELECT key, sequence, 'missing' AS side FROM published
    WHERE (key, sequence) NOT IN (SELECT (key, sequence) FROM delivered)"""
)
def missing_messages(spark, d):
    return completeness.missing_messages(I.expected(spark, d), I.delivered(spark, d))


@query(
    """SELECT key, sequence, 'missing' AS side FROM published JOIN expected USING (key)
    WHERE sequence <= expected - 20 AND (key, sequence) NOT IN (SELECT (key, sequence) FROM delivered)
    UNION ALL SELECT DISTINCT key, sequence, 'unexpected' FROM delivered JOIN expected USING (key)
    WHERE sequence > expected - 20"""
)
def unexpected_messages(spark, d):
    """Both sides: 20 messages fewer per key are expected than were sent."""
    fewer = I.expected(spark, d).withColumn("expected", F.col("expected") - 20)
    return completeness.missing_messages(fewer, I.delivered(spark, d))


# ---- repartition and replay ------------------------------------------------------------------


@query(PLANNED_SQL)
def replay_plan(spark, d):
    return _planned(spark, d)


#: An epoch of no partitions, one of too many, one without a count, and nothing before the third day.
ODD_CONFIG = [
    (1, "2024-01-03 00:00:00", "direct", 3),
    (2, "2024-01-08 00:00:00", "buffer", 3),
    (3, "2024-01-09 00:00:00", "direct", 0),
    (4, "2024-01-13 00:00:00", "direct", 50),
    (5, "2024-01-17 00:00:00", "direct", None),
    (6, "2024-01-20 00:00:00", "buffer", 3),
    (7, "2024-01-21 00:00:00", "direct", 20),
    (8, "2024-01-27 00:00:00", "buffer", 20),
]
ODD_ROWS = ", ".join(f"({r}, TIMESTAMP '{t}', '{m}', {'NULL' if n is None else n})" for r, t, m, n in ODD_CONFIG)
ODD_EPOCHS = f"""(SELECT p.stream_seq, p.key, p.ts, p.user_id, c.mode, e.revision AS epoch, e.n
    FROM published p
    ASOF LEFT JOIN (SELECT * FROM (VALUES {ODD_ROWS}) t(revision, ts, mode, n)) c ON p.ts >= c.ts
    LEFT JOIN (SELECT * FROM (VALUES {ODD_ROWS}) t(revision, ts, mode, n) WHERE mode = 'direct') e
      ON e.revision = CASE WHEN c.mode = 'direct' THEN c.revision WHEN c.revision = 2 THEN 3 WHEN c.revision = 6 THEN 7 END)"""
ODD_USABLE = "coalesce(epoch IS NULL OR n BETWEEN 1 AND 20, false) AND mode IS NOT NULL"


def _odd_plan(spark, d):
    config = spark.createDataFrame(ODD_CONFIG, "revision int, t string, mode string, partition_count int")
    config = config.withColumn("effective_ts", F.col("t").cast("timestamp_ntz")).drop("t")
    rows = I.published(spark, d).select("stream_seq", "key", "ts")
    return replay.split_plan(rows, config, I.PREFIX)


@query(
    f"""SELECT stream_seq, key, ts, CAST(epoch AS INTEGER) AS epoch, CASE WHEN mode = 'buffer' THEN 0 ELSE 1 END AS phase,
      CAST(user_id % n AS INTEGER) AS partition, CASE WHEN n IS NOT NULL THEN format('LEDGER.{{:02d}}', user_id % n) END AS subject
    FROM {ODD_EPOCHS} WHERE {ODD_USABLE}"""
)
def planned_messages(spark, d):
    """The plan under a history that has unusable counts."""
    return _odd_plan(spark, d)[0]


@query(
    f"""SELECT stream_seq, key, ts,
      CASE WHEN mode IS NULL THEN 'no configuration' ELSE 'unusable partition count' END AS reject_reason
    FROM {ODD_EPOCHS} WHERE NOT ({ODD_USABLE})"""
)
def unplanned_messages(spark, d):
    return _odd_plan(spark, d)[1]


REPLAY_SQL = """SELECT g.stream_seq, g.key, g.sequence, g.payload,
    CAST(CAST(substr(g.key, 6) AS BIGINT) % 5 AS INTEGER) AS partition, g.ts,
    format('LEDGER.{:02d}', CAST(substr(g.key, 6) AS BIGINT) % 5) AS subject,
    concat('replay-', g.key, '-', g.sequence) AS id FROM good g"""


@query(REPLAY_SQL + " WHERE CAST(substr(g.key, 6) AS BIGINT) % 7 <> 0")
def replay_buffer(spark, d):
    """Replay to five partitions; every seventh user was replayed before."""
    done = I.published(spark, d).where("user_id % 7 = 0").select(keys.replay_id("key", "sequence").alias("id"))
    good, _ = replay.replay_buffer(I.raw_messages(spark, d), 5, I.PREFIX, done)
    return good


@query(
    "SELECT stream_seq, key, sequence, payload, CAST(user_id % 5 AS INTEGER) AS partition,"
    " epoch_us(ts) * 1000 AS ts FROM published"
)
def repartition_log(spark, d):
    """Three partitions to five."""
    out = scratch_path(spark, "repartitioned")
    replay.repartition_log(spark, _message_log(spark, d), out, 5, old_count=3)
    return log.read_log(spark, out)


@query(REPLAY_SQL)
def replay_stream(spark, d):
    source = scratch_path(spark, "buffer")
    raw = I.raw_messages(spark, d)
    # Written in ranges of the log, so that micro-batches are several files in order.
    raw.repartitionByRange(4, "stream_seq").write.parquet(source)
    out, dead, ckpt = (scratch_path(spark, n) for n in ("replayed", "dead", "ckpt"))
    stream = log.read_log_stream(spark, source, max_files=2, schema=raw.schema)
    run(jobs.replay_stream(stream, out, dead, 5, I.PREFIX, ckpt, NOW_NS))
    return spark.read.schema(jobs.REPLAYED).parquet(out).drop("batch_id")


# ---- streaming --------------------------------------------------------------------------------


def _in_slices(df: DataFrame, position: str, bounds: tuple[int, ...], start) -> None:
    """Append a source slice by slice and let a restarted query take each one up."""
    spark = df.sparkSession
    source, ckpt = scratch_path(spark, "source"), scratch_path(spark, "ckpt")
    table = scratch_path(spark, "slices")
    number = F.lit(0)
    for b in bounds:
        number = number + (F.col(position) >= b).cast("int")
    df.withColumn("_slice", number).write.partitionBy("_slice").parquet(table)
    slices = spark.read.parquet(table)
    for i in range(len(bounds) + 1):
        part = slices.where(F.col("_slice") == i).select(*df.columns)
        part.write.mode("append").parquet(source)
        run(start(log.read_log_stream(spark, source, schema=df.schema), ckpt))


def _to_files(df: DataFrame, out: str, ckpt: str):
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start(out)
    )


def _audit_in_slices(spark, d, **options) -> DataFrame:
    out, state = scratch_path(spark, "audit"), scratch_path(spark, "state")
    rows = I.delivered(spark, d).select("key", "run", "partition", "arrival", "sequence")
    start = lambda s, ckpt: jobs.audit_batches(s, out, state, ckpt, **options)
    _in_slices(rows, "arrival", (200, 450), start)
    return jobs.read_batches(spark, out).select(*AUDIT_COLUMNS)


@query(AUDIT_SQL)
def audit_stream(spark, d):
    """Three slices of arrivals, with the state kept across restarts; slices bounded by rank."""
    return _audit_in_slices(spark, d)


@query(AUDIT_SQL)
def audit_batches(spark, d):
    """The same with every key cut into ranges of arrivals."""
    return _audit_in_slices(spark, d, span=100)


@query(ROUTED_SQL)
def route_stream(spark, d):
    source = I.stored(I.published(spark, d), "published")
    config = I.stored(I.config_log(spark), "config")
    out, bad, ckpt = (scratch_path(spark, n) for n in ("routed", "unrouted", "ckpt"))
    schema = spark.read.parquet(source).schema
    stream = log.read_log_stream(spark, source, schema=schema)
    run(jobs.route_stream(stream, lambda s: s.read.parquet(config), I.PREFIX, out, bad, ckpt))
    return jobs.read_batches(spark, out).drop("batch_id")


@query(
    f"""SELECT stream_seq, key AS text, 'message' AS kind FROM good
    UNION ALL SELECT NULL, data, 'unmarshal_failure' FROM bad"""
)
def decode_stream(spark, d):
    raw = I.raw_messages(spark, d)
    source = I.stored(raw, "raw")
    good, dead, ckpt = (scratch_path(spark, n) for n in ("good", "dead", "ckpt"))
    stream = log.read_log_stream(spark, source, schema=raw.schema)
    run(jobs.decode_stream(stream, good, dead, I.PREFIX, ckpt, NOW_NS))
    kept = jobs.read_batches(spark, good).select("stream_seq", F.col("key").alias("text"), F.lit("message").alias("kind"))
    lost = jobs.read_batches(spark, dead).select(
        F.lit(None).cast("bigint").alias("stream_seq"), F.col("data").cast("string").alias("text"), F.col("reason").alias("kind")
    )
    return kept.unionByName(lost)


SQL_DEDUP = (
    "SELECT p.stream_seq, p.id, p.ts FROM (SELECT id, t FROM chain) c JOIN"
    " (SELECT key AS id, ts, min(stream_seq) AS stream_seq FROM published GROUP BY key, ts) p"
    " ON p.id = c.id AND p.ts = c.t"
)
SQL_DEDUP_CHAIN = """chain AS (
      SELECT key AS id, min(ts) AS t FROM published GROUP BY key
      UNION ALL
      SELECT c.id, (SELECT min(p.ts) FROM published p WHERE p.key = c.id AND p.ts >= c.t + INTERVAL '12' HOUR)
      FROM chain c WHERE EXISTS (SELECT 1 FROM published p WHERE p.key = c.id AND p.ts >= c.t + INTERVAL '12' HOUR))"""


@query(SQL_DEDUP, recursive=SQL_DEDUP_CHAIN)
def dedup_window(spark, d):
    rows = I.published(spark, d).select("stream_seq", F.col("key").alias("id"), "ts")
    return spacing.dedup_window(rows, window="12 hours")


@query(
    "SELECT p.stream_seq, p.id, p.ts FROM (SELECT id, t FROM chain) c JOIN"
    " (SELECT payload AS id, ts, min(stream_seq) AS stream_seq FROM published GROUP BY payload, ts) p"
    " ON p.id = c.id AND p.ts = c.t",
    recursive="""chain AS (
      SELECT payload AS id, min(ts) AS t FROM published GROUP BY payload
      UNION ALL
      SELECT c.id, (SELECT min(p.ts) FROM published p WHERE p.payload = c.id AND p.ts >= c.t + INTERVAL '6' HOUR)
      FROM chain c WHERE EXISTS (SELECT 1 FROM published p WHERE p.payload = c.id AND p.ts >= c.t + INTERVAL '6' HOUR))""",
)
def dedup_window_hot(spark, d):
    """A few ids with very many copies each, which takes the pointer-doubling way."""
    rows = I.published(spark, d).select("stream_seq", F.col("payload").alias("id"), "ts")
    return spacing.dedup_window(rows, window="6 hours", fold_rows=100)


@query(SQL_DEDUP, recursive=SQL_DEDUP_CHAIN)
def dedup_stream(spark, d):
    """The same rows in three slices of time, with what was kept carried from one to the next."""
    rows = I.published(spark, d).select("stream_seq", F.col("key").alias("id"), "ts")
    rows = rows.withColumn("day", F.datediff(F.col("ts"), F.lit("2024-01-01")))
    out, kept = scratch_path(spark, "deduped"), scratch_path(spark, "kept")
    start = lambda s, ckpt: jobs.dedup_stream(s, out, kept, ckpt, window="12 hours")
    _in_slices(rows, "day", (10, 20), start)
    return jobs.read_batches(spark, out).select("stream_seq", "id", "ts")


@query(
    "SELECT p.stream, p.n AS stream_seq, p.ts FROM (SELECT stream, t FROM chain) c JOIN (SELECT stream, ts, min(n) AS n"
    " FROM numbered GROUP BY stream, ts) p ON p.stream = c.stream AND p.ts = c.t",
    recursive="""numbered AS (SELECT payload AS stream, ts, row_number() OVER (PARTITION BY payload ORDER BY stream_seq) AS n
      FROM published),
    chain AS (
      SELECT stream, min(ts) AS t FROM numbered GROUP BY stream
      UNION ALL
      SELECT c.stream, (SELECT min(p.ts) FROM numbered p WHERE p.stream = c.stream AND p.ts >= c.t + INTERVAL '12' HOUR)
      FROM chain c WHERE EXISTS (SELECT 1 FROM numbered p WHERE p.stream = c.stream AND p.ts >= c.t + INTERVAL '12' HOUR))""",
)
def dedup_window_per_stream(spark, d):
    """Positions count from 1 in each stream."""
    rows = audit.assign_sequence(
        I.published(spark, d).select("stream_seq", F.col("payload").alias("key"), "ts"), ("stream_seq",)
    )
    rows = rows.select(F.col("key").alias("stream"), F.col("sequence").alias("stream_seq"), "ts")
    return spacing.dedup_window(rows, id="stream", window="12 hours")


@query("SELECT * FROM windows")
def lag_windows(spark, d):
    return reports.lag_windows(I.lag_samples(spark, d))


@query("SELECT * FROM windows")
def lag_windows_stream(spark, d):
    """Three slices of the samples, the newest ones first: what is late counts all the same."""
    rows = I.lag_samples(spark, d).withColumn("day", -F.datediff(F.col("ts"), F.lit("2024-01-01")))
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "state")
    start = lambda s, ckpt: jobs.lag_stream(s.drop("day"), out, state, ckpt)
    _in_slices(rows, "day", (-20, -10), start)
    updates = jobs.read_batches(spark, out)
    last = [c for c in updates.columns if c not in ("stream", "window_start", "batch_id")]
    return updates.groupBy("stream", "window_start").agg(*[F.max_by(c, "batch_id").alias(c) for c in last])


@query("SELECT * FROM windows")
def lag_windows_batches(spark, d):
    """All windows from the state, after micro-batches of one file."""
    rows = I.lag_samples(spark, d)
    source, out, state, ckpt = (scratch_path(spark, n) for n in ("samples", "windows", "state", "ckpt"))
    rows.repartition(3, "sample_seq").write.parquet(source)
    stream = log.read_log_stream(spark, source, max_files=1, schema=rows.schema)
    run(jobs.lag_stream(stream, out, state, ckpt))
    return jobs.latest_lag_windows(spark, state)


SCALE_CHAIN = """asked AS (
      SELECT *, CASE WHEN lag > 5000 AND partition_count < 10 THEN 1
        WHEN lag < 500 AND partition_count > 1 THEN -1 END AS step FROM windows),
    chain AS (
      SELECT stream, min(ts) AS t FROM asked WHERE step IS NOT NULL GROUP BY stream
      UNION ALL
      SELECT c.stream, (SELECT min(p.ts) FROM asked p WHERE step IS NOT NULL AND p.stream = c.stream AND p.ts >= c.t + INTERVAL '6' HOUR)
      FROM chain c WHERE EXISTS (SELECT 1 FROM asked p WHERE step IS NOT NULL AND p.stream = c.stream AND p.ts >= c.t + INTERVAL '6' HOUR))"""
SCALE_SQL = """SELECT a.stream, a.window_start, a.ts, a.sample_seq, a.partition_count, a.lag, a.step,
    a.partition_count + a.step AS desired FROM chain c JOIN asked a ON a.stream = c.stream AND a.ts = c.t"""


@query(SCALE_SQL, recursive=SCALE_CHAIN)
def scale_recommendations(spark, d):
    return spacing.scale_recommendations(reports.lag_windows(I.lag_samples(spark, d)), cooldown="6 hours")


@query(SCALE_SQL, recursive=SCALE_CHAIN)
def scale_recommendations_stream(spark, d):
    """The same on a stream, in three slices of time."""
    rows = reports.lag_windows(I.lag_samples(spark, d))
    out = scratch_path(spark, "recommended")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01")).alias("day")
    rows = rows.withColumn("day", day)
    start = lambda s, ckpt: _to_files(
        stateful.scale_recommendations_stream(s.drop("day"), cooldown="6 hours"), out, ckpt
    )
    _in_slices(rows, "day", (10, 20), start)
    return spark.read.parquet(out)


@query(
    "SELECT kv_key, value_json, ts FROM (SELECT concat('pub.', key) AS kv_key, arg_max(concat('{\"sequence\":', sequence, '}'),"
    " stream_seq) AS value_json, max(ts) AS ts FROM published GROUP BY key)"
    " WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '12' HOUR"
)
def sequence_state(spark, d):
    """State of keys that were active in the last half day."""
    from datetime import datetime, timedelta

    written = I.published(spark, d).select(
        F.concat(F.lit("pub."), "key").alias("kv_key"),
        F.concat(F.lit('{"sequence":'), F.col("sequence").cast("string"), F.lit("}")).alias("value_json"),
        F.col("stream_seq").alias("revision"),
        "ts",
    )
    now = F.lit(datetime(2024, 1, 30, 12)).cast("timestamp_ntz")
    return reports.ttl_state(written, now, F.lit(timedelta(hours=12)))


ACCOUNT_SQL = """SELECT 'consumer' AS source, key, sequence, CAST(partition AS BIGINT) AS partition, gaps, gap_total, violations
    FROM accounts JOIN (SELECT key, count(*) FILTER (status = 'violation') AS violations FROM audit_key GROUP BY key)
    USING (key)"""


@query(
    f"""SELECT *, false AS expired FROM ({ACCOUNT_SQL} UNION ALL
    SELECT 'producer', key, max(sequence), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
    FROM published GROUP BY key)"""
)
def sequence_state_stream(spark, d):
    """Latest account per source and key: what was sent, and what arrived in three slices."""
    out, state = scratch_path(spark, "accounts"), scratch_path(spark, "state")
    seen = I.delivered(spark, d).select(F.lit("consumer").alias("source"), "key", "arrival", "sequence", "partition")
    sent = I.published(spark, d).select(
        F.lit("producer").alias("source"),
        "key",
        (F.col("sequence") * 10).alias("arrival"),
        "sequence",
        F.lit(None).cast("bigint").alias("partition"),
    )
    start = lambda s, ckpt: jobs.account_stream(s, out, state, ckpt, "1 day")
    _in_slices(seen.unionByName(sent), "arrival", (200, 450), start)
    updates = jobs.read_batches(spark, out)
    last = [c for c in updates.columns if c not in ("source", "key", "batch_id")]
    return updates.groupBy("source", "key").agg(*[F.max_by(c, "batch_id").alias(c) for c in last])


def _status_after_slices(spark, d) -> str:
    """The state of a status stream after three slices of what arrived."""
    raw = I.raw_messages(spark, d)
    rows = I.delivered(spark, d).join(raw, "stream_seq").select(
        F.col("payload").alias("stream"), "data", "key", "arrival", "sequence", "partition"
    )
    out, state = scratch_path(spark, "status"), scratch_path(spark, "state")
    _in_slices(rows, "arrival", (200, 450), lambda s, ckpt: jobs.status_stream(s, out, state, ckpt))
    return state


@query(
    "SELECT payload AS stream, count(*) AS messages, CAST(sum(strlen(data)) AS BIGINT) AS bytes"
    " FROM delivered JOIN raw_messages USING (stream_seq) GROUP BY payload"
)
def status_stream(spark, d):
    """Totals kept up to date over three slices of arrivals."""
    return jobs.latest_status(spark, _status_after_slices(spark, d))


@query(ACCOUNT_SQL)
def status_stream_accounts(spark, d):
    """The accounts that the same job keeps."""
    return jobs.latest_accounts(spark, _status_after_slices(spark, d))


REDELIVERY_NOW = "2024-01-15 00:00:00"


@query(
    f"""SELECT *, CASE WHEN acked THEN 'acked' WHEN attempts >= 5 THEN 'max_delivery_exhausted'
      WHEN last_attempt_ts + INTERVAL '30' SECOND <= TIMESTAMP '{REDELIVERY_NOW}' THEN 'due' ELSE 'waiting' END AS status
    FROM attempts"""
)
def redelivery_report(spark, d):
    return delivery.redelivery_report(I.deliveries(spark, d), F.lit(REDELIVERY_NOW).cast("timestamp_ntz"))


# ---- user functions -----------------------------------------------------------------------------


@query(
    "SELECT event_id AS stream_seq, CAST(user_id % 3 AS INTEGER) AS partition,"
    " CAST(sum(length(event_type)) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS BIGINT) AS size FROM events"
)
def process_by_partition(spark, d):
    """A running total over the whole partition."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for rows in batches:
            size = total + rows["payload"].str.len().cumsum()
            total = int(size.iloc[-1])
            yield rows[["stream_seq", "partition"]].assign(size=size)

    return handlers.process_by_partition(
        I.messages(spark, d), sizes, "stream_seq bigint, partition int, size bigint", 3
    )


@query(
    """SELECT key, stream_seq, CAST(sum(length(payload)) OVER (PARTITION BY key ORDER BY stream_seq) AS BIGINT) AS so_far
    FROM published"""
)
def process_by_key(spark, d):
    """A running total over the whole key."""

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for rows in batches:
            so_far = total + rows["payload"].str.len().cumsum()
            total = int(so_far.iloc[-1])
            yield rows[["key", "stream_seq"]].assign(so_far=so_far)

    return handlers.process_by_key(I.messages(spark, d), running, "key string, stream_seq bigint, so_far bigint")


@query(
    """SELECT key, piece, stream_seq, CAST(sum(length(payload)) OVER (PARTITION BY key, piece ORDER BY stream_seq) AS BIGINT) AS so_far
    FROM (SELECT *, (sequence - 1) // 25 AS piece FROM published)"""
)
def process_by_piece(spark, d):
    def running(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["key", "piece", "stream_seq"]].assign(so_far=rows["payload"].str.len().cumsum())

    return handlers.process_by_piece(
        I.messages(spark, d), running, "key string, piece bigint, stream_seq bigint, so_far bigint", piece_rows=25
    )
