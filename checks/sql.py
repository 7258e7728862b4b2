"""The inputs of ``inputs.py`` as SQL, for use in a WITH clause."""

from __future__ import annotations

import re

VIEWS = {
    "published": """
SELECT event_id AS stream_seq, ts, concat('acct-', CAST(user_id AS VARCHAR)) AS key, user_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS sequence,
  event_type AS payload
FROM events""",
    "delivered": """
SELECT stream_seq, ts, key, sequence, payload,
  CASE WHEN sequence <= 30 THEN 1 ELSE 2 END AS run,
  CASE WHEN sequence <= 30 THEN user_id % 3 ELSE user_id % 5 END AS partition,
  sequence * 10 + CASE WHEN sequence % 7 = 0 THEN 35 ELSE 0 END AS arrival
FROM published WHERE sequence % 11 <> 0
UNION ALL
SELECT stream_seq, ts, key, sequence, payload,
  CASE WHEN sequence <= 30 THEN 1 ELSE 2 END AS run,
  CASE WHEN sequence <= 30 THEN user_id % 3 ELSE user_id % 5 END AS partition,
  sequence * 10 + 6 + CASE WHEN sequence % 7 = 0 THEN 35 ELSE 0 END AS arrival
FROM published WHERE sequence % 13 = 0 AND sequence % 11 <> 0""",
    "expected": "SELECT key, count(*) AS expected FROM published GROUP BY key",
    "config_log": """
SELECT * FROM (VALUES
  (1, TIMESTAMP '2024-01-01 00:00:00', 'direct', 3),
  (2, TIMESTAMP '2024-01-10 00:00:00', 'buffer', 3),
  (3, TIMESTAMP '2024-01-10 12:00:00', 'direct', 5),
  (4, TIMESTAMP '2024-01-20 00:00:00', 'buffer', 5),
  (5, TIMESTAMP '2024-01-20 12:00:00', 'direct', 2)
) AS t(revision, effective_ts, mode, partition_count)""",
    "changelog": """
SELECT event_id AS revision, ts AS effective_ts,
  CASE WHEN event_type = 'click' THEN 'mode' ELSE 'partition_count' END AS key,
  CASE WHEN event_type = 'click' THEN CASE WHEN value > 30 THEN 'buffer' ELSE 'direct' END
       WHEN event_type = 'error' THEN 'n/a'
       ELSE CAST(CAST(floor(value / 5) AS BIGINT) AS VARCHAR) END AS value
FROM events""",
    "messages": """
SELECT stream_seq, key, sequence, payload, 0 AS partition, epoch_us(ts) * 1000 AS ts FROM published""",
    "raw_messages": """
SELECT stream_seq, CASE
  WHEN stream_seq % 97 = 0 THEN 'not-valid-json'
  WHEN stream_seq % 89 = 0 THEN '{"key":1,"sequence":1}'
  WHEN stream_seq % 83 = 0 THEN '{"key":"a"}x'
  ELSE concat('{"key":"', key, '","sequence":', CAST(sequence AS VARCHAR), ',"payload":"', payload,
              '","partition":0,"ts":', CAST(stream_seq AS VARCHAR), '}') END AS data
FROM published""",
    # Rejected if not JSON, not an object, or a field has another type than its column.
    "decoded": """
SELECT stream_seq, data, doc, coalesce(json_type(doc) = 'OBJECT'
    AND coalesce(json_type(doc, '$.key'), 'VARCHAR') IN ('VARCHAR', 'NULL')
    AND coalesce(json_type(doc, '$.payload'), 'VARCHAR') IN ('VARCHAR', 'NULL')
    AND coalesce(json_type(doc, '$.sequence'), 'BIGINT') IN ('BIGINT', 'UBIGINT', 'NULL')
    AND coalesce(json_type(doc, '$.partition'), 'BIGINT') IN ('BIGINT', 'UBIGINT', 'NULL')
    AND coalesce(json_type(doc, '$.ts'), 'BIGINT') IN ('BIGINT', 'UBIGINT', 'NULL'), false) AS valid
FROM (SELECT stream_seq, data, CASE WHEN json_valid(data) THEN data END AS doc FROM raw_messages)""",
    "good": """
SELECT stream_seq, coalesce(json_extract_string(doc, '$.key'), '') AS key,
  coalesce(CAST(json_extract_string(doc, '$.sequence') AS BIGINT), 0) AS sequence,
  coalesce(json_extract_string(doc, '$.payload'), '') AS payload,
  coalesce(CAST(json_extract_string(doc, '$.partition') AS INTEGER), 0) AS partition,
  coalesce(CAST(json_extract_string(doc, '$.ts') AS BIGINT), 0) AS ts
FROM decoded WHERE valid""",
    "bad": """
SELECT stream_seq, data,
  CASE WHEN doc IS NOT NULL THEN 'JSON value is not a message' ELSE 'not a JSON value' END AS error
FROM decoded WHERE NOT valid""",
    "stream_log": """
SELECT payload AS stream, user_id % 3 AS partition, stream_seq, key, sequence, ts FROM published""",
    "deliveries": """
SELECT p.stream, p.partition, p.stream_seq, p.key, p.sequence, a.attempt,
  p.ts + INTERVAL '30' SECOND * (a.attempt - 1) AS attempt_ts,
  (a.attempt = 1 + p.stream_seq % 6 AND p.stream_seq % 17 <> 0) AS acked
FROM stream_log p JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS a(attempt)
  ON a.attempt <= 1 + p.stream_seq % 6
WHERE p.sequence % 11 <> 0""",
    "lag_samples": """
SELECT event_type AS stream, user_id % 3 AS partition, event_id AS sample_seq, ts,
  1 + user_id % 10 AS partition_count,
  CAST(floor(value * 50) AS BIGINT) AS pending, event_id % 100 AS ack_pending
FROM events""",
    "purges": """
SELECT * FROM (VALUES ('LEDGER.00', 100), ('LEDGER.01', 40), (NULL, 20)) AS t(subject, purge_seq)""",
    # Audits: previous arrival per run, partition and key, or per key alone.
    "audit_run": """
SELECT *, CASE WHEN sequence <= prev_sequence THEN 'violation'
               WHEN sequence > prev_sequence + 1 THEN 'gap' ELSE 'ok' END AS status,
  CAST(CASE WHEN sequence > prev_sequence + 1 THEN sequence - prev_sequence - 1 ELSE 0 END AS BIGINT) AS missing
FROM (SELECT *, lag(sequence) OVER (PARTITION BY run, partition, key ORDER BY arrival) AS prev_sequence
      FROM delivered)""",
    "audit_key": """
SELECT *, CASE WHEN sequence <= prev_sequence THEN 'violation'
               WHEN sequence > prev_sequence + 1 THEN 'gap' ELSE 'ok' END AS status,
  CAST(CASE WHEN sequence > prev_sequence + 1 THEN sequence - prev_sequence - 1 ELSE 0 END AS BIGINT) AS missing
FROM (SELECT *, lag(sequence) OVER (PARTITION BY key ORDER BY arrival) AS prev_sequence FROM delivered)""",
    "audit_partition": """
SELECT *, CASE WHEN sequence <= prev_sequence THEN 'violation'
               WHEN sequence > prev_sequence + 1 THEN 'gap' ELSE 'ok' END AS status,
  CAST(CASE WHEN sequence > prev_sequence + 1 THEN sequence - prev_sequence - 1 ELSE 0 END AS BIGINT) AS missing
FROM (SELECT *, lag(sequence) OVER (PARTITION BY partition, key ORDER BY arrival) AS prev_sequence FROM delivered)""",
    "kv_state": """
SELECT concat('pub.', key) AS kv_key,
  concat('{"sequence":', CAST(max(sequence) AS VARCHAR), ',"source":"producer"}') AS value_json
FROM published GROUP BY key HAVING max(ts) > TIMESTAMP '2024-01-30 00:00:00'
UNION ALL
SELECT concat('cons.p', CAST(partition AS VARCHAR), '.', key),
  concat('{"sequence":', CAST(max(sequence) AS VARCHAR), ',"partition":', CAST(partition AS VARCHAR), ',"source":"consumer"',
    CASE WHEN partition > 0 THEN concat(
      CASE WHEN count(*) FILTER (status = 'gap') > 0 THEN concat(',"gaps":', count(*) FILTER (status = 'gap')) END,
      CASE WHEN sum(missing) > 0 THEN concat(',"gap_total":', CAST(sum(missing) AS VARCHAR)) END,
      CASE WHEN count(*) FILTER (status = 'violation') > 0 THEN concat(',"violations":', count(*) FILTER (status = 'violation')) END)
    END, '}')
FROM audit_partition GROUP BY key, partition HAVING max(ts) > TIMESTAMP '2024-01-29 12:00:00'""",
    "runs": """
SELECT key, run_no, min(sequence) AS first_sequence, max(sequence) AS last_sequence
FROM (SELECT key, arrival, sequence, CAST(sum(start) OVER (PARTITION BY key ORDER BY arrival) AS BIGINT) AS run_no
      FROM (SELECT key, arrival, sequence,
              CASE WHEN sequence = lag(sequence) OVER (PARTITION BY key ORDER BY arrival) + 1
                   THEN 0 ELSE 1 END AS start FROM delivered))
GROUP BY key, run_no""",
    "positions": """
SELECT key, count(*) AS received, min(CASE WHEN sequence <> n THEN n - 1 END) AS first_index,
  min_by(sequence, n) FILTER (sequence <> n) AS got_sequence
FROM (SELECT key, sequence, row_number() OVER (PARTITION BY key ORDER BY sequence) AS n FROM delivered)
GROUP BY key""",
    "routed": """
SELECT p.*, c.mode, c.partition_count, c.revision,
  CAST(p.user_id % c.partition_count AS INTEGER) AS partition,
  CASE WHEN c.mode = 'buffer' THEN 'LEDGER_BUFFER'
       ELSE format('LEDGER.{:02d}', p.user_id % c.partition_count) END AS subject
FROM published p ASOF JOIN config_log c ON p.ts >= c.effective_ts""",
    "epochs": """
SELECT c.revision, c.mode, min(d.revision) AS epoch, min_by(d.partition_count, d.revision) AS epoch_count
FROM config_log c JOIN config_log d ON d.mode = 'direct' AND d.revision >= c.revision
GROUP BY c.revision, c.mode""",
    "planned": """
SELECT r.stream_seq, r.ts, r.key, r.user_id, r.sequence, r.payload, e.epoch,
  CASE WHEN e.mode = 'buffer' THEN 0 ELSE 1 END AS phase,
  CAST(r.user_id % e.epoch_count AS INTEGER) AS partition,
  format('LEDGER.{:02d}', r.user_id % e.epoch_count) AS subject
FROM routed r JOIN epochs e ON r.revision = e.revision""",
    "attempts": """
SELECT stream, partition, stream_seq, count(*) AS attempts, max(attempt_ts) AS last_attempt_ts,
  bool_or(acked) AS acked FROM deliveries GROUP BY stream, partition, stream_seq""",
    "delivery_state": """
SELECT p.*, coalesce(a.attempts, 0) AS attempts,
  CASE WHEN a.attempts IS NULL THEN 'pending' WHEN NOT a.acked THEN 'ack_pending' END AS state
FROM stream_log p LEFT JOIN attempts a USING (stream, partition, stream_seq)""",
    "consumer_counts": """
SELECT stream, partition, CAST(sum(attempts) AS BIGINT) AS delivered,
  count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'ack_pending') AS ack_pending,
  concat('consumer-p', CAST(partition AS VARCHAR)) AS name
FROM delivery_state GROUP BY stream, partition HAVING sum(attempts) > 0""",
    "state_keys": """
SELECT kv_key, value_json,
  CASE WHEN starts_with(kv_key, 'pub.') THEN 'producer'
       WHEN regexp_matches(kv_key, '^cons[.][^.]*[.]') THEN 'consumer' END AS source,
  CAST(nullif(regexp_extract(kv_key, '^cons[.]p([0-9]+)[.]', 1), '') AS BIGINT) AS partition,
  CASE WHEN starts_with(kv_key, 'pub.') THEN substr(kv_key, 5)
       ELSE nullif(regexp_extract(kv_key, '^cons[.][^.]*[.](.*)$', 1), '') END AS key,
  coalesce(CAST(value_json->>'$.sequence' AS BIGINT), 0) AS sequence,
  coalesce(CAST(value_json->>'$.gaps' AS BIGINT), 0) AS gaps,
  coalesce(CAST(value_json->>'$.gap_total' AS BIGINT), 0) AS gap_total,
  coalesce(CAST(value_json->>'$.violations' AS BIGINT), 0) AS violations
FROM kv_state""",
    # The same for every report, expired or not.
    "all_state_keys": """
SELECT concat('pub.', key) AS kv_key, 'producer' AS source, CAST(NULL AS BIGINT) AS partition, key
FROM published GROUP BY key
UNION ALL
SELECT concat('cons.p', CAST(partition AS VARCHAR), '.', key), 'consumer', partition, key
FROM delivered GROUP BY key, partition""",
    "consumed": """
SELECT key, max(sequence) AS sequence, arg_max(partition, (sequence, -partition)) AS partition,
  arg_max(gaps, (sequence, -partition)) AS gaps, arg_max(gap_total, (sequence, -partition)) AS gap_total,
  arg_max(violations, (sequence, -partition)) AS violations
FROM state_keys WHERE source = 'consumer' GROUP BY key""",
    "accounts": """
SELECT key, arg_max(sequence, arrival) AS sequence, arg_max(partition, arrival) AS partition,
  count(*) FILTER (status = 'gap') AS gaps, CAST(sum(missing) AS BIGINT) AS gap_total
FROM audit_key GROUP BY key""",
    "windows": """
SELECT stream, w AS window_start, w + INTERVAL '10' SECOND AS ts, max(last_seq) AS sample_seq,
  arg_max(partition_count, last_seq) AS partition_count, CAST(sum(lag) AS BIGINT) AS lag
FROM (SELECT stream, partition, time_bucket(INTERVAL '10' SECOND, ts) AS w, max(sample_seq) AS last_seq,
        arg_max(pending + ack_pending, sample_seq) AS lag,
        arg_max(partition_count, sample_seq) AS partition_count
      FROM lag_samples GROUP BY ALL)
GROUP BY stream, w""",
}


def needed(sql: str, views: dict[str, str]) -> list[str]:
    """Views a statement uses, directly or through others, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in views:
            if name in words and name not in found:
                found.add(name)
                todo.append(views[name])
    return [name for name in views if name in found]


def statement(sql: str, recursive: str = "") -> str:
    """The statement with its inputs in a WITH clause.

    ``recursive`` holds further definitions, one of which may refer to itself.
    """
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in needed(sql + recursive, VIEWS)]
    if recursive:
        parts.append(recursive.strip())
    if not parts:
        return sql.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql.strip()}"
