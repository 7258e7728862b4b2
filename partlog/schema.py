"""Row shapes and fixed values of the message-log model."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("sequence", T.LongType(), False),
        T.StructField("payload", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("ts", T.LongType(), False),
    ]
)

# A stored log row: the message plus its position in the stream.
LOG = T.StructType([T.StructField("stream_seq", T.LongType(), False), *MESSAGE.fields])

DEAD_LETTER = T.StructType(
    [
        T.StructField("data", T.BinaryType(), False),
        T.StructField("original_subject", T.StringType(), False),
        T.StructField("reason", T.StringType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("error", T.StringType(), True),
    ]
)

# History of a stream's settings, one row per write.
CONFIG_CHANGELOG = T.StructType(
    [
        T.StructField("revision", T.LongType(), False),
        T.StructField("effective_ts", T.TimestampType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType(), True),
    ]
)

SEQUENCE_STATE = T.StructType(
    [
        T.StructField("sequence", T.LongType()),
        T.StructField("partition", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("gaps", T.LongType()),
        T.StructField("gap_total", T.LongType()),
        T.StructField("violations", T.LongType()),
    ]
)

# They have to equal those of the message-log system.
MIN_PARTITIONS = 1
MAX_PARTITIONS = 20
HASH_MULTIPLIER = 31
HASH_MODULUS = 4294967296
SUBJECT_FORMAT = "%s.%02d"
CONSUMER_PREFIX = "consumer-p"
REPLAY_ID_PREFIX = "replay"
BUFFER_SUFFIX = "_BUFFER"
DEAD_LETTER_SUFFIX = "_DLQ"
CONFIG_SUFFIX = "_config"
KEY_PARTITION_COUNT = "partition_count"
KEY_MODE = "mode"
MODE_DIRECT = "direct"
MODE_BUFFER = "buffer"
REASON_UNMARSHAL = "unmarshal_failure"
REASON_MAX_DELIVERY = "max_delivery_exhausted"
REASON_REPLAY_FAILED = "replay_publish_failed"
DEDUP_WINDOW = "2 minutes"
STATE_TTL = "5 minutes"
ACK_WAIT = "30 seconds"
MAX_DELIVER = 5
LOG_MAX_AGE = "24 hours"
LOG_MAX_MESSAGES = 1_000_000
DEAD_LETTER_MAX_AGE = "7 days"
DEAD_LETTER_MAX_MESSAGES = 10_000_000
MISMATCH_SLACK = 5
LAG_WARN = 10
LAG_BAD = 50
LAG_HIGH_WATER = 5000
LAG_LOW_WATER = 500
DEFAULT_MIN_PARTITIONS = 1
DEFAULT_MAX_PARTITIONS = 10
COOLDOWN = "30 seconds"
LAG_INTERVAL = "10 seconds"
