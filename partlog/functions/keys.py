"""Keys, partitions, subjects and message identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog import schema as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _int(c: Column | str | int) -> Column:
    return F.lit(c) if isinstance(c, int) else _col(c)


def _trailing_number(key: Column) -> Column:
    # \z and not $, which would also match before a final newline.
    digits = F.regexp_extract(key, r"([0-9]+)\z", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def extract_trailing_number(key: Column | str) -> Column:
    """Trailing ASCII digits as BIGINT; -1 without digits or beyond 64 bits."""
    return F.coalesce(_trailing_number(_col(key)), F.lit(-1).cast("bigint"))


def key_hash31(key: Column | str) -> Column:
    """Polynomial hash of the key's UTF-8 bytes, modulo 2^32."""
    # Read as Latin-1, each byte is one character whose code is the byte's value.
    key = _col(key)
    chars = F.split(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1"), "")
    step = lambda h, c: F.pmod(h * S.HASH_MULTIPLIER + F.ascii(c), F.lit(S.HASH_MODULUS))
    zero = F.lit(0).cast("bigint")
    return F.when(F.length(key) == 0, zero).otherwise(F.aggregate(chars, zero, step))


def partition_for_key(key: Column | str, count: Column | str | int) -> Column:
    """Partition of a key: trailing number modulo count, else hash modulo count."""
    key, count = _col(key), _int(count)
    n = count.cast("bigint")
    routed = F.coalesce(F.pmod(_trailing_number(key), n), F.pmod(key_hash31(key), n))
    return F.when(count <= 1, F.lit(0)).otherwise(routed).cast("int")


def subject_for_partition(prefix: Column | str, partition: Column | str | int) -> Column:
    """``prefix.NN``; a plain string is the prefix itself, not a column name."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.format_string(S.SUBJECT_FORMAT, prefix, _int(partition))


def consumer_name(partition: Column | str | int) -> Column:
    return F.concat(F.lit(S.CONSUMER_PREFIX), _int(partition).cast("string"))


def publish_id(key: Column | str, sequence: Column | str, nonce: Column | str) -> Column:
    """Identity of one publish call; ``nonce`` is a stored column such as the log position."""
    return F.concat_ws("-", _col(key), _col(sequence).cast("string"), _col(nonce).cast("string"))


def replay_id(key: Column | str, sequence: Column | str) -> Column:
    """Identity of a replayed message; equal for every attempt to replay it."""
    return F.concat_ws("-", F.lit(S.REPLAY_ID_PREFIX), _col(key), _col(sequence).cast("string"))


def message_id(
    kind: str, key: Column | str, sequence: Column | str, nonce: Column | str | None = None
) -> Column:
    if kind == "publish":
        if nonce is None:
            raise ValueError("a publish id needs a nonce column")
        return publish_id(key, sequence, nonce)
    if kind == "replay":
        return replay_id(key, sequence)
    raise ValueError(f"unknown kind of message id: {kind}")


def stream_names(stream: Column | str) -> Column:
    """All names derived from a stream name, as one struct."""
    name = F.upper(_col(stream))
    return F.struct(
        name.alias("stream_name"),
        name.alias("subject_prefix"),
        F.concat(name, F.lit(S.BUFFER_SUFFIX)).alias("buffer_stream"),
        F.concat(name, F.lit(S.BUFFER_SUFFIX)).alias("buffer_subject"),
        F.concat(name, F.lit(S.DEAD_LETTER_SUFFIX)).alias("dlq_stream"),
        F.concat(name, F.lit(S.DEAD_LETTER_SUFFIX)).alias("dlq_subject"),
        F.concat(name, F.lit(S.CONFIG_SUFFIX)).alias("kv_bucket"),
    )


def moved_keys(df: DataFrame, old: int, new: int, key: str = "key") -> DataFrame:
    """Distinct keys whose partition differs under the two counts."""
    return (
        df.select(key)
        .distinct()
        .select(
            key,
            partition_for_key(key, old).alias("old_partition"),
            partition_for_key(key, new).alias("new_partition"),
        )
        .where(F.col("old_partition") != F.col("new_partition"))
    )
