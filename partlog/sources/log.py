"""Message logs as parquet folders partitioned by ``partition``, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlog import schema as S


def read_log(
    spark: SparkSession,
    path: str,
    partitions: Sequence[int] | None = None,
    schema: T.StructType | str = S.LOG,
) -> DataFrame:
    """Scan a log, or some partitions of it (folders of other partitions are not read)."""
    df = spark.read.schema(schema).parquet(path)
    return df if partitions is None else df.where(F.col("partition").isin(list(partitions)))


def read_log_stream(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    schema: T.StructType | str = S.LOG,
) -> DataFrame:
    """Unbounded scan from the start; ``max_files`` limits a micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def write_log(df: DataFrame, path: str, order: str = "stream_seq", mode: str = "append") -> None:
    """Append to a log.

    Tasks get contiguous ranges of (partition, order), so a partition of any size is
    written by many tasks, each file is sorted, and files of a partition do not overlap.
    """
    keys = ("partition", order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed.write.mode(mode).partitionBy("partition").parquet(path)


def write_log_stream(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to a log; returns the running query."""
    return (
        df.writeStream.format("parquet")
        .partitionBy("partition")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def read_config_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """History of mode and count writes."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(S.CONFIG_CHANGELOG).parquet(path)
