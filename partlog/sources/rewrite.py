"""Removing rows from a stored log: only the files that hold some are written anew.

New files go to a hidden folder beside the data first, with the list of the files that they
replace and, last, a mark that both are whole.  Then new files are moved in and old ones are
removed.  A run that dies before the mark has changed nothing; one that dies after it is
finished by the next one, or by ``finish_rewrites``.  Until then a reader may see rows of a
replaced file twice, but never too few.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlog import schema as S
from partlog.plans.bounds import at_most, join_small
from partlog.plans.scratch import cut_lineage
from partlog.plans.state_table import children, remove

_FILE = "_file"
_STAGE, _OLD, _NEW, _WHOLE = "_rewrite-", "old", "new", "_WHOLE"


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> list[str]:
    found = _file_system(spark, path).listStatus(_path(spark, path))
    names = [s.getPath().getName() for s in found if s.isFile()]
    return [n for n in names if not n.startswith(("_", "."))]


def finish_rewrites(spark: SparkSession, path: str) -> None:
    """Complete what an earlier run had decided, and remove what it had not."""
    system = _file_system(spark, path)
    for stage in [f"{path}/{n}" for n in children(spark, path) if n.startswith(_STAGE)]:
        if system.exists(_path(spark, f"{stage}/{_WHOLE}")):
            for part in [n for n in children(spark, f"{stage}/{_NEW}") if "=" in n]:
                system.mkdirs(_path(spark, f"{path}/{part}"))
                for name in _files(spark, f"{stage}/{_NEW}/{part}"):
                    if not system.rename(_path(spark, f"{stage}/{_NEW}/{part}/{name}"), _path(spark, f"{path}/{part}/{name}")):
                        raise OSError(f"cannot move {name} into {path}/{part}")
            # As many rows as files are replaced.
            for row in spark.read.parquet(f"{stage}/{_OLD}").toLocalIterator():
                old = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row[_FILE]))
                system.delete(old, False)
        remove(spark, stage)


def rewrite_log(
    spark: SparkSession,
    path: str,
    keep: Callable[[DataFrame], DataFrame],
    schema=S.LOG,
    order: str = "stream_seq",
) -> int:
    """Keep only the rows that ``keep`` returns; gives the number of files that were replaced.

    ``keep`` takes the log and returns some of its rows with all their columns, the same ones
    each time.  Files of which it keeps all rows are not touched, so a second run writes nothing.
    """
    finish_rewrites(spark, path)
    log = spark.read.schema(schema).parquet(path).withColumn(_FILE, F.col("_metadata.file_path"))
    kept = keep(log)
    total = log.groupBy(_FILE).agg(F.count(F.lit(1)).alias("_n"))
    left = kept.groupBy(_FILE).agg(F.count(F.lit(1)).alias("_k"))
    changed = total.join(left, _FILE, "left").where(F.coalesce("_k", F.lit(0)) < F.col("_n"))
    old = cut_lineage(changed.select(_FILE))
    if at_most(old, 0):
        return 0
    stage = f"{path}/{_STAGE}{uuid.uuid4().hex}"
    rows = join_small(kept, old, [_FILE], "left_semi").drop(_FILE)
    # As in ``write_log``: sorted files that do not overlap.
    placed = rows.repartitionByRange("partition", order).sortWithinPartitions("partition", order)
    placed.write.partitionBy("partition").parquet(f"{stage}/{_NEW}")
    old.write.parquet(f"{stage}/{_OLD}")
    _file_system(spark, path).create(_path(spark, f"{stage}/{_WHOLE}")).close()
    finish_rewrites(spark, path)
    return old.count()
