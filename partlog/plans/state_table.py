"""A keyed table that grows by what changes: deltas, merged from time to time.

A commit writes the changed rows of one batch as a run, ``state_run=<first>-<last>/state_bucket=<n>``, with
a hash of the key as the bucket, so what is written follows the batch and not the state.  When
``FAN_IN`` runs of one size stand next to each other they are merged into one of the next
size, the newest row of each key, so a row is written about log(batches) times and a read
opens few runs.  A read of given keys opens their buckets only.

A commit ends by writing the list of its runs, and that list is what counts.  A batch that is
repeated after a failure, wherever it was, starts from the list of the batch before it, writes
the same folders anew and replaces its own list.  Runs are removed one commit after the last
list that names them, so whoever reads the last list has one batch's time to do so.

Batches are numbered 0, 1, 2, ... without holes, as micro-batches are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


FAN_IN = 8
BUCKETS = 64
NAMED_KEYS = 100_000  # keys of a read that are broadcast; more take a shuffle join

_BATCH, _BUCKET, _RUN, _GONE, _KEY = "_batch", "state_bucket", "state_run", "_gone", "_key"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, but for hidden ones; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listStatus(at) if system.exists(at) else []
    return [n for n in (s.getPath().getName() for s in found) if not n.startswith(".")]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; it is there as a whole or not at all."""
    made, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(at, False)  # of an earlier attempt, which whoever repeats it does not read
    if not system.rename(made, at):
        raise OSError(f"cannot write {path}")


def get_text(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class StateTable:
    """Rows of ``schema``, one for each value of the columns ``key``.

    The bucket follows the columns ``by``, a part of the key that reads may name alone.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: Sequence[str],
        buckets: int = BUCKETS,
        fan_in: int = FAN_IN,
        by: Sequence[str] | None = None,
    ):
        self.spark, self.path, self.key, self.by = spark, path, list(key), list(by or key)
        self.schema, self.buckets, self.fan_in = schema, buckets, fan_in
        added = [(_GONE, T.BooleanType()), (_BATCH, T.LongType()), (_RUN, T.StringType()), (_BUCKET, T.IntegerType())]
        self.stored = T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in added]])

    @classmethod
    def opened(cls, spark: SparkSession, path: str, key: Sequence[str], **options) -> StateTable:
        """A table that is there, with the columns that it was written with."""
        table = cls(spark, path, T.StructType([]), key, **options)
        runs = table.runs(table.latest())
        if not runs:
            raise ValueError(f"nothing was committed to {path}")
        added = set(table.stored.names)
        fields = spark.read.parquet(table._folder(runs[-1])).schema.fields
        return cls(spark, path, T.StructType([f for f in fields if f.name not in added]), key, **options)

    # ---- what there is ----

    def _manifest(self, batch_id: int) -> str:
        return f"{self.path}/manifest/{batch_id}"

    def runs(self, batch_id: int) -> list[tuple[int, int]]:
        """(first, last) batch of each run after batch ``batch_id``, oldest first."""
        if batch_id < 0:
            return []
        return [(int(a), int(b)) for a, _, b in (r.partition("-") for r in get_text(self.spark, self._manifest(batch_id)).split())]

    def latest(self) -> int:
        """The last batch that was committed, or -1."""
        return max(map(int, children(self.spark, f"{self.path}/manifest")), default=-1)

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/runs/{_RUN}={run[0]}-{run[1]}"

    def _read(self, runs: Sequence[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.stored)
        found = self.spark.read.schema(self.stored).option("basePath", f"{self.path}/runs")
        return found.parquet(*[self._folder(r) for r in runs])

    def _newest(self, rows: DataFrame, runs: int) -> DataFrame:
        if runs < 2:  # a run has each key once
            return rows
        row = F.struct(*self.schema.names, _GONE, _BATCH, _BUCKET)
        latest = rows.groupBy(F.struct(*self.key).alias(_KEY)).agg(F.max_by(row, _BATCH).alias("r"))
        return latest.select("r.*")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self, batch_id: int, keys: DataFrame | None = None) -> DataFrame:
        """The table after batch ``batch_id``; with ``keys``, the rows of those only.

        ``keys`` has the columns of the key, or those of ``by``.
        """
        runs = self.runs(batch_id)
        rows = self._read(runs)
        if keys is not None and runs:
            named = self.key if set(self.key) <= set(keys.columns) else self.by
            wanted = keys.select(F.struct(*named).alias(_KEY), self._bucket().alias("_b")).distinct()
            # At most as many numbers as there are buckets; the scan opens no other folder.
            here = wanted.groupBy("_b").count().collect()
            rows = rows.where(F.col(_BUCKET).isin([r["_b"] for r in here])).withColumn(_KEY, F.struct(*named))
            small = sum(r["count"] for r in here) <= NAMED_KEYS
            wanted = wanted.select(_KEY)
            rows = rows.join(F.broadcast(wanted) if small else wanted, _KEY, "left_semi").drop(_KEY)
        return self._newest(rows, len(runs)).where(~F.col(_GONE)).select(*self.schema.names)

    def read_where(self, batch_id: int, old: Column) -> DataFrame:
        """Rows after ``batch_id`` for which ``old`` holds, a filter on stored columns.

        Only files that may hold such rows are read, and then the newest rows of their keys.
        """
        candidates = self._read(self.runs(batch_id)).where(old & ~F.col(_GONE)).select(*self.key).distinct()
        return self.read(batch_id, candidates).where(old)

    # ---- what changes ----

    def commit(
        self, batch_id: int, changes: DataFrame, gone: DataFrame | None = None, expired: Column | None = None
    ) -> None:
        """Make ``changes`` the newest rows of their keys and remove the keys ``gone``.

        Rows for which ``expired`` holds are dropped when runs are merged.  If it holds for
        the newest row of a key it must hold for the older ones.
        """
        number = F.lit(batch_id).cast("bigint").alias(_BATCH)
        new = changes.select(*self.schema.names, F.lit(False).alias(_GONE), number)
        if gone is not None:
            blank = {f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name not in self.key}
            marks = gone.select(*self.key, *[c.alias(n) for n, c in blank.items()])
            new = new.unionByName(marks.select(*self.schema.names, F.lit(True).alias(_GONE), number))
        before = self.runs(batch_id - 1)
        runs = [*before, (batch_id, batch_id)]
        self._write(new.withColumn(_BUCKET, self._bucket()), runs[-1])
        while merged := self._due(runs):
            rows = self._newest(self._read(merged), len(merged))
            if merged[0] == runs[0]:  # nothing older that a removed key could come back from
                rows = rows.where(~F.col(_GONE))
            if expired is not None:
                rows = rows.where(F.col(_GONE) | ~expired)
            runs = [*runs[: -len(merged)], (merged[0][0], merged[-1][1])]
            self._write(rows.select(*self.schema.names, _GONE, _BATCH, _BUCKET), runs[-1])
        put_text(self.spark, self._manifest(batch_id), "\n".join(f"{a}-{b}" for a, b in runs))
        # A repeated batch needs the runs before it; all others, also of failed attempts, may go.
        kept = {self._folder(r).rsplit("/", 1)[1] for r in (*runs, *before)}
        for name in children(self.spark, f"{self.path}/runs"):
            if name not in kept:
                remove(self.spark, f"{self.path}/runs/{name}")
        for name in children(self.spark, f"{self.path}/manifest"):
            if int(name) < batch_id - 1:
                remove(self.spark, f"{self.path}/manifest/{name}")

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # One file for each bucket; the given number keeps large runs spread.
        dealt = rows.repartition(min(tasks, self.buckets), _BUCKET)
        dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(self._folder(run))

    def _due(self, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The last runs, if they are ``fan_in`` of one size."""
        last = runs[-self.fan_in :]
        sizes = {high - low for low, high in last}
        return last if len(last) == self.fan_in and len(sizes) == 1 else []
