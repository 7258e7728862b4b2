"""Ids seen so far, kept so that a batch looks only where its ids may be.

Ids are a ``StateTable``: hash buckets, in runs that are merged, so the number of files follows
the logarithm of the batches.  Beside each run lies a Bloom filter, as in ``bloom``, for each
bucket.  A batch checks the pages that its ids fall into, opens only the buckets of ids that
pass, and joins those exactly.  New ids pass about once in a thousand, so a batch of new ids
reads two bytes for each id of the past and hardly any id itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlog.plans import bloom
from partlog.plans.scratch import cut_lineage
from partlog.plans.state_table import _BUCKET, _RUN, BUCKETS, FAN_IN, StateTable, children, remove

PAGES = f"{_BUCKET} int, page bigint, pages bigint, bits binary"


class IdStore(StateTable):
    """A set of ids, each a value of one or more columns."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS, fan_in: int = FAN_IN
    ):
        super().__init__(spark, path, schema, schema.names, buckets, fan_in)

    def add(self, batch_id: int, ids: DataFrame) -> None:
        """Commit the ids of a batch."""
        self.commit(batch_id, ids.distinct())

    def known(self, batch_id: int, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` that are there after batch ``batch_id``."""
        return self.read(batch_id, cut_lineage(self.likely(batch_id, ids)))

    def likely(self, batch_id: int, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` that pass the filter of some run: all that are there, and few more."""
        runs = self.runs(batch_id)
        columns = self.schema.names
        if not runs:
            return ids.select(*columns).limit(0)
        pages = self.spark.read.schema(f"{PAGES}, {_RUN} string").option("basePath", f"{self.path}/filters")
        pages = pages.parquet(*[self._filter(r) for r in runs])
        # The number of pages of each run and bucket: a narrow read, and at most runs times buckets rows.
        sizes = pages.select(_RUN, _BUCKET, "pages").distinct()
        probes = ids.select(*columns).distinct().withColumn(_BUCKET, self._bucket())
        placed = probes.join(F.broadcast(sizes), _BUCKET).withColumn("page", bloom.page_of(F.col("pages"), columns))
        met = placed.join(pages.drop("pages"), [_RUN, _BUCKET, "page"])
        return met.where(bloom.passes("bits", columns)).select(*columns).distinct()

    def _filter(self, run: tuple[int, int]) -> str:
        return f"{self.path}/filters/{_RUN}={run[0]}-{run[1]}"

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        super()._write(rows, run)
        # Filters come from what was written.
        held = self._read([run]).select(*self.key, _BUCKET)
        counts = held.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("_n"))
        pages = bloom.pages_for(F.col("_n")).alias("pages")
        sized = held.join(F.broadcast(counts.select(_BUCKET, pages)), _BUCKET)
        page = bloom.page_of(F.col("pages"), self.key).alias("page")
        made = (
            sized.select(_BUCKET, page, "pages", bloom.probes(self.key).alias("bit"))
            .groupBy(_BUCKET, "page", "pages")
            .agg(F.bitmap_construct_agg("bit").alias("bits"))
        )
        made.coalesce(8).write.mode("overwrite").parquet(self._filter(run))

    def commit(self, batch_id: int, changes: DataFrame, gone: DataFrame | None = None, expired: Column | None = None) -> None:
        super().commit(batch_id, changes, gone, expired)
        kept = set(children(self.spark, f"{self.path}/runs"))
        for name in children(self.spark, f"{self.path}/filters"):
            if name not in kept:
                remove(self.spark, f"{self.path}/filters/{name}")
