"""The cooldown on a stream, with its state in the state store.

It sees one stream's windows of one micro-batch, a row for each window, so the micro-batch
limit of the source (``max_files`` in ``read_log_stream``) bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partlog import schema as S
from partlog.plans.intervals import micros


def scale_recommendations_stream(
    lag: DataFrame,
    high: int = S.LAG_HIGH_WATER,
    low: int = S.LAG_LOW_WATER,
    min_partitions: int = S.DEFAULT_MIN_PARTITIONS,
    max_partitions: int = S.DEFAULT_MAX_PARTITIONS,
    cooldown: str = S.COOLDOWN,
) -> DataFrame:
    """``scale_recommendations`` on a stream of lag windows.

    State per stream is the time of the last recommendation.
    """
    count, pending = F.col("partition_count"), F.col("lag")
    step = F.when((pending > high) & (count < max_partitions), F.lit(1)).when(
        (pending < low) & (count > min_partitions), F.lit(-1)
    )
    asked = (
        lag.withColumn("step", step)
        .where(F.col("step").isNotNull())
        .withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    )
    wanted = [f for f in asked.schema.fields if f.name != "_us"]
    out = T.StructType([*wanted, T.StructField("desired", T.LongType())])
    spacing = micros(cooldown)

    def keep(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["_us", "sample_seq"], ignore_index=True)
        times = rows["_us"].to_numpy()
        kept = []
        at = int(np.searchsorted(times, state.get[0] + spacing)) if state.exists else 0
        while at < len(times):
            kept.append(at)
            at = int(np.searchsorted(times, times[at] + spacing))
        if kept:
            state.update((int(times[kept[-1]]),))
        chosen = rows.iloc[kept].drop(columns="_us")
        yield chosen.assign(desired=chosen["partition_count"] + chosen["step"])

    return asked.groupBy("stream").applyInPandasWithState(
        keep, out, "last_us bigint", "append", GroupStateTimeout.NoTimeout
    )
