"""User code over messages, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlog.operators.replay import rekey
from partlog.plans import ordered

Handler = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _by_group(fn: Handler, by: str) -> Handler:
    """Calls ``fn`` once per value of ``by``, with all its batches; rows come sorted by it."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
        for batch in batches:
            codes = pd.factorize(batch[by], use_na_sentinel=False)[0]
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            for low, high in zip(starts, [*starts[1:], len(batch)]):
                value = batch[by].iloc[low]
                part = batch.iloc[low:high].reset_index(drop=True)
                yield (None if pd.isna(value) else value), part

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in groupby(parts(batches), key=lambda p: p[0]):
            yield from fn(part for _, part in rows)

    return each


def process_by_partition(
    df: DataFrame, fn: Handler, schema: T.StructType | str, n: int, order: str = "stream_seq"
) -> DataFrame:
    """Run ``fn`` over each of ``n`` partitions, one at a time, in log order.

    ``fn`` is called once per partition with an iterator of its batches and yields result
    batches.  Task p gets partition p, and nothing else; it streams through it, so its memory
    does not grow with it.
    """
    placed = rekey(df, n).repartitionById(n, "partition").sortWithinPartitions("partition", order)
    return placed.mapInPandas(_by_group(fn, "partition"), schema)


def process_by_key(
    df: DataFrame, fn: Handler, schema: T.StructType | str, order: str = "stream_seq"
) -> DataFrame:
    """Run ``fn`` over all messages of each key, in order.

    ``fn`` is called once per key with an iterator of its batches, so state such as a
    running total covers the whole key.  A task streams through a key of any size.
    """
    placed = df.repartition("key").sortWithinPartitions("key", order)
    return placed.mapInPandas(_by_group(fn, "key"), schema)


def process_by_piece(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    piece_rows: int,
    order: str = "stream_seq",
    span: int | None = None,
) -> DataFrame:
    """Run ``fn`` over pieces of ``piece_rows`` consecutive messages of each key.

    For functions that need no state across pieces: a large key is spread over many tasks.
    The column ``piece`` numbers the pieces of a key from 0.  A task gets its pieces sorted, many
    in one batch, and calls ``fn`` once for each; it holds one piece and one batch.
    """
    numbered = ordered.number_rows(df, "_pos", ("key",), (order,), span=span)
    before = F.col("_pos") - 1
    pieces = numbered.withColumns({"piece": F.floor(before / piece_rows), "_starts": before % piece_rows == 0})
    placed = pieces.repartition("key", "piece").sortWithinPartitions("key", "_pos")
    # A batch with a NULL turns whole columns into floats or objects, also for its other pieces.
    fields = [f for f in pieces.schema.fields if f.name not in ("_pos", "_starts")]
    blank = {f.name: f.dataType for f in fields if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))}
    filled = [F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name) if f.name in blank else f.name for f in fields]
    marks = [F.col(name).isNull().alias(f"_null_{name}") for name in blank]
    floats = {name: not isinstance(kind, T.BooleanType) for name, kind in blank.items()}
    return placed.select(*filled, *marks, "_starts").mapInPandas(_by_piece(fn, [f.name for f in fields], floats), schema)


def _by_piece(fn: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], floats: dict[str, bool]) -> Handler:
    """Calls ``fn`` once per piece; a row with ``_starts`` is the first of one.

    ``floats`` names columns that come without their NULLs, which are in ``_null_<name>``; in a
    piece that has some they are floats with NaN, or else objects with None.
    """

    def result(rows: pd.DataFrame, holes: list[str]) -> pd.DataFrame:
        piece = (rows[columns] if holes else rows).reset_index(drop=True)
        for name in holes:
            missing = rows[f"_null_{name}"].to_numpy()
            if missing.any():
                wide = piece[name].astype("float64" if floats[name] else "object")
                piece[name] = wide.mask(missing, np.nan if floats[name] else None)
        return fn(piece)

    def joined(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, list[str]]:
        rows = pd.concat(parts)
        return (rows, list(floats)) if floats else (rows[columns], [])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
        rest: list[pd.DataFrame] = []  # the last piece so far, which may go on
        for batch in batches:
            starts = np.flatnonzero(batch["_starts"].to_numpy())
            if not len(starts):
                rest.append(batch)
                continue
            rest.append(batch.iloc[: starts[0]])
            before = joined(rest)
            holes = [name for name in floats if batch[f"_null_{name}"].any()]
            rows = batch if holes else batch[columns]
            inner = [result(rows.iloc[low:high], holes) for low, high in zip(starts, starts[1:])]
            yield ([result(*before)] if len(before[0]) else []) + inner
            rest = [batch.iloc[starts[-1] :]]
        if rest:
            yield [result(*joined(rest))]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in pieces(batches):
            # Joined only if that changes no type.
            for _, same in groupby(found, key=lambda r: [*zip(r.columns, r.dtypes)]):
                yield pd.concat(same, ignore_index=True)

    return each
