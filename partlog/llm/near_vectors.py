"""Near-duplicate vectors by int8 tile products with exact error bounds.

Vectors of the same components (bit for bit) form a class that is compared once.  Class
vectors are scaled to length one and quantised to int8 with one scale per vector, and the
length of what quantisation loses is kept with them.  Classes are dealt to blocks by hash; a
task multiplies two blocks, a tile.  For a pair with quantised vectors x, y and losses e, f the
cosine lies within |x| f + |y| e + e f of the product of the quantised ones (Cauchy-Schwarz;
a margin for rounding is added).  Pairs that surely miss or surely reach the threshold are
settled by that; others are computed again in double precision from the given components.

A tile gives, per class, the number of linked vectors, and a spanning forest of its links:
at most as many rows as the tile has vectors, however many pairs link.  Components follow
from the forests.  Every pair of blocks is one tile, so the work grows with the square of
the number of distinct vectors.  Vectors travel in pieces of at most ``PIECE_BYTES``, as floats
where that loses nothing.  A block holds at most ``BLOCK_BYTES``, so a task's memory does not
grow with the input.  Tiles come in rounds in which a vector goes to about ``SENT`` of them, and
a round's shuffle files go before the next one, so they grow as the input does.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of different lengths link with nothing; copies of one vector
link with each other; a repeated or null id is a row of its own, and rows with one id share
a name in ``component_id``; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlog.llm.common import batch_bytes, written
from partlog.llm.components import components
from partlog.plans.bounds import join_small
from partlog.plans.scratch import scratch_path

THRESHOLD = 0.9
#: Vectors of a block; up to GROWN times as many rather than more than BLOCKS blocks.
BLOCK = 4096
GROWN = 8
BLOCKS = 20
SENT = 8
BLOCK_BYTES = 16 << 20
PIECE_BYTES = 1 << 18
#: Rows and columns of a tile that are multiplied at once, and pairs that are judged at once.
STRIP = 1024
PAIRS = 1 << 16
#: Covers the rounding of double and of float products of int8 values (exact below 2**24).
ROUNDING = 1e-9

REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FOUND = "class bigint, linked bigint, other bigint"
PIECES = (
    "width int, blocks int, at int, classes array<bigint>, members array<bigint>, vectors binary"
)


class _Quantised:
    """Class vectors of a block: doubles of length one, int8 codes, scales and losses."""

    def __init__(self, raw: list[bytes] | np.ndarray):
        """``raw``: one string of doubles per vector, or an array with a row for each."""
        if not isinstance(raw, np.ndarray):
            raw = np.stack([np.frombuffer(r, dtype="<f8") for r in raw])
        # Products of int8 values are sums of integers, exact in float32 below 2**24.
        exact = np.float32 if raw.shape[1] * 127 * 127 < 1 << 24 else np.float64
        self.unit = np.empty(raw.shape)
        self.codes = np.empty(raw.shape, exact)
        self.scale, self.loss, self.size = (np.empty(len(raw)) for _ in range(3))
        for low in range(0, len(raw), STRIP):
            of = slice(low, low + STRIP)
            v = raw[of].astype(np.float64)
            v = v / np.abs(v).max(1, keepdims=True)  # against overflow of the squares
            unit = v / np.sqrt((v * v).sum(1, keepdims=True))
            scale = np.abs(unit).max(1) / 127
            codes = np.rint(unit / scale[:, None])
            back = codes * scale[:, None]
            self.unit[of], self.codes[of], self.scale[of] = unit, codes, scale
            self.loss[of] = np.sqrt(((unit - back) ** 2).sum(1)) * (1 + ROUNDING) + ROUNDING
            self.size[of] = np.sqrt((back**2).sum(1)) * (1 + ROUNDING)


def _pairs(a: _Quantised, b: _Quantised, threshold: float, same: bool) -> Iterator[tuple]:
    """(rows of a, rows of b) that link, strip by strip.

    Strips follow the scales, so that one bound for each row holds closely for all columns.
    """
    by_a, by_b = np.argsort(a.scale), np.argsort(b.scale)
    for left in range(0, len(by_b), STRIP):
        y = by_b[left : left + STRIP]
        columns = b.codes[y].T
        size, loss = b.size[y].max(), b.loss[y].max()
        for low in range(0, left + len(y) if same else len(by_a), STRIP):
            x = by_a[low : low + STRIP]
            least = threshold - (a.size[x] * loss + a.loss[x] * (size + loss) + ROUNDING)
            least /= a.scale[x] * np.where(least > 0, b.scale[y[-1]], b.scale[y[0]])
            about = a.codes[x] @ columns
            # Products are whole numbers, so is what they are held against.
            least = np.floor(least - 0.001).astype(about.dtype)
            hits = np.flatnonzero(about >= least[:, None])
            for k in range(0, len(hits), PAIRS):
                p, q = np.divmod(hits[k : k + PAIRS], len(y))
                if same:
                    once = low + p < left + q
                    p, q = p[once], q[once]
                i, j = x[p], y[q]
                cosine = about[p, q].astype(np.float64) * (a.scale[i] * b.scale[j])
                error = a.size[i] * b.loss[j] + a.loss[i] * (b.size[j] + b.loss[j]) + ROUNDING
                linked = cosine - error >= threshold
                doubtful = np.flatnonzero(~linked & (cosine + error >= threshold))
                for m in range(0, len(doubtful), STRIP):
                    d = doubtful[m : m + STRIP]
                    linked[d] = np.einsum("ij,ij->i", a.unit[i[d]], b.unit[j[d]]) >= threshold
                if linked.any():
                    yield i[linked], j[linked]


def _tile(a: tuple, b: tuple, threshold: float, same: bool) -> pd.DataFrame:
    """Rows of ``FOUND``: counts per class, then links of a spanning forest."""
    ids_a, counts_a, vectors_a = a
    ids_b, counts_b, vectors_b = b
    linked_a, linked_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    n = len(ids_a) + (0 if same else len(ids_b))
    label = np.arange(n)
    above = np.arange(n)  # of labels: one that it has joined
    shift = 0 if same else len(ids_a)
    ends_a, ends_b = [], []

    def top(p: int) -> int:
        while above[p] != p:
            above[p] = above[above[p]]
            p = above[p]
        return p

    for x, y in _pairs(vectors_a, vectors_b, threshold, same):
        np.add.at(linked_a, x, counts_b[y])
        np.add.at(linked_a if same else linked_b, y, counts_a[x])
        p, q = label[x], label[y + shift]
        pairs = np.where(p == q, -1, np.minimum(p, q) * n + np.maximum(p, q))
        pairs, first = np.unique(pairs, return_index=True)
        for k in first[pairs >= 0].tolist():
            r, s = top(p[k]), top(q[k])
            if r != s:
                above[s] = r
                ends_a.append(ids_a[x[k]])
                ends_b.append(ids_b[y[k]])
        while (label != (further := above[label])).any():
            label = further
    ids = [ids_a[linked_a > 0], ids_b[linked_b > 0]]
    return pd.DataFrame(
        {
            "class": np.concatenate([*ids, np.array(ends_a, np.int64)]),
            "linked": np.concatenate(
                [linked_a[linked_a > 0], linked_b[linked_b > 0], np.zeros(len(ends_a), np.int64)]
            ),
            "other": np.concatenate([*ids, np.array(ends_b, np.int64)]),
        }
    )


def _pieces(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``PIECES``: the vectors of a batch that go to one block, a few at a time."""
    for batch in batches:
        out = []
        for (width, blocks, at), part in batch.groupby(["width", "blocks", "at"]):
            v = np.stack(part["v"].to_list()).astype("<f8")
            with np.errstate(over="ignore", under="ignore"):
                short = v.astype("<f4")
            v = short if (short == v).all() else v
            classes, members = part["class"].to_numpy(), part["members"].to_numpy()
            step = max(1, PIECE_BYTES // (v.itemsize * int(width)))
            for k in range(0, len(v), step):
                of = slice(k, k + step)
                out.append((width, blocks, at, classes[of], members[of], v[of].tobytes()))
        yield pd.DataFrame(
            out, columns=["width", "blocks", "at", "classes", "members", "vectors"]
        )


def _block(pieces: pd.DataFrame, width: int) -> tuple:
    """Classes, their numbers of vectors, and the vectors of one block of a tile."""
    classes = np.concatenate(pieces["classes"].to_list())
    parts = [
        np.frombuffer(raw, dtype=f"<f{len(raw) // (len(ids) * width)}").reshape(-1, width)
        for ids, raw in zip(pieces["classes"], pieces["vectors"])
    ]
    return classes, np.concatenate(pieces["members"].to_list()), _Quantised(np.concatenate(parts))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has been written."""
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def link_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """Each row's ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    values = F.col("embedding").cast("array<double>")
    fine = (
        F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall(
            values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        )
        & F.exists(values, lambda x: x != 0)
    )
    # -0.0 and 0.0 are one value; the class is named by its bytes.
    same = F.transform(values, lambda x: x + F.lit(0.0))
    rows = vectors.select(
        F.col("vec_id"), F.when(fine, same).alias("v"), F.monotonically_increasing_id().alias("row")
    )
    rows = written(rows, "vectors")
    classes = (
        rows.where("v is not null")
        .groupBy("v")
        .agg(F.min("row").alias("class"), F.count("*").alias("members"))
        .withColumn("width", F.size("v"))
    )
    classes = written(classes, "vector-classes")
    found = _links(classes, threshold, block)
    per_class = found.groupBy("class").agg(F.sum("linked").alias("linked"))
    of_row = rows.select("row", "vec_id", "v").join(
        classes.select("v", "class", "members"), "v", "left"
    )
    of_row = written(of_row.select("row", "vec_id", "class", "members"), "vector-rows")
    # A class is named by its smallest id; a component by the smallest of its classes.
    names = of_row.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("name"))
    reached = components(found.where("linked = 0 and class <> other"), "class", "other")
    smallest = (
        names.join(reached.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    best = smallest.groupBy("component").agg(F.min("name").alias("component_id"))
    named = smallest.select("class", "component").join(best, "component").select("class", "component_id")
    return (
        of_row.join(named, "class", "left")
        .join(per_class, "class", "left")
        .select(
            "vec_id",
            (F.coalesce(F.col("members") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _links(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """``FOUND`` of all tiles, of classes of every width."""
    spark = classes.sparkSession
    batch_bytes(spark, 10_000)
    largest = F.greatest(
        F.lit(1), F.least(F.lit(GROWN * block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("width"))))
    )
    fewest, most = (F.ceil(F.col("n") / x) for x in (largest, F.least(F.lit(block), largest)))
    widths = classes.groupBy("width").agg(F.count("*").alias("n")).select(
        "width", F.greatest(fewest, F.least(most, F.lit(BLOCKS))).cast("int").alias("blocks")
    )
    b = F.col("blocks").cast("double")
    whole = widths.agg(F.max("blocks").alias("blocks"), F.sum(b * (b + 1) / 2).alias("tiles")).first()
    path = scratch_path(spark, "vector-links")
    if whole["blocks"] is None:
        spark.createDataFrame([], FOUND).write.parquet(path)
    rounds = -(-(whole["blocks"] or 0) // SENT)
    dealt = join_small(classes, widths, ["width"], "inner")
    with _shuffles_removed(spark):
        for k in range(rounds):
            part = _tiles(dealt, threshold, whole["tiles"] / rounds, rounds, k)
            part.write.mode("append").parquet(path)
    return spark.read.schema(FOUND).parquet(path)


def _sent(classes: DataFrame, rounds: int, k: int) -> DataFrame:
    """Pieces of blocks with the tiles (i, j) of round ``k`` that they are part of."""
    at = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    pieces = classes.select("width", "blocks", at.alias("at"), "class", "members", "v").mapInPandas(
        _pieces, PIECES
    )
    # Blocks as far apart in a circle meet in the same round, each tile's two at the same time.
    b = F.col("blocks")
    steps = F.filter(
        F.sequence(F.lit(0), b - 1), lambda s: F.pmod(F.least(s, b - s), F.lit(rounds)) == k
    )
    other = F.pmod(F.col("at") + F.col("step"), b)
    return pieces.select("*", F.explode(steps).alias("step")).withColumn("other", other).select(
        "width", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"),
        "at", "classes", "members", "vectors",
    )


def _tiles(classes: DataFrame, threshold: float, tiles: float, rounds: int, k: int) -> DataFrame:
    """The tiles of round ``k``, about ``tiles`` in number."""

    def tile(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        width, i, j = (int(x) for x in key)
        first, second = batch[batch["at"] == i], batch[batch["at"] == j]
        if first.empty or second.empty:
            return pd.DataFrame({"class": [], "linked": [], "other": []}, dtype="int64")
        a = _block(first, width)
        return _tile(a, a if i == j else _block(second, width), threshold, i == j)

    # Partitions enough for most tiles to have one to themselves.
    parts = max(1, min(int(4 * tiles), 20_000))
    keys = ["width", "i", "j"]
    return _sent(classes, rounds, k).repartition(parts, *keys).groupBy(*keys).applyInPandas(tile, FOUND)
