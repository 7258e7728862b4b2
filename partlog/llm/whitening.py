"""Whitening of embeddings by their principal directions.

The fit list holds each distinct vector once.  Its means come from exact integer sums, and
the centred rows are reduced block by block to triangles of QR factorisations, which are
merged in rounds (the covariance itself is never formed, so that small directions keep their
digits).  The last triangle R, as wide as a vector, is solved in numpy: Householder steps
make it bidiagonal, dqds gives its singular values to high relative accuracy, and a twisted
factorisation gives the direction of each one that is asked for.

Entries are whole numbers here: ``scaled`` turns floats into steps of 1/256.

A component is a direction of positive variance, numbered from 1 by falling variance.  A
variance below the rounding of the largest one counts as zero: such a direction cannot be
whitened and is left out, so a table may have fewer components than asked for, or none.

Defined results: vectors that are null or hold null, non-finite or (once scaled) larger
entries than a long holds are left out; so are empty ones, which have no directions, and
those of another length than most have (of equally common lengths the smaller one counts);
repeated rows and ids each give their rows; copies count once in the fit; a deviation beyond
a long is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import written

STEPS = 256
COMPONENTS = 4
FAN_IN = 16  # triangles that are merged at a time
QR_ROWS = 4096
MOST_LONG = 2**62

EPS = np.finfo(np.float64).eps
CLUSTERED = 1e-3  # relative gap below which directions are made orthogonal explicitly

TRIANGLE = "block int, r binary"
RESULT = "vec_id {}, component int, n bigint, deviation bigint, whitened double"


# ---- the solver of one triangle ----


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and right reflectors of a square matrix."""
    a = np.array(r, dtype=np.float64)
    n = len(a)
    right: list[np.ndarray] = []
    for k in range(n):
        v = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """v of length one (or zero) so that x - 2 v (v x) has only its first entry left."""
    size = np.linalg.norm(x)
    if size == 0 or np.all(x[1:] == 0):
        return np.zeros_like(x)
    v = x / size
    v[0] += np.copysign(1.0, v[0])
    return v / np.linalg.norm(v)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of a bidiagonal matrix, falling, by differential qd with shifts."""
    top = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if top == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    parts = [((diagonal / top) ** 2, (above / top) ** 2, 0.0)]
    while parts:
        q, e, shifted = parts.pop()
        while len(q):
            # What is this small against both neighbours changes no singular value.
            small = np.flatnonzero(e <= EPS**2 * np.minimum(q[:-1], q[1:])) if len(e) else e
            if len(small):
                cut = int(small[0]) + 1
                parts.append((q[cut:], e[cut:], shifted))
                q, e = q[:cut], e[: cut - 1]
                continue
            if len(q) == 1:
                found.append(shifted + q[0])
                break
            if q[0] < q[-1]:  # small values are found fastest at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            if e[-1] <= EPS**2 * (shifted + q[-1]):
                found.append(shifted + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            q, e, shift = _step(q, e)
            shifted += shift
    return np.sqrt(np.sort(np.maximum(found, 0))[::-1]) * top


def _step(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One transform by the largest shift tried that keeps all values positive."""
    # The smaller value of the last two by two block is above the smallest of all.
    total, product = q[-1] + q[-2] + e[-1], q[-1] * q[-2]
    guess = 2 * product / (total + np.sqrt(max(total * total - 4 * product, 0))) if total > 0 else 0.0
    for share in (0.999, 0.75, 0.25, 0.0):
        new = _transform(q, e, share * guess)
        if new is not None:
            return *new, share * guess
    return q, np.zeros_like(e), 0.0  # not reached: the step without a shift never fails


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    new_q, new_e = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


class _Twisted:
    """Twisted factorisation N D N' of B'B - value, from a bidiagonal B."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        n = len(diagonal)
        tiny = EPS**2 * max((diagonal**2).max(), value)
        fixed = lambda x: x if abs(x) > tiny else (tiny if x >= 0 else -tiny)
        q, off = diagonal**2, diagonal[:-1] * above
        low, high = np.empty(n), np.empty(n)  # pivots from the top and from the bottom
        self.up, self.down = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
        s = -value  # stationary qd from the top
        tops = np.empty(n)
        for i in range(n):
            tops[i] = s
            low[i] = fixed(q[i] + s)
            if i < n - 1:
                self.up[i] = off[i] / low[i]
                s = above[i] ** 2 * (s / low[i]) - value
        p = q[-1] - value  # progressive qd from the bottom
        bottoms = np.empty(n)
        for i in range(n - 1, -1, -1):
            bottoms[i] = p
            if i:
                high[i] = fixed(above[i - 1] ** 2 + p)
                self.down[i - 1] = off[i - 1] / high[i]
                p = q[i - 1] * (p / high[i]) - value
        gamma = tops + bottoms + value
        self.twist = int(np.argmin(np.abs(gamma)))
        self.low, self.high, self.gamma = low, high, fixed(gamma[self.twist])

    def solve(self, x: np.ndarray) -> np.ndarray:
        """(B'B - value)^-1 x."""
        k, n, y = self.twist, len(x), np.array(x, dtype=np.float64)
        for i in range(k):
            y[i + 1] -= self.up[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= self.down[i - 1] * y[i]
        y[:k] /= self.low[:k]
        y[k + 1 :] /= self.high[k + 1 :]
        y[k] /= self.gamma
        return self._spread(y)

    def _spread(self, y: np.ndarray) -> np.ndarray:
        for i in range(self.twist - 1, -1, -1):
            y[i] -= self.up[i] * y[i + 1]
        for i in range(self.twist + 1, len(y)):
            y[i] -= self.down[i - 1] * y[i - 1]
        y = y / np.abs(y).max()  # against overflow of the squares
        return y / np.linalg.norm(y)

    def vector(self) -> np.ndarray:
        """The direction whose entry at the twist is the largest residual's."""
        y = np.zeros(len(self.low))
        y[self.twist] = 1.0
        return self._spread(y)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of ``r``, falling, and the first ``most`` right directions (rows).

    Values that are zero within rounding have no direction.
    """
    diagonal, above, right = bidiagonal(r)
    values = dqds(diagonal, above)
    rank = int(np.count_nonzero(values > len(r) * EPS * values.max(initial=0)))
    rng = np.random.default_rng(0)
    found: list[np.ndarray] = []
    for k in range(min(most, rank)):
        twisted = _Twisted(diagonal, above, values[k] ** 2)
        z = twisted.vector()
        # Directions of values that are (nearly) equal span one space: any basis of it does.
        close = [v for j, v in enumerate(found) if values[j] - values[k] <= CLUSTERED * values[j]]
        if close:
            for _ in range(4):
                z = _orthogonal(z, close)
                if not np.any(z):
                    z = _orthogonal(rng.standard_normal(len(z)), close)
                z = twisted.solve(z)
            z = _orthogonal(z, close)
        found.append(z)
    out = np.array(found).reshape(len(found), len(r))
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        out[:, k + 1 :] -= 2 * np.outer(out[:, k + 1 :] @ v, v)
    return values, out


def _orthogonal(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    before = np.linalg.norm(z)
    for _ in range(2):
        for v in others:
            z = z - (v @ z) * v
    size = np.linalg.norm(z)
    return z / size if size > 1e-10 * before else np.zeros_like(z)


# ---- the tables ----


def scaled(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """vec_id and x, whole steps of each vector that has entries for all of them."""
    values = F.col("embedding").cast("array<double>")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**62 // steps))
    kept = vectors.where(F.col("embedding").isNotNull() & F.forall(values, fits))
    return kept.select("vec_id", F.transform(values, lambda c: F.floor(c * steps).cast("bigint")).alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _width(rows: DataFrame) -> int:
    """The commonest length; a row for each length is made, one is read."""
    sizes = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows"))
    first = sizes.where("width > 0").orderBy(F.desc("rows"), "width").head()
    return first["width"] if first else 0


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each of their entries."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, dtype=object)
        for batch in batches:
            x = _matrix(batch, width)
            small = np.abs(x).max(initial=0) < MOST_LONG // max(len(x), 1)
            sums += (x if small else x.astype(object)).sum(0).astype(object)
            n += len(x)
        exact = pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
        at = pa.array(np.arange(width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array(np.full(width, n)), exact], ["at", "n", "s"])

    # One row for each entry and task.
    parts = fit.mapInArrow(add, "at int, n bigint, s decimal(38,0)")
    total = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at")
    found = total.collect()  # as many rows as a vector has entries
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [0] * width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles; the whole part of the mean is taken off in integers."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: of each task's blocks first, then of those, in rounds."""
    width = len(sums)

    def reduced(stacked: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(stacked), mode="r")

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            x = _matrix(batch, width)
            for low in range(0, len(x), QR_ROWS):
                r = reduced([r, _centred(x[low : low + QR_ROWS], n, sums)])
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]})

    def of_triangles(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        r = reduced([np.frombuffer(b).reshape(-1, width) for b in batch["r"]])
        return pd.DataFrame({"block": [int(key[0])], "r": [r.tobytes()]})

    parts = fit.select("x").mapInArrow(of_rows, "r binary")
    # Order and number of the blocks are free, so any even deal does.
    triangles = written(
        parts.select(F.spark_partition_id().alias("block"), "r"), "whitening-triangles"
    )
    top = triangles.agg(F.max("block")).head()[0]
    while top:
        merged = triangles.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int"))
        triangles = written(merged.groupBy("block").applyInPandas(of_triangles, TRIANGLE), "whitening-triangles")
        top //= FAN_IN
    last = np.frombuffer(triangles.head()["r"]).reshape(-1, width)  # one row, width by width
    return np.concatenate([last, np.zeros((width - len(last), width))]) if len(last) < width else last


def whiten(vectors: DataFrame, components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    all_rows = written(scaled(vectors, steps), "whitening-rows")
    width = _width(all_rows)
    rows = all_rows.where(F.size("x") == width)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, width) if width else (0, [])
    values, found = directions(_triangle(fit, n, sums), components) if n else (np.zeros(0), np.zeros((0, 0)))
    columns = f"{RESULT.format(kind)}, explained double, identity_error double"
    if not len(found):
        return spark.createDataFrame([], columns)
    # A triangle's singular values are those of the centred rows: e = value**2 / n.
    weights = (found / values[: len(found), None] * np.sqrt(n)).T
    explained = (values**2 / (values**2).sum())[: len(found)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _centred(_matrix(batch, width), n, sums) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], [f"w{i}" for i in range(k)])

    k = len(found)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = [F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]
    checked = fit.mapInArrow(project, ", ".join(f"w{i} double" for i in range(k))).agg(*moments).head()
    error = max(abs(checked[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                pa.array((_centred(x, n, sums) @ weights).ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened"])

    measured = rows.mapInArrow(measure, RESULT.format(kind))
    shares = F.element_at(F.lit(explained.tolist()), F.col("component"))
    return measured.select("*", shares.alias("explained"), F.lit(float(error)).alias("identity_error"))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over entries of (n x - S)^2, exactly; None beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most * most * len(sums) < MOST_LONG:
        off = n * x - np.array(sums, dtype=np.int64)
        return (off * off).sum(1)
    off = n * x.astype(object) - np.array(sums, dtype=object)
    exact = (off * off).sum(1)
    return np.array([v if v < 2**63 else None for v in exact], dtype=object)
