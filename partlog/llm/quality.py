"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_features`` reads every whole text once and gives one row of statistics per
document.  ``fit`` trains boosted trees on a bounded sample of labelled rows: features are
cut into quantile bins, and every split is found on per-bin sums of gradients.  The trees
are flattened into arrays (feature, threshold, left child, value), and ``score`` walks all
rows of a batch down all trees at once with numpy.

The sample: at most ``sample_rows`` labelled rows, those with the smallest hash of their
id.  The bound keeps what the driver holds to a few MB; everything else covers all rows.

Defined results: a null text counts as an empty one; empty texts get a score; repeated rows
are scored alike; rows with a null label are not used; several labels of one document are
rows of their own; without any label, or with labels of one kind only, the score is the
constant share of good labels (0.5 if there are none); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import batch_bytes, written

SAMPLE_ROWS = 20_000
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 64
THRESHOLD = 0.7

FEATURES = (
    "log_words log_bytes mean_word longest_word distinct_words top_word repeated_next"
    " upper digits marks spaces pipes bangs lines repeated_lines mean_line ended_lines"
    " distinct_pairs short_words marked_words upper_words vowel_free"
).split()

_VOWELS = set("aeiouyàâäéèêëíîïóôöúùûüáñ")


def text_features(text: str | None) -> tuple[float, ...]:
    """Statistics of one text, in the order of ``FEATURES``."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0, math.log1p(size)) + (0.0,) * (len(FEATURES) - 2)
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = np.bincount(raw, minlength=256)
    upper = int(kinds[65:91].sum())
    lower = int(kinds[97:123].sum())
    digits = int(kinds[48:58].sum())
    spaces = int(kinds[9:14].sum() + kinds[32])
    wide = int(kinds[128:].sum())
    marks = len(raw) - upper - lower - digits - spaces - wide
    distinct = len(counts)
    vowel_free = marked = upper_words = 0
    for w, k in counts.items():
        if not w[-1].isalnum() and (len(w) < 2 or not w[-2].isalnum()):
            marked += k
        if w.isupper() and len(w) > 1:
            upper_words += k
        if len(w) > 3 and _VOWELS.isdisjoint(w.lower()):
            vowel_free += k
    return (
        math.log1p(n),
        math.log1p(size),
        size / n,
        float(max(map(len, counts))),
        distinct / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        upper / (upper + lower + 1),
        digits / len(raw),
        marks / len(raw),
        spaces / len(raw),
        kinds[124] / n,
        kinds[33] / n,
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(len(lines), 1),
        len(pairs) / max(n - 1, 1),
        sum(k for w, k in counts.items() if len(w) <= 2) / n,
        marked / n,
        upper_words / n,
        vowel_free / n,
    )


def document_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics of each document as ``features`` (array<double>)."""
    batch_bytes(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").alias("_text"))
    schema = [f for f in kept.schema.fields if f.name != "_text"]
    names = [f.name for f in schema]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["features"] = [text_features(t) for t in batch["_text"]]
            yield out

    return kept.mapInPandas(rows, f"{ddl}, features array<double>")


@dataclass
class Trees:
    """Flattened trees: node ``i`` of tree ``t`` has children ``2i+1`` and ``2i+2``."""

    base: float
    feature: np.ndarray  # (trees, inner nodes), -1: always left
    threshold: np.ndarray  # (trees, inner nodes): left if value <= threshold
    value: np.ndarray  # (trees, leaves)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < len(feature):
                f = feature[node]
                right = (x[rows, np.maximum(f, 0)] > threshold[node]) & (f >= 0)
                node = 2 * node + 1 + right
            total += value[node - len(feature)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
    rate: float = RATE,
    bins: int = BINS,
    ridge: float = 1.0,
) -> Trees:
    """Boosted trees for log loss; splits from histograms of quantile bins."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = math.log(share / (1 - share))
    out = Trees(
        base,
        np.full((0, inner), -1, dtype=np.int64),
        np.zeros((0, inner)),
        np.zeros((0, leaves)),
    )
    if len(set(y.tolist())) < 2:
        return out
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * bins
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.full(inner, -1), np.zeros(inner)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * bins) + flat).ravel()
            size = width * m * bins
            hist_g = np.bincount(at, np.repeat(g, m), size).reshape(width, m, bins)
            hist_h = np.bincount(at, np.repeat(h, m), size).reshape(width, m, bins)
            gl, hl = hist_g.cumsum(2), hist_h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            f = feature[node]
            node = 2 * node + 1 + ((x[np.arange(n), np.maximum(f, 0)] > threshold[node]) & (f >= 0))
        leaf = node - inner
        sum_g, sum_h = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = -rate * sum_g / (sum_h + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def fit(
    features: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> Trees:
    """Train on at most ``sample_rows`` labelled rows that are not held out."""
    usable = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(
        ~held_out(F.col("doc_id")) & F.col("label").isNotNull()
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    known = features.select("doc_id", "features").join(chosen, "doc_id")
    rows = known.limit(2 * sample_rows).orderBy("doc_id", "label").collect()
    if not rows:
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array([r["features"] for r in rows], dtype=np.float64)
    return fit_trees(x, np.array([r["label"] for r in rows], dtype=np.float64))


def score(features: DataFrame, trees: Trees) -> DataFrame:
    """``features`` with ``score`` in place of the statistics."""
    fields = [f for f in features.schema.fields if f.name != "features"]
    names = [f.name for f in fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            if len(batch):
                out["score"] = trees.scores(np.stack(batch["features"].to_numpy()))
            else:
                out["score"] = np.zeros(0)
            yield out

    return features.mapInPandas(rows, f"{ddl}, score double")


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each document's ``score`` and ``predicted`` (1 if the score is at least 0.7)."""
    features = written(document_features(docs, keep), "quality-features")
    scored = score(features, fit(features, labels))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; texts do not move."""
    trees = fit(written(document_features(docs), "quality-features"), labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("text").to_pylist()
                good = trees.scores(np.array([text_features(t) for t in texts])) >= THRESHOLD
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(rows, docs.schema)
