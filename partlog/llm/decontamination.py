"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII signs, in lower case.  A document and a
benchmark item that share a seed, some consecutive words, are compared: the longest match
of words not yet marked is marked in both as a tile, again and again, until no match of at
least the seed's length is left.  The matches are found by running Karp-Rabin: hashes of
consecutive words of the item are looked up in the document, and equal hashes are compared
word by word and extended.  Tiles do not overlap, but may stand in any order, so passages
whose sentences have been moved are found too.  An item is covered by the share of its words
that lie in tiles; a document that covers an item to the threshold is contaminated.

The benchmark is the stated query set and goes over all documents in blocks of at most
about ``BLOCK_WORDS`` words, so what a task holds does not grow with it.  Documents are never
shuffled: a block's seeds travel with the tasks, and every text is read where it lies.

Defined results: null and empty texts share nothing; an item shorter than a seed is found in
documents that consist of its words; an item without words is found nowhere; an item that is longer than a block is a block of its own; repeated
rows are judged alike, each for itself; null ids stay; further columns are ignored by
``tiles``, kept by ``decontaminate`` whatever their names, and by ``judged`` unless they are
named like the columns that it adds; empty tables give no tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import batch_bytes, written
from partlog.llm.words import Words, chunks, runs
from partlog.plans.bounds import BROADCAST_ROWS, at_most

SEED_WORDS = 5
THRESHOLD = 0.5
BLOCK_WORDS = 200_000
CHUNK_BYTES = 4 << 20
PRODUCT = 1 << 20  # pairs of equal seeds that are looked at together

TILES = (
    "doc_id bigint, text_key bigint, item_id bigint, item_words int, covered int,"
    " longest int, n_tiles int, coverage double"
)

#: Bytes as they count in words: capitals in lower case, ASCII signs as spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def text_key(text: Column) -> Column:
    """Tells rows with one id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def tile(item: list, doc: list, pairs: list[tuple[int, int]], least: int) -> list[tuple]:
    """(item start, document start, length) of the tiles, longest first.

    ``pairs`` are the starts of equal runs of ``least`` words.
    """
    item_free, doc_free = bytearray(b"\1") * len(item), bytearray(b"\1") * len(doc)
    # Along a diagonal a run that goes on from the one before is part of the same match.
    known = set(pairs)
    open_ = [p for p in known if (p[0] - 1, p[1] - 1) not in known]
    queue: dict[int, list[tuple[int, int]]] = {}

    def extend(i: int, j: int) -> None:
        n, most = 0, min(len(item) - i, len(doc) - j)
        while n < most and item_free[i + n] and doc_free[j + n] and item[i + n] == doc[j + n]:
            n += 1
        if n >= least:
            queue.setdefault(n, []).append((i, j))

    for i, j in open_:
        extend(i, j)
    out = []
    while queue:
        n = max(queue)
        for i, j in sorted(queue.pop(n)):
            blocked = item_free.find(0, i, i + n), doc_free.find(0, j, j + n)
            if max(blocked) < 0:
                item_free[i : i + n] = doc_free[j : j + n] = bytes(n)
                out.append((i, j, n))
                continue
            k = 0
            while k < n:  # what is left of the match between marked words
                while k < n and not (item_free[i + k] and doc_free[j + k]):
                    k += 1
                m = k
                while m < n and item_free[i + m] and doc_free[j + m]:
                    m += 1
                if m - k >= least:
                    queue.setdefault(m - k, []).append((i + k, j + k))
                k = m
    return out


def _starts(block: _Block, at, low, high, of, first) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Per (document, item) where equal runs of seeds start, as (item word, document word).

    Seeds that go on from one another along a diagonal are one run, so a text that repeats a
    word gives as many starts as it has words and not their product.
    """
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    ends = np.cumsum(high - low)
    done = 0
    while done < len(at):
        # A document's seeds stay together; documents with few are taken many at a time.
        more = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PRODUCT, "right")), done + 1)
        last = int(np.searchsorted(of[at], of[at[more - 1]], "right"))
        n = high[done:last] - low[done:last]
        place = np.repeat(at[done:last], n)
        seed = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[done:last], n)
        item, i = block.item[seed], block.at[seed]
        doc = of[place]
        j = place - first[doc]
        order = np.lexsort((i, j - i, item, doc))
        doc, item, i, j = doc[order], item[order], i[order], j[order]
        follows = (np.diff(i) == 1) & (np.diff(j) == 1) & (np.diff(item) == 0) & (np.diff(doc) == 0)
        new = np.append(True, ~follows)
        for d, m, x, y in zip(doc[new].tolist(), item[new].tolist(), i[new].tolist(), j[new].tolist()):
            out.setdefault((d, m), []).append((x, y))
        done = last
    return out


class _Block:
    """Seeds of some benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str]], k: int):
        self.ids = [i for i, _ in items]
        words = Words([fold(t) for _, t in items])
        self.words = [w.split() for w in (fold(t) for _, t in items)]
        # Items without a seed, by their words.
        self.short: dict[bytes, list[int]] = {}
        for n, found in enumerate(self.words):
            if 0 < len(found) < k:
                self.short.setdefault(b" ".join(found), []).append(n)
        h, of = runs(words.hashes(), k), words.of_text()
        within = np.arange(len(h)) - words.first[of[: len(h)]]
        inside = of[: len(h)] == of[k - 1 :] if len(h) else np.zeros(0, dtype=bool)
        h, self.item, self.at = h[inside], of[: len(h)][inside], within[inside]
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], self.item[order], self.at[order]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``h`` that meet seeds, and those seeds as ranges."""
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(self.hash, h[maybe], "left")
        high = np.searchsorted(self.hash, h[maybe], "right")
        found = high > low
        return maybe[found], low[found], high[found]


def _blocks(benchmark: DataFrame, k: int, block_words: int) -> Iterator[_Block]:
    """The benchmark in blocks; each is read on its own."""
    size = F.size(F.split(F.col("text"), r"\s+"))
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), "text", size.alias("n")
    ).where("text is not null")
    total = items.agg(F.sum("n")).head()[0] or 0
    count = -(-total // block_words) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for b in range(count):
        rows = items.where(block == b).orderBy("item_id", "text").toLocalIterator()
        yield from (
            _Block(part, k)
            for part in chunks(((r["item_id"], r["text"]) for r in rows), lambda r: len(r[1]), 8 * block_words)
        )


def tiles(
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = SEED_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and item that share a seed: columns as in ``TILES``."""
    batch_bytes(docs.sparkSession)
    given = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        text_key(F.col("text")).alias("text_key"),
        "text",
    ).where("text is not null")
    k = seed_words
    out = None
    for block in _blocks(benchmark, k, block_words):

        def rows(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            names = [c.split()[0] for c in TILES.split(", ")]
            for batch in batches:
                found = []
                texts = zip(batch["doc_id"], batch["text_key"], map(fold, batch["text"]))
                for part in chunks(texts, lambda r: len(r[2]), CHUNK_BYTES):
                    words = Words([t for _, _, t in part])
                    h, of = runs(words.hashes(), k), words.of_text()
                    at, low, high = block.hits(h)
                    inside = of[at] == of[at + k - 1]
                    at, low, high = at[inside], low[inside], high[inside]
                    for d in np.flatnonzero(np.diff(words.first) < k) if block.short else ():
                        whole = b" ".join(part[d][2].split())
                        for i in block.short.get(whole, ()):
                            n = len(block.words[i])
                            found.append((*part[d][:2], block.ids[i], n, n, n, 1, 1.0))
                    pairs = _starts(block, at, low, high, of, words.first)
                    split: dict[int, list[bytes]] = {}
                    for (d, i), starts in pairs.items():
                        if d not in split:
                            split = {d: part[d][2].split()}
                        item = block.words[i]
                        done = tile(item, split[d], starts, k)
                        if done:
                            covered = sum(n for _, _, n in done)
                            found.append(
                                (
                                    part[d][0],
                                    part[d][1],
                                    block.ids[i],
                                    len(item),
                                    covered,
                                    max(n for _, _, n in done),
                                    len(done),
                                    covered / len(item),
                                )
                            )
                yield pd.DataFrame(found, columns=names)

        part = given.mapInPandas(rows, TILES.replace("doc_id bigint", "doc_id string", 1))
        part = written(part, "tiles")  # a block at a time is on the driver and in the tasks
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], TILES)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def verdicts(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, **options
) -> DataFrame:
    """Per document with an item at the threshold: doc_id, text_key, items, coverage."""
    found = tiles(docs, benchmark, **options).where(F.col("coverage") >= threshold)
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("minus")))
    # Repeated rows find their items as often as they stand there.
    return (
        found.groupBy("doc_id", "text_key")
        .agg(best.alias("best"), F.count_distinct("item_id").alias("n_items"))
        .select(
            "doc_id",
            "text_key",
            (-F.col("best.minus")).alias("item_id"),
            F.col("best.coverage").alias("coverage"),
            "n_items",
        )
    )


def judged(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``contaminated``, the best covered item, its coverage and ``n_items``."""
    names = ("contaminated", "item_id", "coverage", "n_items")
    given = docs.select(*[c for c in docs.columns if c not in names])
    found, same = _leaks(given, benchmark, threshold)
    return given.join(found, same, "left").select(
        *[given[c] for c in given.columns],
        found["_leak"].isNotNull().alias("contaminated"),
        found["item_id"],
        F.coalesce(found["coverage"], F.lit(0.0)).alias("coverage"),
        F.coalesce(found["n_items"], F.lit(0)).alias("n_items"),
    )


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> tuple[DataFrame, Column]:
    """(verdicts, the condition that joins them to ``docs``)."""
    found = written(verdicts(docs, benchmark, threshold), "leaks")
    found = found.withColumnsRenamed({"doc_id": "_doc", "text_key": "_leak"})
    if at_most(found, BROADCAST_ROWS):
        found = F.broadcast(found)
    same = docs["doc_id"].eqNullSafe(found["_doc"]) & (text_key(docs["text"]) == found["_leak"])
    return found, same


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the contaminated ones."""
    found, same = _leaks(docs, benchmark, threshold)
    return docs.join(found, same, "left_anti")
