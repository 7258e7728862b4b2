"""Substring dedup by super-k-mers.

A window is ``WINDOW`` consecutive words of a document.  The minimiser of a window is its
run of ``RUN`` words with the smallest hash.  Consecutive windows with the same minimiser
travel as one string, a super-k-mer: the words that they cover, once, instead of ``WINDOW``
words for each.  Equal windows have equal minimisers, so they meet in one bucket.

1. Each task cuts its texts into super-k-mers.  Equal ones within a task's chunk are packed
   once, with the smallest place at which they stand; the windows of the others are already
   known as repeats.  What goes to one bucket is packed into one compressed string.
2. A bucket unpacks its strings, numbers its words exactly, sorts all windows by a hash of
   their word numbers and compares neighbours word by word.  All windows but the first of
   equal ones, by (document, start), are repeats.
3. Repeats come back as ranges of windows per document, are joined with the documents, and
   every word that a repeated window covers is left out.

Buckets are sized by the amount of text, about ``BUCKET_BYTES`` of packed words each, so one
fits into a task.  Buckets that hold much more, counted before anything is shuffled, belong
to very common runs of words; their windows are dealt out again, one by one, by a hash of
the whole window.  Copies of one window meet at most once per chunk of input.

Defined results: a null text has no words; documents shorter than a window keep all words;
a null id comes before all others; rows with one id but different texts are ordered by a
hash of the text; repeated rows (same id, same text) count as one document and are treated
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import batch_bytes, written
from partlog.llm.words import Words, chunks, mix, runs
from partlog.plans.bounds import BROADCAST_ROWS, at_most

WINDOW = 20
RUN = 3
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
HOT = 8  # times the mean
LEVEL = 3

FIRST = -(2**63)
PACKED = "bucket bigint, packed binary"
RANGES = "doc bigint, text_key bigint, low bigint, high bigint"


def _smallest(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each ``k`` consecutive values."""
    n, span = len(h) - k + 1, 1
    if n <= 0:
        return h[:0]
    while 2 * span <= k:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[:n], h[k - span : k - span + n])


class _Chunk:
    """Some texts cut into super-k-mers."""

    def __init__(self, rows: list[tuple[int, int, bytes]], window: int, run: int):
        self.words = Words([t for _, _, t in rows])
        first = self.words.first
        h = self.words.hashes()
        n = len(h) - window + 1
        self.whole = runs(h, window)
        least = _smallest(runs(h, run), window - run + 1)
        of = self.words.of_text()
        self.inside = of[:n] == of[window - 1 :] if n > 0 else np.zeros(0, dtype=bool)
        self.of, self.first, self.least, self.window = of, first, least, window

    def super_kmers(self, buckets: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, number of windows, bucket) of each."""
        if not self.inside.any():
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        bucket = (mix(self.least) % np.uint64(buckets)).astype(np.int64)
        n = len(self.inside)
        new = np.ones(n, dtype=bool)
        new[1:] = (
            (self.least[1:] != self.least[:-1])
            | (self.of[1:n] != self.of[: n - 1])
            | ~self.inside[:-1]
        )
        if len(hot):
            alone = np.isin(bucket, hot)
            # One window each, dealt over as many buckets again by the whole window.
            spread = buckets + (mix(self.whole) % np.uint64(buckets)).astype(np.int64)
            bucket = np.where(alone, spread, bucket)
            new |= alone
        start = np.flatnonzero(new & self.inside)
        ends = np.flatnonzero(np.append(new | ~self.inside, True))
        end = ends[np.searchsorted(ends, start, "right")]
        return start, end - start, bucket[start]


def _rows(batches: Iterator[pd.DataFrame], most: int) -> Iterator[list[tuple]]:
    for batch in batches:
        texts = (
            (int(i), int(k), b" ".join(t.encode("utf-8", "surrogatepass").split()))
            for i, k, t in zip(batch["doc"], batch["text_key"], batch["text"])
        )
        yield from chunks(texts, lambda r: len(r[2]), most)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with their id as ``doc`` and a hash of the text, 0 if the id names one text."""
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("doc"),
        F.xxhash64("text").alias("_hash"),
        F.col("doc_id").cast("string").alias("doc_id"),
        "text",
    )
    texts = given.groupBy("doc").agg(F.min("_hash").alias("low"), F.max("_hash").alias("high"))
    shared = written(texts.where("low <> high").select("doc"), "kmer-shared-ids")
    if shared.isEmpty():
        return given.withColumn("text_key", F.lit(0).cast("bigint")).drop("_hash")
    shared = shared.withColumn("_shared", F.lit(True))
    if at_most(shared, BROADCAST_ROWS):
        shared = F.broadcast(shared)
    key = F.when(F.col("_shared"), F.col("_hash")).otherwise(F.lit(0))
    return given.join(shared, "doc", "left").select("doc", key.alias("text_key"), "doc_id", "text")


def _sizes(given: DataFrame, buckets: int, window: int, run: int) -> DataFrame:
    """Words that super-k-mers would bring to each bucket, at most one row per task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, int] = {}
        none = np.zeros(0, dtype=np.int64)
        for rows in _rows(batches, CHUNK_BYTES):
            _, n, bucket = _Chunk(rows, window, run).super_kmers(buckets, none)
            ids, at = np.unique(bucket, return_inverse=True)
            for b, w in zip(ids.tolist(), np.bincount(at, n + window - 1).tolist()):
                total[b] = total.get(b, 0) + int(w)
        yield pd.DataFrame({"bucket": list(total), "words": list(total.values())}, dtype="int64")

    return given.mapInPandas(count, "bucket bigint, words bigint")


def _pack(
    given: DataFrame, buckets: int, hot: np.ndarray, window: int, run: int
) -> DataFrame:
    """One packed string per chunk and bucket; bucket -1 holds repeats found at once."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for rows in _rows(batches, CHUNK_BYTES):
            chunk = _Chunk(rows, window, run)
            start, n, bucket = chunk.super_kmers(buckets, hot)
            if not len(start):
                continue
            text = chunk.of[start]
            doc = np.array([r[0] for r in rows], dtype=np.int64)[text]
            key = np.array([r[1] for r in rows], dtype=np.int64)[text]
            place = start - chunk.first[text]
            order = np.lexsort((place, key, doc, bucket))
            low = chunk.words.start[start].tolist()
            high = chunk.words.end[start + n + window - 2].tolist()
            buffer = chunk.words.buffer
            out_bucket, out_packed, again = [], [], []
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, cuts):
                seen: dict[bytes, int] = {}
                kept = []
                for s in part.tolist():
                    string = buffer[low[s] : high[s]]
                    lead = seen.setdefault(string, s)
                    if lead == s:
                        kept.append(s)
                    elif (doc[s], key[s], place[s]) != (doc[lead], key[lead], place[lead]):
                        again.append(s)
                places = _steps(np.stack([doc[kept], key[kept], place[kept], n[kept]]))
                body = b"\n".join(seen)
                out_bucket.append(int(bucket[part[0]]))
                out_packed.append(
                    press.compress(len(kept).to_bytes(8, "little") + places + body)
                )
            if again:
                ranges = _steps(np.stack([doc[again], key[again], place[again], n[again]]))
                out_bucket.append(-1)
                out_packed.append(press.compress(ranges))
            yield pd.DataFrame({"bucket": out_bucket, "packed": out_packed})

    return given.mapInPandas(pack, PACKED)


def _exact_words(words: Words) -> np.ndarray:
    """A number for each word: equal numbers for equal words only."""
    codes, _ = pd.factorize(words.hashes())
    first = np.zeros(codes.max(initial=-1) + 1, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    rep = first[codes]
    length = words.end - words.start
    same = length == length[rep]
    raw = np.frombuffer(words.buffer, dtype=np.uint8)
    at = np.flatnonzero(same & (rep != np.arange(len(rep))))
    depth = 0
    while at.size:
        same[at] &= raw[words.start[at] + depth] == raw[words.start[rep[at]] + depth]
        depth += 1
        at = at[(length[at] > depth) & same[at]]
    if not same.all():  # two words with one hash: number them by what they are
        known: dict[bytes, int] = {}
        spans = zip(words.start.tolist(), words.end.tolist())
        return np.array([known.setdefault(words.buffer[a:b], len(known)) for a, b in spans])
    return codes


def _repeats(packed: list[bytes], window: int) -> np.ndarray:
    """Rows (document, text key, low, high) of the repeated windows of a bucket."""
    open_ = zstandard.ZstdDecompressor()
    places, bodies = [], []
    for one in packed:
        raw = open_.decompress(one)
        count = int.from_bytes(raw[:8], "little")
        end = 8 + 32 * count
        places.append(_places(raw[8:end]))
        bodies.append(raw[end:])
    doc, key, place, n = np.concatenate(places, axis=1)
    words = Words(bodies)
    ids = _exact_words(words)
    # The words of super-k-mer s follow those of s - 1.
    sizes = n + window - 1
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[of] + step
    h = runs(ids.astype(np.uint64) + np.uint64(1), window)[at]
    where = place[of] + step
    order = np.lexsort((where, key[of], doc[of], h))
    h, at, of, where = h[order], at[order], of[order], where[order]
    new = np.append(True, h[1:] != h[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    rest = np.flatnonzero(~new)
    equal = np.ones(len(rest), dtype=bool)
    for t in range(window):
        equal &= ids[at[rest] + t] == ids[at[lead[rest]] + t]
    if not equal.all():  # windows that share a hash: compare by what they are
        groups: dict[tuple, int] = {}
        lead = np.array(
            [groups.setdefault(tuple(ids[a : a + window].tolist()), k) for k, a in enumerate(at.tolist())]
        )
        rest = np.flatnonzero(lead != np.arange(len(lead)))
    # A window that stands where the first one stands is that window (repeated rows).
    d, k = doc[of], key[of]
    first = lead[rest]
    other = (d[rest] != d[first]) | (k[rest] != k[first]) | (where[rest] != where[first])
    rest = rest[other]
    return np.stack([d[rest], k[rest], where[rest], where[rest] + 1])


def _steps(places: np.ndarray) -> bytes:
    """Rows of numbers as steps, byte by byte, which compress well."""
    step = np.diff(places, axis=1, prepend=0).astype("<i8")
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def _places(raw: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T)
    return np.cumsum(step.reshape(-1).view("<i8").reshape(4, -1), axis=1)


def _merged(ranges: np.ndarray) -> pd.DataFrame:
    """Ranges of windows, those that touch made one."""
    doc, key, low, high = ranges
    order = np.lexsort((low, key, doc))
    doc, key, low, high = doc[order], key[order], low[order], high[order]
    if not len(doc):
        return pd.DataFrame({"doc": doc, "text_key": key, "low": low, "high": high})
    turn = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    # Highest end so far, starting anew with each document.  In integers: exact for any number.
    base = (np.cumsum(turn) - 1) * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + base) - base
    new = turn.copy()
    new[1:] |= low[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return pd.DataFrame(
        {
            "doc": doc[begin],
            "text_key": key[begin],
            "low": low[begin],
            "high": reach[end],
        }
    )


def repeated_ranges(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Ranges [low, high) of window starts, per document, that stand earlier elsewhere."""
    return _ranges(_keyed(docs), window, run)


def _ranges(keyed: DataFrame, window: int, run: int) -> DataFrame:
    spark = keyed.sparkSession
    batch_bytes(spark)
    given = keyed.select("doc", "text_key", "text").where("text is not null")
    size = given.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(1, 3 * size // BUCKET_BYTES)
    sizes = written(
        _sizes(given, buckets, window, run).groupBy("bucket").agg(F.sum("words").alias("words")),
        "kmer-sizes",
    )
    mean = (sizes.agg(F.sum("words")).head()[0] or 0) / buckets
    # At most buckets / HOT of them.
    hot = sizes.where(F.col("words") > HOT * mean).select("bucket").collect()
    hot = np.array(sorted(r["bucket"] for r in hot), dtype=np.int64)
    packed = _pack(given, buckets, hot, window, run)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor()
        now: int | None = None
        held: list[bytes] = []
        for batch in batches:
            for bucket, one in zip(batch["bucket"].tolist(), batch["packed"]):
                if bucket == -1:
                    doc, key, place, n = _places(open_.decompress(one))
                    yield _merged(np.stack([doc, key, place, place + n]))
                    continue
                if bucket != now:
                    if held:
                        yield _merged(_repeats(held, window))
                    now, held = bucket, []
                held.append(one)
        if held:
            yield _merged(_repeats(held, window))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets // 2, 20_000))
    # Repeats found at once need no bucket: they are dealt out by their chunk.
    dealt = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-F.abs(F.hash("packed")))
    return (
        packed.repartition(tasks, dealt).sortWithinPartitions("bucket").mapInPandas(find, RANGES)
    )


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, run: int = RUN, with_text: bool = True
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and ``kept``, the words that stay, if asked for.

    Rows of ``docs`` in, rows out; a word goes if a repeated window covers it.
    """
    given = _keyed(docs)
    ranges = _ranges(given, window, run)
    per_doc = written(
        ranges.groupBy("doc", "text_key").agg(
            F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")
        ),
        "kmer-ranges",
    )
    joined = given.join(per_doc, ["doc", "text_key"], "left").select("doc_id", "text", "lows", "highs")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, lows, highs in zip(
                batch["doc_id"], batch["text"], batch["lows"], batch["highs"]
            ):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if lows is not None:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(gone, lows, 1)
                    np.add.at(gone, np.minimum(np.asarray(highs) + window - 1, n), -1)
                    stay = np.flatnonzero(np.cumsum(gone[:n]) == 0)
                    words = [words[k] for k in stay.tolist()]
                kept = b" ".join(words)
                digest = hashlib.sha256(kept).hexdigest()
                body = kept.decode("utf-8", "surrogatepass") if with_text else None
                out.append((doc_id, n, n - len(words), digest, body))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in KEPT.split(", ")])

    found = joined.mapInPandas(cut, KEPT.replace("doc_id bigint", "doc_id string", 1))
    found = found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return found if with_text else found.drop("kept")
