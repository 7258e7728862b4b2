"""N-gram Jaccard join: documents whose sets of word shingles are at least 0.75 alike.

Two sets of sizes s >= t link when 100 * |x & y| >= 75 * |x | y|; then they differ in at most
(s + t) / 7 shingles, and t >= 3 s / 4.

Classes.  Equal sets are one class and go on as one document, however many copies there are.

Segments.  Sizes fall into bands, each a third wider than the one before, so a set's partner
of smaller size is in its own band or the one below.  A band cuts the universe of shingle
hashes into segments by ranges.  A set is indexed in its band, and visits the band below.
What a set has in one segment, as one hash, is a signature.  Each differing shingle spoils
one signature, so sets that differ in at most H share one of any H + 1 that both choose in
the same order, as long as one of them has more than H to choose from (pigeonhole).

Allocation.  A first pass counts all signatures.  Those of more than ``HOT`` sets, such as a
common passage makes, cost most and are never chosen; sets choose H + 1 of the others, the
rarest first, as bounded bit sets of the repeated ones tell, then by smallest hash.  A signature
that no other set has needs no indexing, but counts as chosen.  Sets with no more than H cheap
segments index them all and are compared with each other once more by single shingles, the
finest segments.  These are counted in the same way first, so a set sends only the first quarter
of its shingles, rarest first, without those of no other set.  In the smallest sizes, where one
shingle may differ, one segment with its one-deletion neighbourhood does: the whole set, and the
set without any one shingle.

Verification.  Sets that share a signature form a group.  Pairs of one pivot of each group
with the others are verified, then components are formed, and only pairs whose ends are
still apart go on: once more with several pivots, then all that are left, each with one end
outside the pivot's component.  A pivot is the member with the fewest signatures or shingles
rarer than the group's: copies with many changes have the more of these, the text they were
made from has none, and links with it join most copies at once.  What comes before a group's
signature in a set is in no other set that first meets it there, so it bounds what two sets
share: pairs that it rules out are not made, and members that it leaves without a partner of
any size in their group leave it.  So no group of near copies is ever expanded into all its
pairs, and no link between different components is missed.  A pair first compares bitmaps of hashed shingles, about two bits for each: bits
that differ are a lower bound of the shingles that differ, so a pair with more of them than
two linked sets may have is dropped for certain.  The others are verified on the texts.

Shingles and sets are told apart by 64-bit hashes; among N of them the chance that any two
clash is about N * N / 2**65.

Defined results: null, empty and blank texts have an empty set and link with nothing; with
fewer than five words the whole sequence is the only shingle; repeated rows are copies; rows
with one id but different texts are sets of their own that share a name; null ids never give
a component its name unless it has no other; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlog.llm.common import batch_bytes, written
from partlog.llm.components import components
from partlog.llm.words import Words, chunks, mix, runs
from partlog.plans import bloom

SHINGLE = 5
SIMILAR, OF = 75, 100
HOT = 64
MOST_HOT = 1_000_000
RARE = 8  # signatures of more sets are chosen after all others
STEPS = (1, 8, 64, 512)  # the same for shingles, of which those of more sets come later at each step
MOST_SLOTS = 27  # bits of a signature that name its place in a bit set: 16 MB
MOST_MARKS = 1 << 27  # bits that say which texts are needed: 16 MB
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
PIVOTS = (1, 16)  # most central members of each group, in the rounds before the last
DELETION_SIZE = 6  # up to here sets differ in at most one shingle from smaller ones

_SALT = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HIGH = np.uint64(32)

SETS = "doc string, text_key bigint, n bigint, class bigint"
PACKED = "bucket int, packed binary"


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words([t.translate(_LOWER) for t in texts])
    h = words.hashes()
    whole = runs(h, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = b - a
        if n >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        elif n:
            out.append(mix(runs(h[a:b], n) + np.uint64(n)))
        else:
            out.append(whole[:0])
    return out


def set_name(s: np.ndarray) -> int:
    """A hash of a whole set, signed."""
    total = mix(s ^ _SALT).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def _bands(most: int) -> list[int]:
    """Smallest size of each band."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, -(-4 * lows[-1] // 3)))
    return lows


LOWS = np.array(_bands(1 << 40), dtype=np.int64)


def signatures(s: np.ndarray, band: int) -> np.ndarray:
    """One hash per segment of ``band`` that ``s`` (sorted) has shingles in."""
    segments = max(16, int(0.6 * LOWS[band + 1]))
    if segments < 1 << 31:
        at = ((s >> _HIGH) * np.uint64(segments)) >> _HIGH
    else:
        at = s // np.uint64((1 << 64) // segments + 1)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    total = np.add.reduceat(mix(s ^ _SALT), start)
    salt = np.uint64(band * int(_SALT) & (1 << 64) - 1)
    return mix(total + mix(at[start] + salt))


def deletions(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the whole set, the set without each one shingle), as hashes."""
    each = mix(s ^ _SALT)
    total = each.sum(dtype=np.uint64)
    return mix(np.array([total], dtype=np.uint64)), mix(total - each)


def bitmap(s: np.ndarray) -> bytes:
    """A power of two of bits, at least two for each shingle; those of its hashes are set."""
    size = 1 << max(6, (2 * len(s) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[s & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of the two sets only."""
    if len(a) < len(b):
        a, b = b, a
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while n > 8 * len(b):  # fold the longer one
        n //= 2
        x = (x >> n) | (x & ((1 << n) - 1))
    return (x ^ y).bit_count()


def most_difference(n: int, m: int) -> int:
    """Linked sets of these sizes differ in at most so many shingles."""
    return n + m - 2 * -(-SIMILAR * (n + m) // (SIMILAR + OF))


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _texts(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    for batch in batches:
        rows = zip(*(batch[c].tolist() for c in columns), batch["text"])
        coded = ((*r[:-1], _encoded(r[-1])) for r in rows)
        yield from chunks(coded, lambda r: len(r[-1]), CHUNK_BYTES)


def describe_sets(docs: DataFrame) -> DataFrame:
    """Size and class of each document's set: columns as in ``SETS``."""
    batch_bytes(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _texts(batches, ["doc", "text_key"]):
            found = [
                (doc, key, len(s), set_name(s) if len(s) else 0)
                for (doc, key, _), s in zip(part, shingle_sets([r[-1] for r in part]))
            ]
            yield pd.DataFrame(found, columns=["doc", "text_key", "n", "class"])

    return _keyed(docs).mapInPandas(rows, SETS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("string").alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        "text",
    )


def _representatives(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Texts of one document per class; empty sets have none.

    A bounded filter of the copies tells most documents at once that they are none, so their
    texts stay where they are; only those that may be copies are joined.
    """
    first = sets.where("n > 0").groupBy("class").agg(F.min(F.struct("doc", "text_key")).alias("f"))
    copies = written(
        sets.join(first, "class", "left")
        .where(F.col("f").isNull() | (F.struct("doc", "text_key") != F.col("f")))
        .select("doc", "text_key")
        .distinct(),
        "jaccard-copies",
    )
    maybe, never = bloom.split(_keyed(docs), copies, ["doc", "text_key"])
    named = copies.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    rest = written(maybe.join(named, same, "left_anti").select("text"), "jaccard-texts")
    return never.select("text").unionByName(rest)


def _index(s: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, int]]:
    """(band, home, signatures, differences allowed) of one set; band -1: deletions."""
    n = len(s)
    if n <= DELETION_SIZE:
        whole, less = deletions(s)
        if 3 <= n < DELETION_SIZE:
            yield -1, True, whole, n
        if 4 <= n:
            yield -1, False, less, n
    if n < DELETION_SIZE:
        return
    band = int(np.searchsorted(LOWS, n, "right")) - 1
    yield band, True, signatures(s, band), n // 3
    if LOWS[band - 1] >= DELETION_SIZE:
        yield band - 1, False, signatures(s, band - 1), 2 * n // 7


def _press(columns: list[np.ndarray]) -> bytes:
    """Arrays of one type each, compressed; the first one is sorted and sent as steps."""
    out = [len(c).to_bytes(8, "little") for c in columns]
    for k, c in enumerate(columns):
        c = np.diff(c, prepend=c.dtype.type(0)) if k == 0 else c
        width = c.dtype.itemsize
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, width).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpress(packed: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    sizes = [int.from_bytes(raw[8 * k : 8 * k + 8], "little") for k in range(len(kinds))]
    at, out = 8 * len(kinds), []
    for k, (n, kind) in enumerate(zip(sizes, kinds)):
        width = np.dtype(kind).itemsize
        block = np.frombuffer(raw[at : at + n * width], dtype=np.uint8).reshape(width, n)
        c = np.ascontiguousarray(block.T).reshape(-1).view(kind)
        out.append(np.cumsum(c, dtype=kind) if k == 0 else c)
        at += n * width
    return out


def _by_bucket(sig: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of the sorted ``sig`` that belong to each bucket, by range."""
    edges = [(b << bits) // buckets for b in range(1, buckets)]
    cuts = np.searchsorted(sig, np.array(edges, dtype=np.uint64))
    cuts = [0, *cuts.tolist(), len(sig)]
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, slice(cuts[b], cuts[b + 1])


def _bits(size: int, spare: int) -> int:
    """Bits of a signature that tell about ``size`` / 8 of them apart, with some to spare."""
    return min(64, max(32, (size // 8).bit_length() + spare))


def _signatures_of(s: np.ndarray) -> list[np.ndarray]:
    return [sig for band, _, sig, _ in _index(s) if band >= 0]


def _counted(
    texts: DataFrame,
    of: Callable[[np.ndarray], list[np.ndarray]],
    steps: tuple[int, ...],
    listed: int | None,
    buckets: int,
    bits: int,
    slots: int,
) -> DataFrame:
    """How many sets have a hash that ``of`` makes of a set, by its first ``bits``.

    Rows with a page are parts of bit sets, one for each step: a bit for the first ``slots`` bits
    of a hash that more sets have.  The others are the hashes of more than ``listed`` sets.
    """
    shift = np.uint64(64 - bits)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _texts(batches, []):
            sigs = [sig >> shift for s in shingle_sets([r[-1] for r in part]) for sig in of(s)]
            sig = np.sort(np.concatenate(sigs)) if sigs else np.zeros(0, np.uint64)
            rows = [(b, _press([sig[at]])) for b, at in _by_bucket(sig, buckets, bits)]
            yield pd.DataFrame(rows, columns=["bucket", "packed"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _buckets(batches):
            sig = np.concatenate([_unpress(p, ["<u8"])[0] for p in held])
            sig.sort()
            start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            n = np.diff(np.append(start, len(sig)))
            if listed is not None:
                hot = n > listed
                yield pd.DataFrame({"sig": sig[start][hot].astype(np.int64), "n": n[hot], "page": -1, "bits": b""})
            for level, least in enumerate(steps):
                at = sig[start][n > least] >> np.uint64(bits - slots)
                pages = at >> np.uint64(15)
                cuts = np.flatnonzero(np.append(True, pages[1:] != pages[:-1])) if len(at) else []
                found = []
                for low, high in zip(cuts, [*cuts[1:], len(at)]):
                    page = np.zeros(1 << 15, dtype=np.uint8)
                    page[at[low:high] & np.uint64(0x7FFF)] = 1
                    found.append((0, level, int(pages[low]), np.packbits(page, bitorder="little").tobytes()))
                yield pd.DataFrame(found, columns=["sig", "n", "page", "bits"])

    dealt = texts.mapInPandas(send, PACKED).repartition(buckets, "bucket")
    return written(
        dealt.sortWithinPartitions("bucket").mapInPandas(count, "sig bigint, n bigint, page bigint, bits binary"),
        "jaccard-hot",
    )


def _bit_sets(counted: DataFrame, steps: tuple[int, ...], slots: int) -> list[np.ndarray]:
    """The bit sets of ``_counted``.

    What is not in one is of no more sets than its step; if it fills up, more hashes count as
    common, and nothing is lost.
    """
    sets = [np.zeros(1 << max(slots - 3, 12), dtype=np.uint8) for _ in steps]
    for row in counted.where("page >= 0").select("n", "page", "bits").toLocalIterator():  # bounded, as in ``_marks``
        sets[row["n"]][row["page"] * 4096 : row["page"] * 4096 + 4096] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return sets


def _hot_signatures(texts: DataFrame, buckets: int, bits: int, slots: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hot ones, bit sets of those of several sets and of more than ``RARE``).

    Hot are the first ``bits`` of signatures of more than ``HOT`` sets, at most ``MOST_HOT``.
    """
    counted = _counted(texts, _signatures_of, (1, RARE), HOT, buckets, bits, slots)
    sets = _bit_sets(counted, (1, RARE), slots)
    counted = counted.where("page < 0")
    least = HOT  # raised until the list is bounded; sets then index costlier segments
    while counted.where(F.col("n") > least).count() > MOST_HOT:
        least *= 2
    rows = counted.where(F.col("n") > least).select("sig").toPandas()
    return np.sort(rows["sig"].to_numpy(dtype=np.int64).astype(np.uint64)), sets


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _rarest(sig: np.ndarray, number: int, slots: int, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first ``number`` of ``sig``, rarest first, but for those that no other set has.

    With each, how many of ``sig`` come before it, those of no other set among them.
    """
    at = sig >> np.uint64(64 - slots)
    repeated = _has(sets[0], at)
    alone = len(sig) - int(repeated.sum())
    number -= alone
    sig, at = sig[repeated], at[repeated]
    level = np.zeros(len(sig), dtype=np.uint8)
    for common in sets[1:]:
        level += _has(common, at)
    chosen = sig[np.lexsort((sig, level))[: max(0, number)]]
    return chosen, np.arange(alone, alone + len(chosen), dtype=np.uint32)


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """The strings of one bucket after the other, from sorted rows."""
    now, held = None, []
    for batch in batches:
        for bucket, packed in zip(batch["bucket"].tolist(), batch["packed"]):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(packed)
    if held:
        yield held


def _known(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values


def _chosen(texts: DataFrame, shared: Broadcast, hot_bits: int, slots: int, buckets: int, bits: int) -> DataFrame:
    """Chosen signatures, their first ``bits``, packed by bucket.

    ``shared`` is what ``_hot_signatures`` gives.  Sets with too few cheap ones are listed apart,
    in buckets from -1 down.
    """
    shift, rest = np.uint64(64 - hot_bits), np.uint64(64 - bits)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, repeated = shared.value
        for part in _texts(batches, []):
            sigs, befores, refs, homes, names, sizes, short = [], [], [], [], [], [], []
            for s in shingle_sets([r[-1] for r in part]):
                if not len(s):
                    continue
                k, few = len(names), False
                names.append(set_name(s))
                sizes.append(len(s))
                for band, home, sig, differ in _index(s):
                    before = np.zeros(len(sig), dtype=np.uint32)
                    if band >= 0:
                        sig = sig[~_known(sig >> shift, hot)]
                        few = few or len(sig) <= differ
                        sig, before = _rarest(sig, differ + 1, slots, repeated)
                    sigs.append(sig)
                    befores.append(before)
                    refs.append(np.full(len(sig), k, dtype=np.int32))
                    homes.append(np.full(len(sig), home, dtype=np.uint8))
                if few:
                    short.append(k)
            rows = []
            names = np.array(names, dtype=np.int64)
            sizes = np.array(sizes, dtype=np.int64)
            if short:
                listed = np.sort(names[short])
                dealt = listed.view(np.uint64) % np.uint64(buckets)
                for b in np.unique(dealt):
                    rows.append((-1 - int(b), _press([listed[dealt == b]])))
            if sigs:
                sig, before, ref, home = map(np.concatenate, (sigs, befores, refs, homes))
                sig = sig >> rest
                order = np.argsort(sig)
                sig, before, ref, home = sig[order], before[order], ref[order], home[order]
                for b, at in _by_bucket(sig, buckets, bits):
                    used, index = np.unique(ref[at], return_inverse=True)
                    columns = [sig[at], index.astype("<u4"), home[at], names[used], sizes[used], before[at]]
                    rows.append((b, _press(columns)))
            yield pd.DataFrame(rows, columns=["bucket", "packed"])

    return texts.mapInPandas(send, PACKED)


MEMBERS = "grp bigint, class bigint, n bigint, home boolean, rank int, before int"


def _groups(held: list[bytes]) -> pd.DataFrame:
    """Groups of sets that share a signature in a bucket; equal groups are one.

    ``before`` is the number of signatures that come before the group's in a set's order, the
    least of equal groups.  Sets that first meet in the group share none of these segments, so
    they differ in as many shingles at least.
    """
    kinds = ["<u8", "<u4", "u1", "<i8", "<i8", "<u4"]
    parts = [_unpress(p, kinds) for p in held]
    sig = np.concatenate([p[0] for p in parts])
    name = np.concatenate([p[3][p[1]] for p in parts])
    size = np.concatenate([p[4][p[1]] for p in parts])
    home = np.concatenate([p[2] for p in parts])
    before = np.concatenate([p[5] for p in parts])
    order = np.argsort(sig, kind="stable")
    sig, name, size, home, before = sig[order], name[order], size[order], home[order], before[order]
    same = np.append(sig[1:] == sig[:-1], False)
    many = same | np.append(False, same[:-1])
    sig, name, size, home, before = sig[many], name[many], size[many], home[many], before[many]
    if not len(sig):
        return pd.DataFrame({"grp": [], "class": [], "n": [], "home": [], "rank": [], "before": []})
    order = np.lexsort((before, home, name, sig))
    sig, name, size, home, before = sig[order], name[order], size[order], home[order], before[order]
    once = np.append(True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]) | (home[1:] != home[:-1]))
    sig, name, size, home, before = sig[once], name[once], size[once], home[once], before[once]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    length = np.diff(np.append(start, len(sig)))
    # A group's name is a hash of its members, so equal groups of other signatures fall together.
    each = mix(name.view(np.uint64) + home * _SALT)
    named = np.repeat(mix(np.add.reduceat(each, start)).view(np.int64), length)
    rows = np.repeat(length > 1, length)
    grp, name, size, home, before = named[rows], name[rows], size[rows], home[rows], before[rows]
    order = np.lexsort((before, home, name, grp))
    grp, name, size, home, before = grp[order], name[order], size[order], home[order], before[order]
    keep = np.append(True, (grp[1:] != grp[:-1]) | (name[1:] != name[:-1]) | (home[1:] != home[:-1]))[: len(grp)]
    return pd.DataFrame(
        {
            "grp": grp[keep],
            "class": name[keep],
            "n": size[keep],
            "home": home[keep].astype(bool),
            "rank": np.int32(1),
            "before": before[keep].astype(np.int32),
        }
    )


def candidate_groups(texts: DataFrame, size: int) -> DataFrame:
    """Members of groups in which all linked sets meet: columns as in ``MEMBERS``, and their place.

    ``place`` counts the members of a group from 1, the most central one first.
    """
    buckets = max(1, min(size // BUCKET_BYTES, 20_000))
    hot_bits, bits = _bits(size, 6), _bits(size, 16)
    slots = min(MOST_SLOTS, max(15, (size // 8).bit_length() + 3))
    shared = texts.sparkSession.sparkContext.broadcast(_hot_signatures(texts, buckets, hot_bits, slots))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def listed() -> Iterator[pd.DataFrame]:
            for batch in batches:
                apart = batch["bucket"].to_numpy() < 0
                for packed in batch["packed"][apart]:
                    short.append(_unpress(packed, ["<i8"])[0])
                yield batch[~apart]

        # The names of this task's share: buckets hold them by their hash.
        short: list[np.ndarray] = []
        for held in _buckets(listed()):
            yield _groups(held)
        for names in short:
            yield pd.DataFrame({"grp": 0, "class": names, "n": 0, "home": True, "rank": 0, "before": 0})

    met = written(
        _chosen(texts, shared, hot_bits, slots, buckets, bits)
        .repartition(buckets + 1, "bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(meet, MEMBERS),
        "jaccard-groups",
    )
    shared.destroy()
    short = written(met.where("n = 0").select("class").distinct(), "jaccard-short")
    central = (~F.col("home"), F.col("rank"), F.col("before"), F.xxhash64("class"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(*central))
    groups = met.where("n > 0").groupBy("grp", "class", "n", "home", "rank").agg(F.min("before").alias("before"))
    if short.isEmpty():
        return written(groups.withColumn("place", place), "jaccard-members")
    both = groups.unionByName(_by_shingles(texts, short))
    return written(both.withColumn("place", place), "jaccard-members")


def _by_shingles(texts: DataFrame, short: DataFrame) -> DataFrame:
    """Groups of short sets by single shingles, the rarest of each set.

    ``rank`` is the shingle's place among its set's, rarest first.  The first shingle that two
    sets share comes after all that they do not, so it bounds what they share: see ``_pairs``.
    Any one order of all shingles will do for that; bit sets tell how rare they are.
    """
    held = _texts_of(texts, short, "jaccard-short-texts")
    size = 8 * (held.agg(F.sum("n")).head()[0] or 0)
    buckets, bits = max(1, min(size // BUCKET_BYTES, 20_000)), _bits(size, 6)
    slots = min(MOST_SLOTS - 1, max(15, (size // 8).bit_length() + 3))
    held = held.select("text")
    counted = _counted(held, lambda s: [s], STEPS, None, buckets, bits, slots)
    shared = texts.sparkSession.sparkContext.broadcast(_bit_sets(counted, STEPS, slots))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _texts(batches, []):
            sets = [s for s in shingle_sets([r[-1] for r in part]) if len(s)]
            if not sets:
                continue
            # Sets link only if they share three quarters of either's shingles.
            chosen = [_rarest(s, len(s) // 4 + 1, slots, shared.value) for s in sets]
            number = [len(c) for c, _ in chosen]
            yield pd.DataFrame(
                {
                    "class": np.repeat(np.array([set_name(s) for s in sets], dtype=np.int64), number),
                    "n": np.repeat(np.array([len(s) for s in sets], dtype=np.int64), number),
                    "grp": np.concatenate([c for c, _ in chosen]).view(np.int64),
                    "rank": np.concatenate([before for _, before in chosen]).astype(np.int32) + 1,
                }
            )

    ranked = written(
        held.mapInPandas(explode, "class bigint, n bigint, grp bigint, rank int").distinct(), "jaccard-ranked"
    )
    shared.destroy()
    # A partner has the group's smallest size or more, and three quarters of the set's own.
    least = ranked.groupBy("grp").agg(F.min("n").alias("least"), F.count("*").alias("sets"))
    partner = F.greatest("least", F.ceil(F.col("n") * SIMILAR / OF))
    shared_most = F.col("n") - F.col("rank") + 1
    return (
        ranked.join(least.where("sets > 1"), "grp")
        .where((SIMILAR + OF) * shared_most >= SIMILAR * (F.col("n") + partner))
        .select("grp", "class", "n", F.lit(True).alias("home"), "rank", F.lit(0).alias("before"))
    )


def _marks(classes: DataFrame) -> np.ndarray:
    """A bit set in which two bits of each class are set, of at most ``MOST_MARKS`` bits."""
    size = min(MOST_MARKS, 1 << max(15, (16 * classes.count()).bit_length()))
    last = F.lit(size - 1)
    places = F.array(F.col("class").bitwiseAND(last), F.shiftrightunsigned("class", 32).bitwiseAND(last))
    at = classes.select(F.explode(places).alias("at"))
    page = F.shiftright("at", 15).alias("page")
    made = at.groupBy(page).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(0x7FFF)).alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for row in made.toLocalIterator():  # at most MOST_MARKS / 32,768 pages of 4 kB
        out[row["page"] * 4096 : row["page"] * 4096 + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _marked(names: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of ``names`` may be among the classes that set ``marks``."""
    last = np.uint64(8 * len(marks) - 1)
    names = names.view(np.uint64)
    found = np.ones(len(names), dtype=bool)
    for at in (names & last, (names >> _HIGH) & last):
        found &= (marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _texts_of(texts: DataFrame, classes: DataFrame, called: str) -> DataFrame:
    """The given classes, and few others, written: class, n, bits, text.

    A bounded bit set, sent to all tasks, tells which texts are needed, so none is shuffled.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_marks(classes))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _texts(batches, []):
            sets = shingle_sets([r[-1] for r in part])
            names = np.array([set_name(s) if len(s) else 0 for s in sets], dtype=np.int64)
            kept = np.flatnonzero(_marked(names, shared.value))
            if not len(kept):
                continue
            yield pd.DataFrame(
                {
                    "class": names[kept],
                    "n": [len(sets[k]) for k in kept],
                    "bits": [bitmap(sets[k]) for k in kept],
                    "text": [part[k][-1].decode("utf-8", "surrogatepass") for k in kept],
                }
            )

    kept = texts.mapInPandas(name, "class bigint, n bigint, bits binary, text string").where("n > 0")
    out = written(kept, called)
    shared.destroy()
    return out


def _needed(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those classes that ``pairs`` name, so that the joins shuffle no others."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    return bloom.split(held, written(ends, "jaccard-ends"), ["class"])[0]


def _likely(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that may link by their bitmaps."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["n_a"].tolist(), batch["n_b"].tolist(), batch["bits_a"], batch["bits_b"])
            ok = [least_difference(x, y) <= most_difference(n, m) for n, m, x, y in rows]
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]]

    side = lambda c: held.select(
        F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")
    )
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInPandas(check, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"])
            coded = ((a, b, _encoded(x), _encoded(y)) for a, b, x, y in rows)
            for part in chunks(coded, lambda r: len(r[2]) + len(r[3]), CHUNK_BYTES):
                sets = shingle_sets([t for r in part for t in r[2:]])
                found = []
                for (a, b, _, _), x, y in zip(part, sets[0::2], sets[1::2]):
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if OF * common >= SIMILAR * (len(x) + len(y) - common):
                        found.append((a, b))
                yield pd.DataFrame(found, columns=["a", "b"])

    side = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(check, "a bigint, b bigint")


def _apart(members: DataFrame, names: DataFrame) -> DataFrame:
    """Members with their component so far, of groups with more than one component.

    ``main`` is the component of the group's most central member.
    """
    labelled = members.join(names.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "class"))
    low, high = F.min("component").alias("low"), F.max("component").alias("high")
    ends = labelled.groupBy("grp").agg(low, high, F.min_by("component", "place").alias("main"))
    return labelled.join(ends.where("low <> high").select("grp", "main"), "grp")


def _pairs(apart: DataFrame, pivots: int | None) -> DataFrame:
    """Pairs (a, b) of members that are still apart: with pivots up to this place, or all."""
    columns = ("class", "n", "home", "rank", "before", "place", "component")
    once = F.col("place") > F.col("_place")
    if pivots is None:
        # Of two that are apart one is outside the main component.
        first = apart.where("component <> main")
        once = once | (F.col("component") == F.col("main"))
    else:
        first = apart.where(F.col("place") <= pivots)
    first = first.select("grp", *[F.col(c).alias(f"_{c}") for c in columns])
    low, high = F.least("n", "_n"), F.greatest("n", "_n")
    # What two sets may share from the shingle of this group on, if they share none before it.
    shared = F.least(F.col("n") - F.col("rank"), F.col("_n") - F.col("_rank")) + 1
    # As much at most is in both of two sets that differ in what comes before their signature.
    twice = F.col("n") + F.col("_n") - F.greatest("before", "_before")
    fits = (
        ((SIMILAR + OF) * shared >= SIMILAR * (F.col("n") + F.col("_n")))
        & ((SIMILAR + OF) * twice >= 2 * SIMILAR * (F.col("n") + F.col("_n")))
        & (F.col("component") != F.col("_component"))
        & (F.col("home") | F.col("_home"))
        & (OF * low >= SIMILAR * high)
        & once
    )
    return (
        apart.join(first, "grp")
        .where(fits)
        .select(F.least("class", "_class").alias("a"), F.greatest("class", "_class").alias("b"))
        .distinct()
    )


def link_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(``SETS`` of all documents, (node, component) of linked classes or None)."""
    batch_bytes(docs.sparkSession)
    sets = written(describe_sets(docs), "jaccard-sets")
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    texts = _representatives(docs, sets)
    members = candidate_groups(texts, size)
    wanted = written(members.select("class").distinct(), "jaccard-wanted")
    if wanted.isEmpty():
        return sets, None
    held = _texts_of(texts, wanted, "jaccard-candidates")
    columns = ("grp", "class", "n", "home", "rank", "before", "place")
    names, tested, done = None, None, 0
    for pivots in [*PIVOTS, None]:
        if names is None:
            members = members.withColumn("component", F.col("class"))
        else:
            # Pivots of earlier rounds have met all of their groups.
            left = members.where(F.col("place") > done).select(*columns)
            members = written(_apart(left, names), "jaccard-apart")
        if members.isEmpty():
            break
        done += pivots or 0
        pairs = _pairs(members, pivots and done)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "jaccard-pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        likely = written(_likely(pairs, _needed(held, pairs)), "jaccard-likely")
        found = written(_verified(likely, _needed(held, likely)), "jaccard-links")
        names = components(found) if names is None else _joined(names, found)
    return sets, names


def _joined(names: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` that join components of ``names`` or new nodes."""
    if links.isEmpty():
        return names
    of = lambda c: names.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    step = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    further = step.select(F.col("node").alias("component"), F.col("component").alias("_further"))
    moved = names.join(further, "component", "left").select(
        "node", F.coalesce("_further", "component").alias("component")
    )
    return written(moved.unionByName(step.join(names.select("node"), "node", "left_anti")), "jaccard-names")


def _labelled(docs: DataFrame) -> DataFrame:
    """doc, text_key, n, class and component of each document."""
    sets, names = link_sets(docs)
    if names is None:
        return sets.withColumn("component", F.col("class"))
    given = sets.join(names.withColumnRenamed("node", "class"), "class", "left")
    return given.withColumn("component", F.coalesce("component", "class"))


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    kind = docs.schema["doc_id"].dataType
    given = _labelled(docs).select(
        F.col("doc").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), "n", "component"
    )
    smallest = (
        given.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    )
    linked = given.where("n > 0").join(smallest, "component")
    alone = given.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return linked.select(*columns).unionByName(alone.select(*columns))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id.

    Documents are told apart by id and text: a text goes if it has a copy elsewhere, whatever
    other texts its id names.  Null ids come last.  Of one id's texts in one group that with
    the smallest hash stays, of repeated rows (same id, same text) the one with the smallest
    other columns.  Documents without words all stay.
    """
    kind = docs.schema["doc_id"].dataType
    # One row for each id and text with words, so that no join meets a whole group.
    found = written(
        _labelled(docs)
        .where("n > 0")
        .groupBy("doc", "text_key")
        .agg(F.min("component").alias("component"), F.count("*").alias("copies")),
        "jaccard-found",
    )
    order = F.struct(F.col("doc").isNull(), F.col("doc").cast(kind), "text_key")
    member = F.struct("doc", "text_key", "copies")
    first = found.groupBy("component").agg(F.min_by(member, order).alias("f")).select("f.*")
    first = written(first, "jaccard-first")
    on = ["_doc", "_text_key"]
    names = (F.col("doc").alias("_doc"), F.col("text_key").alias("_text_key"))
    given = found.select(*names, "copies")
    stay = first.select(*names)
    pair = F.struct(*on).alias("_pair")  # finds null ids too
    gone = given.withColumn("_pair", F.struct(*on)).join(stay.select(pair), "_pair", "left_anti")
    gone = written(gone.select(*on), "jaccard-gone")
    again = written(first.where("copies > 1").select(*names), "jaccard-again")

    def of(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        """Rows with, or without, an id and text of ``named``; the others stay in place."""
        maybe, never = bloom.split(rows, named, on)
        met = maybe.withColumn("_pair", F.struct(*on)).join(named.select(pair), "_pair", how).select(*rows.columns)
        return met if how == "left_semi" else never.unionByName(met)

    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("_doc", F.col("doc_id").cast("string")).withColumn("_text_key", text_key)
    left = of(keyed, gone, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    one = (
        of(left, again, "left_semi")
        .groupBy("_doc", "_text_key")
        .agg(F.min(F.struct(*docs.columns)).alias("r"))
        .select("r.*")
    )
    return of(left, again, "left_anti").select(*docs.columns).unionByName(one)
