"""Sharding by balanced label propagation.

Documents with one text form a group; an edge joins any two of a group.  A shard is a
label, and each shard has an exact quota, so that the numbers of documents in two shards
differ by at most one.  Labels start at random.  Documents without partners have no edges:
they yield all their room and get labels last.

Propagation.  In each round a document takes the label that most of its neighbours have among
those with room, if more of them have it than have its own, as far as that shard's quota
goes.  Neighbours are counted by group and label, so a round is a few aggregates and joins
over those counts, whatever the number of edges.  Every move goes to a larger part of its
group, so cut edges fall from round to round; rounds end when nothing moves or after
``ROUNDS``.

Settling.  What the rounds leave is made to fit the quotas exactly:

1. Large groups, of more than a ``LARGE``-th of a shard, go first, since cut edges grow with
   the square of a group.  There are at most about ``LARGE`` times as many as shards, so the
   driver places them by their counts, the largest first: whole into the fullest shard that
   can take it, or else filling shards one after the other.
2. Every other group takes the label that most of its documents have by now, as far as that
   shard's room goes.  Groups that find no room are laid along the room that is left in all
   shards.  Those across the border of two shards, fewer than shards, are placed as in step 1.
3. Documents without partners are laid along the rest.

All steps are joins, aggregates and window functions over a narrow table (row, group,
shard).  Ranks are taken in pieces: rows are dealt by hash into pieces, a small table holds
the running totals of the pieces, and windows never cover more than one piece.  Groups are
counted before they meet, so a group with a third of all rows is one row per shard.

Defined results: a null text is an empty one; null or repeated ids are rows of their own;
repeated rows are one group; an empty table gives no rows; further columns are kept out
unless ``keep`` names them.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlog.llm.common import written

SHARDS = 40
LARGE = 8
PIECE_ROWS = 20_000
ROUNDS = 8
RESULT = ("doc_id", "size", "text_crc32", "shard", "slot", "members")


def text_size(text: Column) -> Column:
    """Bytes of the UTF-8 text plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def running_total(
    df: DataFrame, by: list[str], order: list[Column], amount: Column, pieces: int, name: str
) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows before this one.

    ``order[0]`` must be a non-negative number below ``pieces``, the piece, by which rows
    are ordered first; the rows of one piece are sorted in one task.
    """
    piece = order[0].cast("int")
    df = df.withColumn("_piece", piece).withColumn("_amount", amount.cast("bigint"))
    sums = df.groupBy(*by, "_piece").agg(F.sum("_amount").alias("_sum"))
    of_pieces = Window.partitionBy(*by).orderBy("_piece")
    before = sums.select(
        *by, "_piece", (F.sum("_sum").over(of_pieces) - F.col("_sum")).alias("_before")
    )
    within = Window.partitionBy(*by, "_piece").orderBy(*order[1:])
    inside = F.sum("_amount").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_inside", inside - F.col("_amount"))
        .join(before, [*by, "_piece"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_piece", "_amount", "_inside", "_before")
    )


def cut_edges(placed: DataFrame, group: str) -> DataFrame:
    """One row: ``edges`` between rows with one value of ``group``, ``cut`` between shards."""
    parts = placed.groupBy(group, "shard").agg(F.count("*").alias("n"))
    whole = parts.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("near"))
    edges, cut = F.col("n") * (F.col("n") - 1) / 2, (F.col("n") * F.col("n") - F.col("near")) / 2
    total = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return whole.agg(total(edges).alias("edges"), total(cut).alias("cut"))


def _cut(counts: DataFrame) -> int:
    """Edges between documents of one group with different labels, from ``counts``."""
    parts = counts.groupBy("grp").agg(F.sum("here").alias("n"), F.sum(F.col("here") * F.col("here")).alias("near"))
    return int(parts.agg(F.sum((F.col("n") * F.col("n") - F.col("near")) / 2)).head()[0] or 0)


def propagate(counts: DataFrame, quotas: list[int], pieces: int, rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(``counts`` after the rounds, cut edges before them and after each one).

    ``counts`` has grp, members, start (a label) and here, the group's documents with it.
    """
    spark = counts.sparkSession
    cuts = [_cut(counts)]
    while len(cuts) <= rounds and cuts[-1]:
        held = {r["start"]: r["n"] for r in counts.groupBy("start").agg(F.sum("here").alias("n")).collect()}
        room = [(label, max(0, q - held.get(label, 0))) for label, q in enumerate(quotas)]
        rooms = F.broadcast(spark.createDataFrame(room, "start int, room bigint"))
        # The larger part of a group counts, and of equal ones that with the smaller label.
        part = F.struct("here", (-F.col("start")).alias("minus"))
        open_ = counts.join(rooms, "start").where("room > 0")
        wanted = open_.groupBy("grp").agg(F.max(part).alias("to"), F.max_by("room", part).alias("room"))
        asks = counts.join(wanted, "grp").where(part < F.col("to"))
        asks = asks.select("grp", "members", "start", "here", (-F.col("to.minus")).cast("int").alias("label"), "room")
        order = [F.pmod(F.xxhash64("grp"), F.lit(pieces)), F.col("grp"), F.col("start")]
        queue = running_total(asks, ["label"], order, F.col("here"), pieces, "ahead")
        moved = F.least(F.col("here"), F.greatest(F.col("room") - F.col("ahead"), F.lit(0)))
        moves = written(queue.withColumn("moved", moved).where("moved > 0"), "shard-moves")
        left = moves.select("grp", "members", "start", (-F.col("moved")).alias("here"))
        come = moves.select("grp", "members", F.col("label").alias("start"), F.col("moved").alias("here"))
        both = counts.select("grp", "members", "start", "here").unionByName(left).unionByName(come)
        new = both.groupBy("grp", "members", "start").agg(F.sum("here").alias("here")).where("here > 0")
        counts = written(new, "shard-counts")
        cuts.append(_cut(counts))
        if cuts[-1] == cuts[-2]:
            break
    return counts, cuts


def _placed(
    groups: list[tuple[str, int]], room: list[int], here: dict[tuple[str, int], int]
) -> list[tuple[str, int, int, int]]:
    """Portions (group, low, high, shard) of ``groups``, by ranks; takes them from ``room``.

    ``here`` counts a group's documents in a shard, which decides between equal rooms.
    """
    queue = [(-members, group, 0) for group, members in groups]
    heapq.heapify(queue)
    portions = []
    while queue:
        left, group, low = heapq.heappop(queue)
        left = -left
        votes = lambda s: here.get((group, s), 0)
        fits = [s for s, r in enumerate(room) if r >= left]
        if fits:
            shard = min(fits, key=lambda s: (room[s], -votes(s), s))
        else:
            shard = max(range(len(room)), key=lambda s: (room[s], votes(s), -s))
        taken = min(left, room[shard])
        room[shard] -= taken
        portions.append((group, low, low + taken, shard))
        if taken < left:
            heapq.heappush(queue, (taken - left, group, low + taken))
    return portions


def _taken(room: list[int], sums: DataFrame) -> list[int]:
    """``room`` less what ``sums`` (shard, taken) holds: one row for each shard."""
    taken = {r["shard"]: r["taken"] for r in sums.collect()}
    return [r - taken.get(s, 0) for s, r in enumerate(room)]


def _along(queue: DataFrame, room: list[int], amount: str) -> DataFrame:
    """``queue``, whose column ``ahead`` counts rows, with the ``shard`` that has room there.

    It is null where ``amount`` rows from there on do not lie in one shard.
    """
    ranges, low = [], 0
    for shard, r in enumerate(room):
        ranges.append((shard, low, low + r))
        low += r
    ends = F.broadcast(queue.sparkSession.createDataFrame(ranges, "shard int, low bigint, high bigint"))
    inside = (F.col("ahead") >= F.col("low")) & (F.col("ahead") < F.col("high"))
    whole = F.col("ahead") + F.col(amount) <= F.col("high")
    return queue.join(ends, inside).withColumn("shard", F.when(whole, F.col("shard"))).drop("low", "high")


def _labelled(state: DataFrame, shards: int, rows: int, pieces: int) -> DataFrame:
    """(row, members, shard) of ``state`` (row, grp, members, start)."""
    spark = state.sparkSession
    room = [rows // shards + (shard < rows % shards) for shard in range(shards)]
    counts = written(
        state.where("members > 1").groupBy("grp", "members", "start").agg(F.count("*").alias("here")),
        "shard-counts",
    )
    counts, _ = propagate(counts, room, pieces)
    large = F.col("members") * LARGE > max(1, rows // shards)
    found = counts.where(large).collect()  # at most 2 * LARGE * shards groups
    here = {(r["grp"], r["start"]): r["here"] for r in found}
    portions = _placed(sorted({(r["grp"], r["members"]) for r in found}), room, here)

    vote = F.max(F.struct("here", (-F.col("start")).alias("minus")))
    votes = counts.where(~large).groupBy("grp", "members").agg(vote.alias("b"))
    votes = votes.select("grp", "members", (-F.col("b.minus")).cast("int").alias("label"))
    scatter = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    queue = running_total(
        votes, ["label"], [scatter("grp", pieces), F.col("grp")], F.col("members"), pieces, "ahead"
    )
    rooms = F.broadcast(spark.createDataFrame(list(enumerate(room)), "label int, room bigint"))
    fits = F.col("ahead") + F.col("members") <= F.col("room")
    asked = queue.join(rooms, "label").select(
        "grp", "members", F.when(fits, F.col("label")).alias("shard")
    )
    asked = written(asked, "shard-asked")
    first = asked.where("shard is not null")
    room = _taken(room, first.groupBy("shard").agg(F.sum("members").alias("taken")))

    spread = shards * pieces
    rest = running_total(
        asked.where("shard is null").drop("shard"),
        [],
        [scatter("grp", spread), F.col("grp")],
        F.col("members"),
        spread,
        "ahead",
    )
    rest = written(_along(rest, room, "members"), "shard-rest")
    second = rest.where("shard is not null")
    room = _taken(room, second.groupBy("shard").agg(F.sum("members").alias("taken")))
    border = rest.where("shard is null").select("grp", "members").collect()  # fewer than shards
    portions += _placed([(r["grp"], r["members"]) for r in border], room, {})

    # Rows of placed groups are ranked; all others of a group go where it goes.
    owned = spark.createDataFrame(portions, "grp string, low bigint, high bigint, shard int")
    order = [F.col("start") * pieces + scatter("row", pieces), F.col("row")]
    ranked = running_total(
        state.join(F.broadcast(owned.select("grp").distinct()), "grp"),
        ["grp"],
        order,
        F.lit(1),
        spread,
        "rank",
    )
    at = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    cut = ranked.join(F.broadcast(owned.withColumnRenamed("grp", "_grp")), (F.col("grp") == F.col("_grp")) & at)
    whole = state.where((F.col("members") > 1) & ~large).join(
        first.unionByName(second.drop("ahead")).select("grp", "shard"), "grp"
    )
    alone = running_total(state.where("members = 1"), [], order, F.lit(1), spread, "ahead")
    alone = _along(alone, room, "members")
    columns = ("row", "members", "shard")
    return cut.select(*columns).unionByName(whole.select(*columns)).unionByName(alone.select(*columns))


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, members (documents with this text), and ``keep``.

    Numbers of documents differ by at most one between shards.  ``slot`` counts a shard's
    documents from 0 without gaps.  Columns of ``keep`` may have any name; one that is named
    like a column of the result comes back as ``given_<name>``.  Steps are written to the
    shared folder as they go.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    held = {f"_keep{n}": c for n, c in enumerate(keep)}
    base = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id"),
            text_size(F.col("text")).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("grp"),
            *[docs[c].alias(name) for name, c in held.items()],
        ),
        "shard-base",
    )
    sizes = base.groupBy("grp").agg(F.count("*").alias("members"))
    rows = base.count()
    pieces = max(1, rows // PIECE_ROWS // 4)
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    state = written(
        base.select("row", "grp").join(sizes, "grp").withColumn("start", start), "shard-start"
    )
    state = written(_labelled(state, shards, rows, pieces), "shard-labels")
    ranked = running_total(
        base.join(state.select("row", "members", "shard"), "row"),
        ["shard"],
        [F.pmod(F.xxhash64("row"), F.lit(pieces)), F.col("doc_id"), F.col("row")],
        F.lit(1),
        pieces,
        "slot",
    )
    named = [F.col(name).alias(f"given_{c}" if c.lower() in RESULT else c) for name, c in held.items()]
    return ranked.select(*RESULT, *named)
