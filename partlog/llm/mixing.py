"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) with their tokens.  The cells'
token weights are raked: each sweep scales them to the target of every source, then of
every language, then of every topic, and no cell may exceed the tokens that it has.  Sweeps
stop when no marginal is off by more than a tolerance.  A document of a cell is then kept
with probability weight / tokens of its cell, so that the expected tokens of each marginal
meet its target.  The draw is a hash of id, text and seed: the same documents are kept at
any number of tasks.

Targets default to tempered shares: a marginal's share of all tokens to the power
``temper``, scaled to one; ``targets`` may name other shares for a column.  The budget is
the share of all tokens to keep.

``mix`` reads the texts twice, to count and to draw; a caller that needs no text can write
what ``describe`` finds and go on with ``mix_described``.  All else happens on the cells.
The sweeps use aggregates and joins, so there may be any number of sources.

Defined results: a null text has no tokens; null source, language or topic is a value of
its own; cells without tokens are kept whole, as they weigh nothing; repeated rows share
one draw; an empty table gives no rows.  ``mix`` replaces columns named like those it adds;
``drawn`` keeps all columns as they are.  A value that the ``targets`` of its column do not
name has a target of nothing, and its documents go.  Targets that no weights can meet, also
because a cell has too few tokens, are met as far as the sweeps come: ``margin_errors`` says
how far each one is off.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import SPACES, written
from partlog.plans.bounds import BROADCAST_ROWS, at_most

MARGINS = ("source", "lang", "topic")
TEMPER = 0.95
BUDGET = 0.75
TOLERANCE = 1e-3
SWEEPS = 20
SEED = 20_240


def count_tokens(text: Column) -> Column:
    """Runs of bytes that are not ASCII white space."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    gaps = F.octet_length(words) - F.octet_length(F.translate(words, " ", ""))
    return F.when(words == "", 0).otherwise(gaps + 1).cast("bigint")


def topic_of(text: Column) -> Column:
    """A coarse topic from what the text is made of, for tables that have none."""
    text = F.coalesce(text, F.lit(""))
    size = F.octet_length(text)
    digits = size - F.octet_length(F.translate(text, "0123456789", ""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(digits * 50 > size, "data")
        .when(F.contains(text, F.lit("icensed under")), "licensed")
        .when(size < 1000, "note")
        .otherwise("prose")
    )


def _targets(cells: DataFrame, margin: str, given: Mapping | None, temper: float) -> DataFrame:
    """(margin, share of the budget), summing to one."""
    shares = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
    if given is not None:
        spark = cells.sparkSession
        kind = cells.schema[margin].dataType.simpleString()
        wanted = spark.createDataFrame(list(given.items()), f"_key {kind}, want double")
        shares = shares.join(F.broadcast(wanted), F.col(margin).eqNullSafe(F.col("_key")))
        shares = shares.select(margin, "want")
    else:
        shares = shares.select(margin, F.pow("t", F.lit(temper)).alias("want"))
    total = shares.agg(F.sum("want")).head()[0] or 1.0
    return shares.select(margin, (F.col("want") / F.lit(total)).alias("share"))


def rake(
    cells: DataFrame,
    budget: float = BUDGET,
    targets: Mapping[str, Mapping] | None = None,
    temper: float = TEMPER,
    tolerance: float = TOLERANCE,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, the raked tokens."""
    targets = targets or {}
    goal = float(cells.agg(F.sum("tokens")).head()[0] or 0) * budget
    wanted = {
        m: written(
            _targets(cells, m, targets.get(m), temper).select(
                F.col(m).alias("key"), (F.col("share") * F.lit(goal)).alias("want")
            ),
            "mix-target",
        )
        for m in MARGINS
    }
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens") * F.lit(budget))
    now = written(now, "mix-cells")
    if at_most(now, BROADCAST_ROWS):  # so few that a sweep is one task without exchanges
        narrow = lambda df: df.coalesce(1)
    else:
        narrow = lambda df: df
    wanted = {m: narrow(df) for m, df in wanted.items()}
    now = narrow(now)
    for _ in range(sweeps):
        for m in MARGINS:  # one sweep between writes: longer plans fill the driver
            sums = now.groupBy(m).agg(F.sum("weight").alias("have"))
            scale = sums.join(wanted[m], sums[m].eqNullSafe(wanted[m]["key"])).select(
                sums[m].alias("key"), (F.col("want") / F.col("have")).alias("factor")
            )
            scaled = now.join(scale, now[m].eqNullSafe(scale["key"]), "left").drop("key")
            weight = F.col("weight") * F.coalesce("factor", F.lit(0.0))
            now = scaled.withColumn("weight", F.least(weight, F.col("tokens").cast("double")))
            now = now.select(*MARGINS, "tokens", "weight")
        now = narrow(written(now, "mix-sweep"))
        if _largest_error(now, wanted) <= tolerance:
            break
    return now


def margin_errors(
    cells: DataFrame,
    raked: DataFrame,
    budget: float = BUDGET,
    targets: Mapping[str, Mapping] | None = None,
    temper: float = TEMPER,
) -> DataFrame:
    """(margin, value, want, have, off): how far the weights of ``rake`` are from each target."""
    goal = float(cells.agg(F.sum("tokens")).head()[0] or 0) * budget
    out = None
    for m in MARGINS:
        wanted = _targets(cells, m, (targets or {}).get(m), temper)
        wanted = wanted.select(F.col(m).alias("_key"), (F.col("share") * F.lit(goal)).alias("want"))
        sums = raked.groupBy(m).agg(F.sum("weight").alias("have"))
        both = sums.join(wanted, sums[m].eqNullSafe(wanted["_key"]), "full_outer")
        want, have = (F.coalesce(c, F.lit(0.0)) for c in ("want", "have"))
        value = F.coalesce(F.col(m), F.col("_key")).cast("string").alias("value")
        off = F.try_divide(F.abs(have - want), want).alias("off")
        part = both.select(F.lit(m).alias("margin"), value, want.alias("want"), have.alias("have"), off)
        out = part if out is None else out.unionByName(part)
    return out


def _largest_error(cells: DataFrame, wanted: Mapping[str, DataFrame]) -> float:
    """Largest relative distance of a marginal from its target."""
    errors = None
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("weight").alias("have"))
        off = sums.join(wanted[m], sums[m].eqNullSafe(wanted[m]["key"])).select(
            F.abs(F.col("have") / F.col("want") - 1).alias("off")
        )
        errors = off if errors is None else errors.unionByName(off)
    return errors.agg(F.max("off")).head()[0] or 0.0


def describe(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with n_tokens, topic (if there is none) and ``draw``, a number from 0 to 1."""
    if "topic" not in docs.columns:
        docs = docs.withColumn("topic", topic_of(F.col("text")))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 53)) / F.lit(1 << 53)
    return docs.withColumns({"n_tokens": count_tokens(F.col("text")), "draw": draw})


def mix_described(
    docs: DataFrame,
    budget: float = BUDGET,
    targets: Mapping[str, Mapping] | None = None,
    temper: float = TEMPER,
) -> DataFrame:
    """Rows of ``describe`` with weight, probability and ``kept`` (the draw)."""
    cells = written(docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mix-count")
    raked = rake(cells, budget, targets, temper)
    rates = raked.select(
        *[F.col(m).alias(f"_{m}") for m in MARGINS],
        "weight",
        (F.col("weight") / F.col("tokens")).alias("probability"),
    )
    if at_most(rates, BROADCAST_ROWS):
        rates = F.broadcast(rates)
    given = [c for c in docs.columns if c not in ("weight", "probability", "kept")]
    docs = docs.select(*given)
    same = [docs[m].eqNullSafe(rates[f"_{m}"]) for m in MARGINS]
    chance = F.coalesce("probability", F.lit(1.0))
    return docs.join(rates, same[0] & same[1] & same[2], "left").select(
        *given,
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        chance.alias("probability"),
        (F.col("draw") < chance).alias("kept"),
    )


def mix(
    docs: DataFrame,
    budget: float = BUDGET,
    targets: Mapping[str, Mapping] | None = None,
    temper: float = TEMPER,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with n_tokens, topic, draw, weight, probability and ``kept`` (the draw)."""
    return mix_described(describe(docs, seed), budget, targets, temper)


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``mix`` keeps, with their own columns."""
    needed = [c for c in ("doc_id", "text", *MARGINS) if c in docs.columns]
    packed = docs.select(*needed, F.struct("*").alias("_row"))
    return mix(packed, **options).where("kept").select("_row.*")
