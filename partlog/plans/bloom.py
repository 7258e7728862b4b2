"""Bounded membership filters as tables of bitmaps, so that a join moves few rows in vain.

A filter is pages of 32,768 bits.  An item has one page and ``PROBES`` bits in it; if one of
them is not set, the item is not a member.  With ``BITS`` bits for a member about one other
item in a thousand passes.  A filter never has more than ``MOST_PAGES`` pages (16 MB), so it
may be broadcast; with more members than that, more other items pass, and the exact join that
follows has more to do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog.plans.scratch import cut_lineage

BITS = 16
PAGE = 1 << 15  # bits of a page, as ``bitmap_construct_agg`` makes them
PROBES = 6
MOST_PAGES = 4096


def pages_for(members: Column | int) -> Column | int:
    """Pages of a filter for so many members."""
    if isinstance(members, int):
        return min(max(1, -(-members * BITS // PAGE)), MOST_PAGES)
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(members * BITS / PAGE))


def page_of(pages: Column | int, on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), *on), F.lit(pages) if isinstance(pages, int) else pages)


def probe(k: int, on: Sequence[str]) -> Column:
    """The ``k``-th bit of an item in its page."""
    first, step = F.xxhash64(F.lit(2), *on), F.xxhash64(F.lit(3), *on)
    return F.pmod(F.pmod(first, F.lit(PAGE)) + k * F.pmod(step, F.lit(PAGE // 2)) * 2 + k, F.lit(PAGE))


def probes(on: Sequence[str]) -> Column:
    """One row for each bit of an item."""
    return F.explode(F.array(*[probe(k, on) for k in range(PROBES)]))


def passes(bits: str, on: Sequence[str]) -> Column:
    """Whether all bits of an item are set in its page."""
    hit = F.lit(True)
    for k in range(PROBES):
        at = probe(k, on)
        byte = F.conv(F.hex(F.substr(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at.bitwiseAND(7).cast("int") + 1)
        hit = hit & (byte.bitwiseAND(mask) != 0)
    return hit


def split(df: DataFrame, members: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have the values of ``members`` in ``on``, rows that surely have not).

    ``members`` should be written, as it is read for its count and for the filter.
    """
    pages = pages_for(members.count())
    page = page_of(pages, on)
    made = members.select(page.alias("_page"), probes(on).alias("_bit")).groupBy("_page")
    made = cut_lineage(made.agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    marked = df.withColumn("_page", page).join(F.broadcast(made), "_page", "left")
    here = F.col("_bits").isNotNull() & passes("_bits", on)
    marked = marked.withColumn("_here", F.coalesce(here, F.lit(False)))
    of = lambda which: marked.where(which).select(*df.columns)
    return of(F.col("_here")), of(~F.col("_here"))


def semi_join(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with the values of a row of ``members``; the shuffle moves few others."""
    return split(df, members, on)[0].join(members.select(*on).distinct(), list(on), "left_semi")
