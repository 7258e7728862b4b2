"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import written
from partlog.plans.bounds import BROADCAST_ROWS, at_most

JUMPS = 3


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` can reach.

    Each round, a node joins its smallest neighbour, if that is smaller; a few jumps along
    these choices follow, and links then connect what is left.  The smallest node of a
    component never joins another, so it gives the name.  The number of links falls from
    round to round, all steps are aggregates and joins, and each round is written to the
    shared folder.  Nodes without a link to another do not appear.  Links of a counted small
    number are one partition from the start, which needs no exchange; the rows are the same.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    left = written(
        ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(),
        "links",
    )
    few = at_most(left, BROADCAST_ROWS)
    packed = lambda df: df.coalesce(1) if few else df
    left = packed(left)
    names: DataFrame | None = None
    while not left.isEmpty():
        both = packed(left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y"))))
        joined = both.groupBy("x").agg(F.min("y").alias("y"))
        joins = joined.select(
            F.col("x").alias("node"), F.least("x", "y").alias("component")
        )
        for _ in range(JUMPS):
            next_ = joins.select(
                F.col("node").alias("component"), F.col("component").alias("_further")
            )
            joins = joins.join(next_, "component", "left").select(
                "node", F.coalesce("_further", "component").alias("component")
            )
        joins = packed(written(joins, "joins"))
        of_x = joins.select(F.col("node").alias("x"), F.col("component").alias("cx"))
        of_y = joins.select(F.col("node").alias("y"), F.col("component").alias("cy"))
        met = left.join(of_x, "x").join(of_y, "y").where("cx <> cy")
        left = written(
            met.select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).distinct(),
            "links",
        )
        left = packed(left)
        if names is None:
            names = joins
        else:
            step = joins.select(
                F.col("node").alias("component"), F.col("component").alias("_further")
            )
            names = names.join(step, "component", "left").select(
                "node", F.coalesce("_further", "component").alias("component")
            )
            names = packed(written(names, "names"))
    if names is None:
        return left.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return names
