"""Connected components of a link table, by alternating large and small stars.

Each round is two grouped minima and two equi joins; the minima are written out before the join so that both of its
sides are plain exchanges, which adaptive execution can split when a hub holds many links. Rounds are logarithmic in
the length of the longest chain. Nothing is collected but one count and one checksum a round; the end is decided by
comparing whole tables, not by the checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators.scratch import Scratch


def _minima(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.table(pairs.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m")), "minima")


def connected_components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, label): label is the smallest node reachable. Nodes without a link to another node have no row; null
    ends, self links and repeated links change nothing; an empty table gives an empty one."""
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before, seen = scratch.table(e, "links"), None, None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 30)).alias("h")).first()
        same = (mark.n, mark.h) == seen and not e.join(before, ["u", "v"], "left_anti").limit(1).count()
        if before is not None:
            scratch.drop(before)
        if same or not mark.n:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen, before = (mark.n, mark.h), e
        # large star: each node hands its larger neighbours to the smallest node it knows
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = _minima(both, scratch)
        large = scratch.table(both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        scratch.drop(low)
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        down = large.select(F.col("u").alias("x"), F.col("v").alias("y"))
        low = _minima(down, scratch)
        e = scratch.table(
            down.join(low, "x").where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(),
            "small",
        )
        scratch.drop(low, large)
