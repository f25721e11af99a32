"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table


def _least(both: DataFrame) -> Table:
    """both: (u, v), v a neighbour of u -> (u, m), the least of u and its
    neighbours. Minima combine before the shuffle, so no neighbourhood is
    collected; they are written, so that the join with the edges stands on two
    exchanges and the edges of a node with very many may be split."""
    return Table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v), any orientation, repeats and loops allowed. Returns
    (node, component), component the least node reachable; nodes without edges
    are not listed. Each round is written to the shared folder; rounds grow
    with the logarithm of the longest chain."""
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    apart = F.col("u") != F.col("v")
    now = Table(edges.filter(apart).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    mark = None
    while True:
        e = now.df
        sign = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == mark or sign[0] == 0:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = sign
        # large star: neighbours above u go to the least of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.join(least.df, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(apart)
        down = Table(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "down")
        for old in (least, now):
            old.drop()
        # small star: u and its neighbours, all below it, go to the least of them
        least = _least(down.df)
        small = down.df.join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.df.select("u", F.col("m").alias("v")))
        now = Table(small.filter(apart).distinct(), "edges")
        for old in (least, down):
            old.drop()
