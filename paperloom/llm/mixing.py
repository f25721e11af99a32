"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Whole copies that the target covers are
allocated with certainty. What is left is a sample of fixed size, in words, with
unequal inclusion odds: a document is included with a probability proportional
to its size, p = min(1, scale * size), and the source's scale makes the expected
words the target. Documents with p = 1 are taken first. The others are ranked
by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in
that order up to the target. u is a hash of the id, so reruns agree. One more
document of those not taken is added if its size fits what is still missing
better than nothing does.

Ranks are never computed by a window over a source, which may hold a third of
all rows: a histogram of words by rank finds the bin in which a source reaches
its target, that bin is divided again while it holds many documents, and only
the last bin's documents are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BITS = 10  # a histogram has 2**BITS bins
LEVELS = 5  # and is divided as often at most
EDGE_ROWS = 100_000  # or until a source's last bin holds no more documents


def uniform(key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of a key as text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds target.

    The targets are min(most * source_size, level * weight) with the level at
    which they add up to share * all sizes: the fixed point of resharing the
    excess of capped sources by weight. One row a source is all that is sorted.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(everything) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), index + 1).cast("bigint")
    cap = F.col("source_size") * most
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap)
    # capped first: those with the least room for their weight; ties are equal in effect
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double") * share
    onwards = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")) / onwards
    rows = rows.withColumn("level", level)
    # the first source that its level does not fill sets the level of all after it
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    level_now = F.coalesce(open_level, F.lit(float("inf")))
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), level_now * F.col("weight"))).select("source", "source_size", "target")


def inclusion(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows: (source, size); goal: (source, rest). (source, scale): the p of
    documents is min(1, scale * size), and adds up to rest in words. The largest
    documents are certain as long as their p would be over 1. Sizes are counted
    first, so a source costs a row for each of its different sizes."""
    counted = rows.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("c"))
    whole = lambda x: x.cast("decimal(38,0)")
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words = whole(F.col("size") * F.col("c"))
    certain = (F.sum(words).over(Window.partitionBy("source")) - F.sum(words).over(upto)).cast("double")
    squares = F.sum(whole(F.col("size")) * words).over(upto).cast("double")
    by_size = counted.join(goal.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("scale", (F.col("rest") - certain) / squares)
    return by_size.filter(F.col("scale") * F.col("size") <= 1).groupBy("source").agg(F.max_by("scale", "size").alias("scale"))


def _edges(ranked: DataFrame, edge_rows: int, bits: int = BITS) -> tuple[DataFrame, Column]:
    """(source, edge, below) of the bin in which each source reaches its rest,
    and the bin that a row of ranked belongs to."""
    edges, level = None, 0
    while True:
        level += 1
        bin_ = F.floor(F.col("t") * float(2 ** (bits * level)))
        part, below = ranked, F.lit(0)
        if edges is not None:
            outer = edges.select(F.col("source").alias("_s"), F.col("edge").alias("_edge"), F.col("below").alias("_below"))
            part = ranked.join(outer, F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("t") * float(2 ** (bits * (level - 1)))) == F.col("_edge")))
            below = F.col("_below")
        words = part.groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest"), F.max(below).alias("_under"))
        up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        reach = words.withColumn("below", F.col("_under") + F.coalesce(F.sum("words").over(up), F.lit(0)))
        crossed = reach.filter((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("words") > F.col("rest")))
        edges = Table(crossed.groupBy("source").agg(F.min("bin").alias("edge"), F.min_by("below", "bin").alias("below"), F.min_by("n", "bin").alias("n")), "edges").df
        if level == LEVELS or (edges.agg(F.max("n")).first()[0] or 0) <= edge_rows:
            return edges.drop("n"), bin_


def pareto_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    edge_rows: int = EDGE_ROWS,
    row_col: str | None = None,
) -> DataFrame:
    """One row for each row of docs: id_col, source_col, size, source_size,
    target, copies, taken.

    size is the number of words (null text: 0), of texts of any length. Sources
    are ordered by code point, null last, and weigh 5, 2, 1, repeating. taken =
    copies * size, with copies between 0 and most. Documents without words take
    none. Equal ranks (repeated ids and sizes) are ordered by id, size and row;
    repeated rows count one by one. An empty table gives an empty result, a
    corpus without words targets of 0. Other columns are ignored, whatever their
    names. edge_rows changes time and never the result. row_col names a unique,
    written number of each row, which is then returned as well.
    """
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = Table(rows, "sizes").df
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.least(F.lit(most), F.floor(ratio)).cast("bigint")
    goal = goal.withColumn("sure", sure).withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size"))
    goal = Table(goal, "targets").df
    scales = inclusion(rows, goal).withColumnRenamed("source", "_s")
    goal = Table(goal.join(scales, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "scales").df
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    u = uniform(F.col("doc_id"))
    odds = lambda x: x / (1 - x)
    p = F.least(F.lit(1.0), F.coalesce("scale", F.lit(0.0)) * F.col("size"))
    rank = F.when(F.col("p") <= 0, F.lit(float("inf"))).when(F.col("p") >= 1, F.lit(-1.0)).otherwise(odds(u) / odds(F.col("p")))
    # t: the rank on a scale from 0 to 1, and -1 for certain documents
    t = F.when(F.col("rank") < 0, F.lit(-1.0)).when(F.col("rank") == float("inf"), F.lit(1.0)).otherwise(F.col("rank") / (1 + F.col("rank")))
    ranked = rows.join(goal, same(rows, goal), "left").select("rid", "doc_id", rows["source"], "size", "source_size", "target", "sure", "rest", p.alias("p"))
    ranked = Table(ranked.withColumn("rank", rank).withColumn("t", t).drop("p"), "ranked").df
    edge, bin_ = _edges(ranked.filter("size > 0"), edge_rows)
    told = ranked.join(edge.withColumnRenamed("source", "edge_source"), F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source").withColumn("bin", bin_)
    inside = told.filter((F.col("bin") == F.col("edge")) & (F.col("size") > 0))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "rid")
    inside = inside.withColumn("upto", F.col("below") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Table(inside.select("rid", "source", "size", "upto", "rest"), "edge_rows").df
    chosen = inside.filter(F.col("upto") <= F.col("rest")).select("rid")
    got = inside.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("upto"))
    got = got.join(edge.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", F.coalesce("upto", "below").alias("got"))
    # one more document if it fits the gap better than leaving it open
    open_docs = told.filter((F.col("size") > 0) & (F.col("bin") >= F.col("edge"))).join(chosen, "rid", "left_anti")
    fit = open_docs.join(got.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    gap = F.col("rest") - F.col("got")
    last = fit.filter(F.abs(F.col("size") - gap) < gap).groupBy("source").agg(F.min_by("rid", F.struct(F.abs(F.col("size") - gap), "rank", "doc_id", "rid")).alias("rid")).select("rid")
    extra = F.coalesce(F.col("bin") < F.col("edge"), F.lit(False)) | F.col("hit").isNotNull() | (F.col("edge").isNull() & (F.col("rest") > 0))
    picked = told.join(chosen.unionByName(last).withColumn("hit", F.lit(1)), "rid", "left")
    copies = F.when(F.col("size") > 0, F.least(F.lit(most).cast("bigint"), F.col("sure") + F.when(extra, 1).otherwise(0))).otherwise(F.lit(0).cast("bigint"))
    return picked.withColumn("copies", copies).select(
        *([F.col("rid").alias(row_col)] if row_col else []),
        F.col("doc_id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
