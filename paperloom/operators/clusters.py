"""Clusters of positions on a line."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import sorted_fold


def gap_clusters(df: DataFrame, keys: Sequence[str], at: str, gap: Column, tie: str | None = None) -> DataFrame:
    """Adds cluster, from 0: a row starts one if it lies further than `gap`
    after the row before."""
    order = Window.partitionBy(*keys).orderBy(at, *([tie] if tie else []))
    starts = F.when(F.col(at) - F.lag(at).over(order) > gap, 1).otherwise(0)
    return df.withColumn("_starts", starts).withColumn("cluster", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def mean_linkage(values: Column, tolerance: float) -> Column:
    """Clusters of an array of doubles, array of struct(lo, hi, n, total, begin):
    a value, in rising order, joins the last cluster if it lies within
    `tolerance` of that cluster's mean. Clusters are runs of the sorted values
    from place `begin` on, so none of them carries its members."""
    cluster = "struct<lo:double,hi:double,n:bigint,total:double,begin:bigint>"
    none = F.lit(None).cast(cluster)
    start = F.struct(F.array().cast(f"array<{cluster}>").alias("done"), none.alias("now"))

    def step(acc: Column, v: Column) -> Column:
        now = acc["now"]
        joins = F.coalesce(F.abs(v - now["total"] / now["n"]) <= tolerance, F.lit(False))
        grown = F.struct(now["lo"].alias("lo"), v.alias("hi"), (now["n"] + 1).alias("n"), (now["total"] + v).alias("total"), now["begin"].alias("begin"))
        new = F.struct(v.alias("lo"), v.alias("hi"), F.lit(1).cast("bigint").alias("n"), v.alias("total"), F.coalesce(now["begin"] + now["n"], F.lit(0).cast("bigint")).alias("begin"))
        done = F.when(joins | now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(joins, grown).otherwise(new).alias("now"))

    finish = lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
    return F.aggregate(F.array_sort(F.filter(values, lambda v: v.isNotNull())), start, step, finish)


def mean_linkage_rows(df: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """The clusters of mean_linkage for groups of any size: (keys, cluster, lo,
    hi, n). Values are sorted into partitions, and a cluster leaves as soon as
    the next one begins. Nulls are left out."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        lo = hi = total = n = None
        cluster = 0
        for (v,) in rows:
            if n and abs(v - total / n) <= tolerance:
                hi, total, n = v, total + v, n + 1
            else:
                if n:
                    yield cluster, lo, hi, n
                    cluster += 1
                lo = hi = total = v
                n = 1
        if n:
            yield cluster, lo, hi, n

    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return sorted_fold(rows, keys, ["_v"], ["_v"], fold, "cluster long, lo double, hi double, n long")


def repeated_positions(marks: DataFrame, pages: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """marks: (doc, page, y[, strength]); pages: (doc, sampled, threshold).
    Medians of mean-linkage clusters that lie within the tolerance of marks on
    at least `threshold` pages: (doc, y, support, strength).

    A document's marks are few (rules and bands of its pages), so a document is
    clustered in one row; support counts marks of all clusters again."""
    strength = F.col("strength") if "strength" in marks.columns else F.lit(1.0)
    marks = marks.select("doc", "page", F.col("y").cast("double").alias("y"), strength.alias("strength"))
    sorted_ys = marks.groupBy("doc").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    centres = sorted_ys.select("doc", "ys", F.posexplode(mean_linkage(F.col("ys"), tolerance)).alias("nth", "c"))
    centres = centres.select("doc", "nth", F.slice("ys", (F.col("c.begin") + 1).cast("int"), F.col("c.n").cast("int")).alias("members"))
    members = F.col("members")
    half = F.floor(F.size(members) / 2).cast("int")
    median = F.when(F.size(members) % 2 == 1, F.get(members, half)).otherwise((F.get(members, half - 1) + F.get(members, half)) / 2)
    centres = centres.select("doc", "nth", median.alias("centre"))
    near = centres.join(marks, "doc").filter(F.abs(F.col("y") - F.col("centre")) <= tolerance)
    counted = near.groupBy("doc", "nth", "centre").agg(F.countDistinct("page").alias("n"), F.avg("strength").alias("strength"))
    found = counted.join(pages.select("doc", "sampled", "threshold"), "doc").filter(F.col("n") >= F.col("threshold"))
    return found.select("doc", F.col("centre").alias("y"), (F.col("n") / F.col("sampled")).alias("support"), "strength")
