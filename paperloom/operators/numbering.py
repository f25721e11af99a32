"""Places of all rows in one order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import Written


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """df with `name`, its place from 1 in an order. Rows are dealt by ranges of
    the order and sorted where they are; a row's number is its place in its
    partition after all rows of the partitions before. Rows that are equal in
    the order get different numbers, and keep them: they are written once."""
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftrightunsigned(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    rows = Written(placed, "numbered").df
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")  # one row a partition


def publication_order(artifacts: DataFrame) -> DataFrame:
    """artifacts: (path, ...). number: reports and the like first, by path, and
    the documents themselves last."""
    last = F.lower("path").endswith(".pdf")
    return numbered(artifacts.withColumn("_last", last), ["_last", "path"]).drop("_last")
