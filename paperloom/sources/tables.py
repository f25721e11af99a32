"""The driver's tables, with types that compare across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: A union of sides that lie by the same keys would say so, though adaptive
#: execution merges the partitions of each side by its own sizes; what is then
#: dealt by these keys is not dealt at all, and rows of a key do not meet.
UNION = "spark.sql.unionOutputPartitioning"


def distrust_unions(spark: SparkSession) -> None:
    """Rows of a union are dealt anew where they have to meet."""
    spark.conf.set(UNION, "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    distrust_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
