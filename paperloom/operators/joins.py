"""Joins of tables that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """df, whose next join deals both sides by their keys and sorts them. A table
    with a row for each page or region is small in a compressed file, and after
    its columns are pruned, but not as a hash table on the driver, which the
    optimiser would make of it by those sizes."""
    return df.hint("merge")
