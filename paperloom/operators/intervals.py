"""Overlaps of intervals of one key, by time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping_pairs(df: DataFrame, key: str, id_col: str, start: str, end: str, width: int) -> DataFrame:
    """(left_id, right_id), left below right, of intervals [start, end) of one
    key that overlap; touching ends do not. start and end are whole numbers.

    An interval is listed in every bucket of `width` that it reaches, and pairs
    meet in an equality join on key and bucket, so a key with very many
    intervals is as many groups as it has buckets. A pair counts in the bucket
    in which its later start lies. Choose width near the usual length."""
    bucket = lambda x: F.floor(x / width)
    reached = F.sequence(bucket(F.col(start)), bucket(F.greatest(F.col(start), F.col(end) - 1)))
    rows = df.filter(F.col(end) > F.col(start)).select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(reached).alias("b"))
    a, b = rows.alias("a"), rows.alias("b")
    c = F.col
    meet: Column = (c("a.k") == c("b.k")) & (c("a.b") == c("b.b")) & (c("a.id") < c("b.id")) & (c("a.s") < c("b.e")) & (c("b.s") < c("a.e"))
    later = bucket(F.greatest(c("a.s"), c("b.s"))) == c("a.b")
    return a.join(b, meet & later).select(c("a.id").alias("left_id"), c("b.id").alias("right_id"))
