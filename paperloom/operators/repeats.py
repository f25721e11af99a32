"""Text that repeats across the pages of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repeat_signature

LEAST_SIGNATURE = 3
SHARE = 0.45


def sampled_pages(pages: DataFrame) -> DataFrame:
    """pages: (doc, page), distinct -> (doc, first, n, sampled, threshold). Of four pages
    and more the first is left out."""
    counted = pages.groupBy("doc").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    sampled = F.when(F.col("n") >= 4, F.col("n") - 1).otherwise(F.col("n"))
    least = F.when(sampled >= 2, 2).otherwise(1)
    return counted.withColumn("sampled", sampled).withColumn("threshold", F.greatest(least, F.ceil(sampled * SHARE)).cast("bigint"))


def repeated_signatures(lines: DataFrame, least_support: int = 2) -> DataFrame:
    """lines: (doc, page, text) -> (doc, signature, support, sampled, ratio,
    threshold, is_repeated) of signatures on at least least_support pages.

    (doc, signature, page) is made distinct before counting, with map-side
    combining, so a very common line costs a row for each page it is on."""
    pages = sampled_pages(lines.select("doc", "page").distinct())
    signed = lines.select("doc", "page", repeat_signature(F.col("text")).alias("signature")).filter(F.length("signature") >= LEAST_SIGNATURE)
    on_page = signed.distinct().join(pages.select("doc", "first", "n"), "doc").filter((F.col("n") < 4) | (F.col("page") != F.col("first")))
    support = on_page.groupBy("doc", "signature").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least_support)
    joined = support.join(pages.select("doc", "sampled", "threshold", "n"), "doc")
    return joined.select("doc", "signature", "support", "sampled", (F.col("support") / F.col("sampled")).alias("ratio"), "threshold", ((F.col("support") >= F.col("threshold")) & (F.col("n") > 1)).alias("is_repeated"))
