"""Joins of page elements with regions of the same page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a: str, b: str) -> Column:
    """Positive overlap in x and y; touching edges do not count."""
    c = lambda side, x: F.col(f"{side}.{x}")
    return (c(a, "x0") < c(b, "x1")) & (c(b, "x0") < c(a, "x1")) & (c(a, "y0") < c(b, "y1")) & (c(b, "y0") < c(a, "y1"))


def in_regions(elements: DataFrame, regions: DataFrame, keys: list[str], outside: bool = False) -> DataFrame:
    """Elements that meet a region of their page, or those that meet none. The
    keys make it an equality join; overlap is a condition on its matches."""
    same = [F.col(f"e.{k}") == F.col(f"r.{k}") for k in keys]
    condition = overlaps("e", "r")
    for k in same:
        condition = condition & k
    return elements.alias("e").join(regions.alias("r"), condition, "left_anti" if outside else "left_semi")


def brand_above_number(words: DataFrame, images: DataFrame) -> DataFrame:
    """words: (doc, page, word_id, x0, y0, x1, y1); images: (doc, page, number,
    x0, y0, x1, y1) -> (doc, page, word_id, number): the topmost image that a
    word fits: 88 % of its width inside, width ratio 0.6 to 1.2 of the image,
    and at least 35 % of its height."""
    w, i = words.alias("w"), images.alias("i")
    c = F.col
    wide = F.least(c("w.x1"), c("i.x1")) - F.greatest(c("w.x0"), c("i.x0"))
    high = F.least(c("w.y1"), c("i.y1")) - F.greatest(c("w.y0"), c("i.y0"))
    ratio = (c("i.x1") - c("i.x0")) / (c("w.x1") - c("w.x0"))
    fits = (wide >= 0.88 * (c("w.x1") - c("w.x0"))) & (ratio >= 0.6) & (ratio <= 1.2) & (high >= 0.35 * (c("w.y1") - c("w.y0")))
    met = w.join(i, (c("w.doc") == c("i.doc")) & (c("w.page") == c("i.page")) & fits)
    return met.groupBy("w.doc", "w.page", "w.word_id").agg(F.max("i.number").alias("number"))


def authorised(occurrences: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc, image) whose every occurrence lies inside a region of its page;
    images without occurrences are not listed."""
    o, r = occurrences.alias("o"), regions.alias("r")
    c = F.col
    inside = (c("r.x0") <= c("o.x0")) & (c("r.y0") <= c("o.y0")) & (c("r.x1") >= c("o.x1")) & (c("r.y1") >= c("o.y1"))
    loose = o.join(r, (c("o.doc") == c("r.doc")) & (c("o.page") == c("r.page")) & inside, "left_anti").select("doc", "image").distinct()
    return occurrences.select("doc", "image").distinct().join(loose, ["doc", "image"], "left_anti")
