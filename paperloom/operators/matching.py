"""Nearest unused counterparts: greedy matching that is sequential by nature."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import sorted_fold

_BOX = ("x0", "y0", "x1", "y1")
#: Free outputs from which on distances are taken all at once.
MANY = 24


def _greedy(rows: Iterator[tuple]) -> Iterable[tuple]:
    """Rows of one token of a page, outputs first: (is_source, x0, y0, x1, y1).
    Sources in order, each to the nearest output that is left; nearest by
    distance of the upper left corners, the first of equals."""
    free: list[tuple] = []
    corners, worst, checks = None, None, 0
    for source, *box in rows:
        if not source:
            free.append(tuple(box))
            continue
        if checks == len(free):
            break
        if len(free) <= MANY:
            k = min((i for i, f in enumerate(free) if f is not None), key=lambda i: abs(free[i][0] - box[0]) + abs(free[i][1] - box[1]))
        else:
            if corners is None:
                corners = np.array(free)[:, :2]
            k = int((np.abs(corners[:, 0] - box[0]) + np.abs(corners[:, 1] - box[1])).argmin())
            corners[k] = np.inf
        shift = max(abs(a - b) for a, b in zip(free[k], box))
        free[k] = None
        worst, checks = shift if worst is None else max(worst, shift), checks + 1
    return [(worst, checks)] if checks else []


def position_shifts(before: DataFrame, after: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """before and after: (doc, page, token, box) -> (doc, page, shift, checks):
    the largest shift of a source word against its nearest unused output.

    Tokens that occur once on both sides, by far the most, need no matching and
    stay in SQL; the others are matched token by token, in one pass."""
    if plans is not None:
        moved = F.when(F.col("crop").isNotNull(), F.struct(*[(F.col(f"box.{c}") * F.col("crop.scale") + F.col(f"crop.d{c[0]}")).alias(c) for c in _BOX])).otherwise(F.col("box"))
        before = before.join(plans.select("doc", "page", "crop"), ["doc", "page"]).withColumn("box", moved)
    keys = ["doc", "page", "token"]
    a = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"), F.first("box").alias("box_a"))
    b = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"), F.first("box").alias("box_b"))
    both = a.join(b, keys)
    single = both.filter("a = 1 AND b = 1").select(*keys, F.greatest(*[F.abs(F.col(f"box_a.{c}") - F.col(f"box_b.{c}")) for c in _BOX]).alias("worst"), F.lit(1).cast("long").alias("checks"))
    several = both.filter("a > 1 OR b > 1").select(*keys)
    side = lambda df, source: df.join(several, keys, "left_semi").select(*keys, *[F.col(f"box.{c}").alias(c) for c in _BOX], F.lit(source).alias("is_source"))
    both_sides = side(before, True).unionByName(side(after, False))
    matched = sorted_fold(both_sides, keys, ["is_source", "y0", "x0", "y1", "x1"], ["is_source", *_BOX], _greedy, "worst double, checks long")
    told = single.drop("token").unionByName(matched.drop("token"))
    found = told.select(F.col("doc").cast("string").alias("doc"), F.col("page").cast("long").alias("page"), "worst", "checks")
    return found.groupBy("doc", "page").agg(F.max("worst").alias("shift"), F.sum("checks").alias("checks"))


def page_matches(words: DataFrame) -> DataFrame:
    """words: (doc, page, token, is_source, x0, y0, x1, y1), both sides. (doc,
    page, retention, shift, checks) of each page: multiset_retention (null
    without source words) and position_shifts (null, and 0 checks, without
    matches).

    Words that lie together by page stay there: only tokens that a page has
    several times on a side, and on both, are dealt once more."""
    c, page, keys = F.col, ["doc", "page"], ["doc", "page", "token"]
    at = lambda source: [F.max(F.when(c("is_source") == source, c(x))).alias(f"{x}_{source}") for x in _BOX]
    counts = F.count_if("is_source"), F.count_if(~c("is_source"))
    counted = words.groupBy(*keys).agg(counts[0].alias("a"), counts[1].alias("b"), *at(True), *at(False))
    single = (c("a") == 1) & (c("b") == 1)
    worst = F.greatest(*[F.abs(c(f"{x}_True") - c(f"{x}_False")) for x in _BOX])
    kept, total = F.sum(F.least("a", "b")), F.sum("a")
    told = counted.groupBy(*page).agg(F.when(total > 0, kept.cast("double") / total).alias("retention"), F.max(F.when(single, worst)).alias("_shift"), F.count_if(single).alias("_checks"))
    token = Window.partitionBy(*keys)
    several = words.withColumns({"a": counts[0].over(token), "b": counts[1].over(token)}).filter("a > 0 AND b > 0 AND (a > 1 OR b > 1)")
    matched = sorted_fold(several, keys, ["is_source", "y0", "x0", "y1", "x1"], ["is_source", *_BOX], _greedy, "worst double, checks long")
    others = matched.groupBy(*page).agg(F.max("worst").alias("_worst"), F.sum("checks").alias("_more"))
    shift, checks = F.greatest("_shift", "_worst"), c("_checks") + F.coalesce("_more", F.lit(0))
    return told.join(others, page, "left").select(*page, "retention", shift.alias("shift"), checks.alias("checks"))
