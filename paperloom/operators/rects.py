"""Greedy merges of near rectangles: sequential, so a page is folded in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import sorted_fold

_BOX = ["x0", "y0", "x1", "y1"]
PAD = 5.0


def _near(a: list[float], b: list[float], pad: float) -> bool:
    return max(a[0] - pad, b[0]) < min(a[2] + pad, b[2]) and max(a[1] - pad, b[1]) < min(a[3] + pad, b[3])


def _join(a: list[float], b: list[float]) -> list[float]:
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def merged(rects: Iterable[tuple], absorb: bool = False, pad: float = PAD) -> list[list[float]]:
    """Groups of rectangles in order of y0 and x0. Each joins the first group
    near it; or, with absorb, takes in all groups near it as it was, and stands
    behind the others. As tops only rise, a group that ends above one is near no
    later one: only open groups are looked at."""
    opened: dict[int, list[float]] = {}
    closed: dict[int, list[float]] = {}
    for n, r in enumerate(rects):
        r = list(r)
        for k in [k for k, e in opened.items() if e[3] + pad <= r[1]]:
            closed[k] = opened.pop(k)
        near = (k for k, e in opened.items() if _near(e, r, pad))
        if absorb:
            for k in list(near):
                r = _join(r, opened.pop(k))
            opened[n] = r
        else:
            k = next(near, n)
            opened[k] = _join(opened[k], r) if k in opened else r
    return [g for _, g in sorted((closed | opened).items())]


def merged_rects(rects: DataFrame, absorb: bool = False, pad: float = PAD) -> DataFrame:
    """rects: (doc string, page long, x0, y0, x1, y1) -> groups, numbered in order.
    Not a transitive closure: what a group has grown to decides what joins it."""

    def fold(rows: Iterator[tuple]) -> Iterable[tuple]:
        return ((n, *group) for n, group in enumerate(merged(rows, absorb, pad)))

    doubles = rects.select("doc", "page", *[F.col(c).cast("double").alias(c) for c in _BOX])
    return sorted_fold(doubles, ["doc", "page"], ["y0", "x0", "x1", "y1"], _BOX, fold, "nth long, x0 double, y0 double, x1 double, y1 double")
