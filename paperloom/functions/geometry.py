"""Rectangles as columns: struct(x0, y0, x1, y1) of doubles, y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
RECTS = f"array<{RECT}>"


def rect(x0, y0, x1, y1) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_col(x0).alias("x0"), as_col(y0).alias("y0"), as_col(x1).alias("x1"), as_col(y1).alias("y1"))


def no_rects() -> Column:
    return F.array().cast(RECTS)


def is_empty(r: Column) -> Column:
    return (r["x0"] >= r["x1"]) | (r["y0"] >= r["y1"])


def intersects(a: Column, b: Column) -> Column:
    """They share an area; edges that touch do not count."""
    return (F.greatest(a["x0"], b["x0"]) < F.least(a["x1"], b["x1"])) & (F.greatest(a["y0"], b["y0"]) < F.least(a["y1"], b["y1"]))


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def grown(r: Column, by: float) -> Column:
    return rect(r["x0"] - by, r["y0"] - by, r["x1"] + by, r["y1"] + by)


def near(a: Column, b: Column, pad: float) -> Column:
    return intersects(grown(a, pad), b)


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def area(r: Column) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def mapped(r: Column, scale: Column, dx: Column, dy: Column) -> Column:
    return rect(r["x0"] * scale + dx, r["y0"] * scale + dy, r["x1"] * scale + dx, r["y1"] * scale + dy)


def any_intersects(r: Column, regions: Column) -> Column:
    return F.exists(F.coalesce(regions, no_rects()), lambda x: intersects(r, x))


def crop_geometry(width: Column, height: Column, top: Column, bottom: Column, header: Column, footer: Column) -> Column:
    """struct(clip, scale, dx, dy) that fits a page without `top` and `bottom`
    between the y of a header's end and of a footer's start. A clip or a target
    without room is an error."""
    clip_height, room = height - top - bottom, footer - header
    scale = F.least(F.lit(1.0), room / clip_height)
    dx = (width - width * scale) / 2
    dy = header + (room - clip_height * scale) / 2 - top * scale
    bad = (top < 0) | (bottom < 0) | (clip_height <= 1) | (room <= 0)
    kind = f"struct<clip:{RECT},scale:double,dx:double,dy:double>"
    fine = F.struct(rect(F.lit(0.0), top, width, height - bottom).alias("clip"), scale.alias("scale"), dx.alias("dx"), dy.alias("dy"))
    return F.when(bad, F.raise_error(F.lit("crop leaves no page area")).cast(kind)).otherwise(fine)


def _pieces(r: Column, cut: Column) -> Column:
    """What is left of a rectangle without another: above, below, left, right."""
    i = intersection(r, cut)
    parts = F.array(
        rect(r["x0"], r["y0"], r["x1"], i["y0"]),
        rect(r["x0"], i["y1"], r["x1"], r["y1"]),
        rect(r["x0"], i["y0"], i["x0"], i["y1"]),
        rect(i["x1"], i["y0"], r["x1"], i["y1"]),
    )
    return F.when(intersects(r, cut), parts).otherwise(F.array(r))


def subtract(r: Column, cuts: Column, least: float = 0.1) -> Column:
    """Rectangles that cover r without any of an array of cuts, in order; those
    no wider or higher than `least` are dropped."""
    keep = lambda x: (x["x1"] - x["x0"] > least) & (x["y1"] - x["y0"] > least)
    step = lambda acc, cut: F.filter(F.flatten(F.transform(acc, lambda x: _pieces(x, cut))), keep)
    return F.aggregate(F.coalesce(cuts, no_rects()), F.array(r).cast(RECTS), step)


def coverage(areas: Column, page_area: Column) -> Column:
    """Share of a page, at most 1, of a sum of areas."""
    return F.least(F.lit(1.0), areas / F.greatest(page_area, F.lit(1.0)))
