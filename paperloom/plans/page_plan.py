"""The declarative plan of a page, as one wide select."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.rules import header_template


@dataclass(frozen=True)
class Layout:
    """The layout profile's defaults."""

    header_height: float = 54
    header_min_height: float = 42
    header_adaptive_max_height: float = 76
    cleanup_max_height: float = 150
    footer_height: float = 18
    footer_max_replacement_height: float = 60
    safety_gap: float = 7
    dark_page_threshold: float = 0.45
    designed_page_large_image_ratio: float = 0.075
    designed_page_title_min_font: float = 17
    designed_page_title_top_ratio: float = 0.30
    allow_rebuild_crop: bool = False
    first_page_cleanup_targets: dict = field(default_factory=lambda: {"TEST": 96, "PRACTICE TEST": 96, "CHAPTER TEST": 96, "PRACTICE SHEET": 86, "NCERT PRACTICE": 86})


def page_type(layout: Layout = Layout()) -> Column:
    """From blank, page, material_type, title_on_page, title_found, title_font, title_y0,
    title_width_ratio, height, large_image_ratio, n_images, n_drawings,
    structural_header and dark_ratio."""
    c = F.col
    font = layout.designed_page_title_min_font
    prominent = c("title_found") & (c("title_font") >= font) & (c("title_y0") <= c("height") * layout.designed_page_title_top_ratio)
    design = (c("large_image_ratio") >= layout.designed_page_large_image_ratio) | (c("n_images") >= 1) | (c("n_drawings") >= 4) | (c("title_font") >= font * 1.20) | (c("title_width_ratio") >= 0.42)
    opener = (c("page") == 1) & (c("material_type") == "NOTES") & c("title_on_page") & prominent & design & ~c("structural_header")
    return F.when(c("blank"), "blank").when(opener | (c("material_type") == "KEY POINTS"), "designed").when(c("dark_ratio") >= layout.dark_page_threshold, "dark").otherwise("standard")


def cleanup_bottom(header_bottom: Column, legacy_bottom: Column, first_y: Column, layout: Layout = Layout()) -> Column:
    """How far down the old header may be erased. Without content there is no
    limit: least() would skip a null, so the case is spelt out."""
    wanted = F.least(F.greatest(F.lit(float(layout.header_height)), header_bottom, F.coalesce(legacy_bottom, F.lit(0.0))), F.lit(float(layout.cleanup_max_height)))
    limit = F.greatest(F.lit(0.0), first_y - layout.safety_gap)
    return F.when(first_y.isNull(), wanted).otherwise(F.least(wanted, limit))


def visible_height(cleanup: Column, safe: Column, layout: Layout = Layout()) -> Column:
    return F.when(safe, F.least(cleanup, F.lit(float(layout.header_adaptive_max_height)))).otherwise(F.lit(0.0))


def footer_top(height: Column, band_top: Column, band_confidence: Column, last_y: Column, layout: Layout = Layout()) -> Column:
    """Top of the new footer, or null where content is in the way."""
    if layout.footer_height <= 0:
        return F.lit(None).cast("double")
    wanted = height - layout.footer_height
    verified = band_top.isNotNull() & (band_confidence >= 0.55)
    band = height - band_top
    clear = last_y.isNull() | (last_y <= band_top - layout.safety_gap)
    in_place = verified & (band > 0) & (band <= layout.footer_max_replacement_height) & clear
    top = F.when(in_place, band_top).when(verified & (band_top >= wanted - 8), F.least(band_top, wanted)).otherwise(wanted)
    return F.when(last_y.isNull() | (last_y <= top - layout.safety_gap), top)


def plan_confidence(type_confidence: Column, header_confidence: Column, safe: Column, has_legacy: Column) -> Column:
    total = type_confidence * 0.52 + F.greatest(header_confidence, F.lit(0.35)) * 0.28 + F.when(safe, 0.15).otherwise(0.0) + F.when(has_legacy, 0.05).otherwise(0.0)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.50), total))


def plan_pages(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Adds the plan's columns to pages.

    pages: page, width, height, page_type, opener (a designed chapter opener),
    material_type, type_confidence, header_bottom, header_confidence, band_top
    (footer band, null: none), footer_confidence, first_y, last_y (content, null:
    none), legacy_rects, footer_legacy_rects, vertical_rects (arrays of
    rectangles), text_ok, image_only. Only columns of the row itself are read,
    so nothing is shuffled.
    """
    c = F.col
    gap = layout.safety_gap
    rows = pages.withColumn("legacy_bottom", F.coalesce(F.array_max(F.transform("legacy_rects", lambda r: r["y1"])), F.lit(0.0)))
    has_legacy = F.size("legacy_rects") > 0
    rows = rows.withColumn("cleanup", cleanup_bottom(c("header_bottom"), c("legacy_bottom"), c("first_y"), layout))
    targets = layout.first_page_cleanup_targets
    target = F.element_at(F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v))]), c("material_type")) if targets else F.lit(None).cast("double")
    fallback = F.when(c("first_y").isNull() | target.isNull(), target).otherwise(F.least(target, c("first_y") - gap))  # least() skips nulls
    used = (c("page") == 1) & ~has_legacy & fallback.isNotNull() & (fallback > c("cleanup") + 2) & (fallback >= layout.header_min_height)
    rows = rows.withColumn("_used", F.coalesce(used, F.lit(False)))
    rows = rows.withColumn("_safe", c("_used") | (c("cleanup") >= layout.header_min_height))
    rows = rows.withColumn("cleanup", F.greatest(F.lit(0.0), F.when(c("_used"), fallback).otherwise(c("cleanup"))))
    rows = rows.withColumn("visible", visible_height(c("cleanup"), c("_safe"), layout))
    rows = rows.withColumn("header_safe", c("_safe") & c("text_ok"))
    foot = F.when(c("text_ok"), footer_top(c("height"), c("band_top"), c("footer_confidence"), c("last_y"), layout))

    standard, blank = c("page_type") == "standard", c("page_type") == "blank"
    deep = c("_used") | ((c("page") == 1) & (c("cleanup") > c("visible") + 8))
    marked = has_legacy | (F.size("vertical_rects") > 0)
    page_strategy = (
        F.when(blank, "leave_untouched")
        .when(~standard & has_legacy, "designed_page_logo_only")
        .when(~standard, "designed_page_preserve")
        .when(c("header_safe") & deep, "first_page_large_logo_replacement")
        .when(c("header_safe"), "standard_header_footer_replacement")
        .when(marked, "legacy_only_cleanup")
        .otherwise("leave_untouched")
    )
    strategy = (
        F.when(blank, "preserve")
        .when(~standard, F.when(has_legacy, "replace_logo_only").otherwise("preserve"))
        .when(c("header_safe"), "overlay")
        .when(has_legacy, "replace_logo_only")
        .when(marked, "overlay")
        .otherwise("preserve")
    )
    rows = rows.withColumns({"page_strategy": page_strategy, "strategy": strategy})
    rows = rows.withColumn("header_template", F.when(standard & c("header_safe"), header_template(c("material_type"))).otherwise("none"))
    rows = rows.withColumn("header_rect", F.when(standard & c("header_safe"), g.rect(F.lit(0.0), F.lit(0.0), c("width"), c("visible"))))
    rows = rows.withColumn("footer_rect", F.when(standard & foot.isNotNull(), g.rect(F.lit(0.0), foot, c("width"), c("height"))))
    cleared = F.concat(F.array(g.rect(F.lit(0.0), F.lit(0.0), c("width"), c("cleanup"))), c("legacy_rects")).cast(g.RECTS)
    rows = rows.withColumn("cleanup_rects", F.when(standard & c("header_safe"), cleared).otherwise(g.no_rects()))
    old_top = F.greatest(c("header_bottom"), c("legacy_bottom"))
    crop_top = F.when(c("first_y").isNull(), old_top).otherwise(F.least(old_top, F.greatest(F.lit(0.0), c("first_y") - gap)))
    old_bottom = F.when(c("band_top").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), c("height") - c("band_top")))
    crop_bottom = F.when(c("last_y").isNull(), old_bottom).otherwise(F.least(old_bottom, F.greatest(F.lit(0.0), c("height") - c("last_y") - gap)))
    rows = rows.withColumns({"crop_top": F.when(standard, crop_top).otherwise(0.0), "crop_bottom": F.when(standard, crop_bottom).otherwise(0.0)})
    crop_safe = (
        standard & c("text_ok") & ~c("image_only") & c("header_safe")
        & (c("header_confidence") >= 0.72) & (c("crop_top") > 0) & (c("crop_top") + 0.1 >= old_top)
        & (c("first_y").isNull() | (c("crop_top") <= c("first_y") - gap + 0.1))
        & (c("band_top").isNull() | (c("footer_confidence") >= 0.65))
        & (c("band_top").isNull() | c("last_y").isNull() | (c("last_y") + gap <= c("band_top")))
    )
    rows = rows.withColumn("crop_is_safe", crop_safe)
    if layout.allow_rebuild_crop:
        rows = rows.withColumn("strategy", F.when(crop_safe & (c("strategy") == "overlay"), "rebuild_crop").otherwise(c("strategy")))
        head = F.coalesce(c("header_rect.y1"), F.lit(0.0))
        tail = F.coalesce(c("footer_rect.y0"), c("height"))
        rows = rows.withColumn("crop", F.when(c("strategy") == "rebuild_crop", g.crop_geometry(c("width"), c("height"), c("crop_top"), c("crop_bottom"), head, tail)))
    designed = F.when(has_legacy, 0.97).when(c("opener"), 0.92).otherwise(0.78)
    rows = rows.withColumn("confidence", F.when(blank, 1.0).when(~standard, designed).otherwise(plan_confidence(c("type_confidence"), c("header_confidence"), c("header_safe"), has_legacy)))
    logo = F.when(c("strategy") == "replace_logo_only", F.get("legacy_rects", 0))
    rows = rows.withColumn("logo_replace_rect", logo)
    covered = F.array_compact(F.concat(c("cleanup_rects"), F.array(c("footer_rect"), c("logo_replace_rect")).cast(g.RECTS)))
    marks = F.concat(c("legacy_rects"), c("footer_legacy_rects"))
    rows = rows.withColumn("_covered", covered).withColumn("additional_logo_rects", F.filter(marks, lambda m: ~F.exists("_covered", lambda x: g.contains(x, m))))
    return rows.drop("_used", "_safe", "_covered", "visible")
