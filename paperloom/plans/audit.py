"""Audit of an output against its source and plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.joins import dealt
from ..operators.matching import page_matches

# The audit's default limits.
MIN_RETENTION, MAX_SHIFT, SIZE_TOLERANCE, SIDE_WIDTH = 0.985, 2.5, 0.5, 68.0
PIXEL_TOLERANCE, MAX_BODY_CHANGE, MAX_REGION_CHANGE = 12, 0.0005, 0.01
DESIGNED = ("designed_page_preserve", "designed_page_logo_only")
ISSUE = ("doc", "page", "code", "severity")


Rule = tuple[Column, str, Column | str]


def _listed(rules: list[Rule]) -> Column:
    """All issues of a row, as an array; a condition that is null is none."""
    level = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.array_compact(F.array(*[F.when(k, F.struct(F.lit(code).alias("code"), level(severity).alias("severity"))) for k, code, severity in rules]))


def _issue(rows: DataFrame, condition: Column, code: str, severity: Column | str) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.filter(condition).select("doc", "page", F.lit(code).alias("code"), level.alias("severity"))


def excluded_regions(output: bool = False) -> Column:
    """Regions whose words are not body text, as an array of rectangles."""
    c = F.col
    ordinary = F.concat(c("cleanup_rects"), c("vertical_rects"), c("additional_logo_rects"), F.array_compact(F.array(c("header_rect"), c("footer_rect"), c("logo_replace_rect")).cast(g.RECTS)))
    clip, scale, dx, dy = c("crop.clip"), c("crop.scale"), c("crop.dx"), c("crop.dy")
    if output:
        moved = F.transform(F.concat(c("vertical_rects"), c("additional_logo_rects"), F.array_compact(F.array(c("logo_replace_rect")).cast(g.RECTS))), lambda r: g.mapped(r, scale, dx, dy))
        cropped = F.concat(moved, F.array_compact(F.array(c("header_rect"), c("footer_rect")).cast(g.RECTS)))
    else:
        far = F.lit(100000.0)
        cropped = F.concat(c("vertical_rects"), c("additional_logo_rects"), F.array(g.rect(F.lit(0.0), F.lit(0.0), clip["x1"], clip["y0"]), g.rect(F.lit(0.0), clip["y1"], clip["x1"], far)).cast(g.RECTS))
    return F.when(c("crop").isNotNull(), cropped).otherwise(ordinary)


def body_words(words: DataFrame, plans: DataFrame, terms: list[str], output: bool = False) -> DataFrame:
    """words: (doc, page, x0, y0, x1, y1, text) -> (doc, page, token, box) of words
    outside the plan's regions, cut into tokens, without the terms. The join is
    on document and page; regions travel with their page."""
    regions = plans.select("doc", "page", excluded_regions(output).alias("regions"))
    box = g.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    body = words.withColumn("box", box).join(regions, ["doc", "page"]).filter(~g.any_intersects(F.col("box"), F.col("regions")))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z0-9]+"), F.lit(0))
    out = body.select("doc", "page", "box", F.explode(tokens).alias("token"))
    return out.filter(~F.col("token").isin(*terms)) if terms else out


def body_matches(source_words: DataFrame, output_words: DataFrame, plans: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, page, retention, shift, checks) of the body words of each planned
    page that has any, see page_matches and body_words.

    Words of both sides are dealt by page once, together with what their plans
    exclude, and counted where they are."""
    c, box = F.col, ("x0", "y0", "x1", "y1")
    side = lambda words, source: words.select("doc", "page", *box, "text", F.lit(source).alias("is_source"))
    crop = c("crop").isNotNull()
    regions = plans.select("doc", "page", excluded_regions().alias("regions"), F.when(crop, excluded_regions(True)).alias("moved"), F.when(crop, F.struct("crop.scale", "crop.dx", "crop.dy")).alias("crop"))
    rows = side(source_words, True).unionByName(side(output_words, False)).join(dealt(regions), ["doc", "page"])
    out = F.when(c("is_source") | ~crop, c("regions")).otherwise(c("moved"))
    body = rows.filter(~g.any_intersects(g.rect(*map(c, box)), out))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z0-9]+"), F.lit(0))
    places = [F.when(c("is_source") & crop, c(x) * c("crop.scale") + c(f"crop.d{x[0]}")).otherwise(c(x)).alias(x) for x in box]
    found = body.select("doc", "page", "is_source", *places, F.explode(tokens).alias("token"))
    return page_matches(found.filter(~c("token").isin(*terms)) if terms else found)


def geometry_issues(plans: DataFrame) -> DataFrame:
    """Planned regions that meet protected content, and crops that cut it."""
    return plans.select("doc", "page", F.inline(_listed(geometry_rules())))


def geometry_rules() -> list[Rule]:
    c = F.col
    protected = F.concat(c("protected_text_rects"), c("protected_visual_rects"))
    crop = c("crop").isNotNull()
    moved = F.when(crop, F.transform(protected, lambda r: g.mapped(r, c("crop.scale"), c("crop.dx"), c("crop.dy")))).otherwise(protected)
    meets = lambda region: region.isNotNull() & F.exists(moved, lambda r: g.intersects(r, region))
    clean = F.concat(c("cleanup_rects"), c("vertical_rects"), c("additional_logo_rects"), F.array_compact(F.array(c("logo_replace_rect")).cast(g.RECTS)))
    hit = F.exists(clean, lambda region: F.exists(protected, lambda r: g.intersects(r, region)))
    wanted = c("strategy") == "rebuild_crop"
    finite = reduce(lambda a, b: a & b, [~F.isnan(c(f"crop.{x}")) & (F.abs(c(f"crop.{x}")) < float("inf")) for x in ("scale", "dx", "dy")])
    clipped = F.exists(protected, lambda r: ~g.contains(c("crop.clip"), r))
    return [
        (meets(c("header_rect")), "HEADER_BODY_COLLISION_PLAN", "fatal"),
        (meets(c("footer_rect")), "FOOTER_BODY_COLLISION_PLAN", "fatal"),
        (hit, "CLEANUP_BODY_COLLISION_PLAN", "fatal"),
        (wanted & ~crop, "CROP_MAPPING_MISSING", "fatal"),
        (wanted & crop & ~finite, "CROP_MAPPING_INVALID", "fatal"),
        (wanted & crop & finite & clipped, "CROP_CONTENT_CLIPPED", "fatal"),
    ]


def audit(plans: DataFrame, source_words: DataFrame, output_words: DataFrame, output_pages: DataFrame, facts: DataFrame, bands: DataFrame, terms: list[str], side_terms: list[str]) -> DataFrame:
    """Issues (doc, page, code, severity) of all pages.

    plans: page_plan rows with doc, page, vertical_rects, protected_text_rects,
    protected_visual_rects and crop (null: none). output_pages: (doc, page,
    width, height). facts: (doc, page) with what decoders reported:
    unsafe_image_cleanup, ocr_checked, ocr_error, ocr_unsafe, output_ocr_error,
    output_ocr_hits, render_size_ok, render_error, body_pixels, body_change, region_change,
    logo_left, logo_template, logo_error, source_text_error, position_error. bands: (doc, footer_top,
    footer_confidence).
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    designed = c("page_strategy").isin(*DESIGNED)
    checked = yes(c("ocr_checked"))
    planned = [
        *geometry_rules(),
        (~F.coalesce(c("text_ok"), F.lit(True)), "TEXT_EXTRACTION_FAILED", "error"),
        (designed & (c("header_rect").isNotNull() | (c("header_template") != "none")), "GENERIC_HEADER_ON_DESIGNED_PAGE", "fatal"),
    ]
    reported = [
        (yes(c("unsafe_image_cleanup")), "UNSAFE_SHARED_IMAGE_CLEANUP", "error"),
        (checked & c("ocr_error").isNotNull(), "RASTER_OCR_UNAVAILABLE", "error"),
        (checked & yes(c("ocr_unsafe")), "RASTER_BRAND_UNSAFE_GEOMETRY", "error"),
        (checked & c("output_ocr_error").isNotNull(), "RASTER_OCR_UNAVAILABLE", "error"),
        (checked & c("output_ocr_error").isNull() & yes(c("output_ocr_hits") > 0), "RASTER_LEGACY_TEXT_REMAINS", "error"),
        (c("source_text_error").isNotNull(), "TEXT_EXTRACTION_FAILED", "error"),
        (c("render_size_ok") == F.lit(False), "RENDER_SIZE_MISMATCH", "fatal"),
        (c("body_pixels") == 0, "NO_BODY_REGION_VERIFIED", "error"),
        (c("body_change") > MAX_BODY_CHANGE, "BODY_RENDER_CHANGED", "error"),
        (c("region_change") > MAX_REGION_CHANGE, "DIAGRAM_RENDER_CHANGED", "error"),
        (c("render_error").isNotNull(), "RENDER_VERIFICATION_FAILED", "error"),
        ((c("logo_template") >= 24) & (c("logo_left") >= 24) & (c("logo_left") / c("logo_template") > 0.08), "RASTER_LEGACY_LOGO_REMAINS", "error"),
        (c("logo_error").isNotNull(), "RASTER_LOGO_CHECK_FAILED", "error"),
        (c("position_error").isNotNull(), "BODY_POSITION_CHECK_FAILED", "error"),
    ]
    # what one table tells alone is told before it is dealt: a page is a few flags in the joins, not its plan
    protected = F.concat(c("protected_text_rects"), c("protected_visual_rects"))
    bare = (c("page_type") != "blank") & ~designed & c("footer_rect").isNull()
    pages = plans.select("doc", "page", "width", "height", "page_type", bare.alias("bare"), F.array_max(F.transform(protected, lambda r: r["y1"])).alias("lowest"), _listed(planned).alias("planned"))
    pages = pages.join(bands.select("doc", c("footer_top").alias("band_footer"), c("footer_confidence").alias("band_confidence")), "doc", "left")
    # the large ones first: what follows finds pages where they are
    pages = dealt(pages).join(dealt(facts.select("doc", "page", _listed(reported).alias("reported"))), ["doc", "page"], "left")
    pages = pages.join(dealt(output_pages.select("doc", "page", c("width").alias("out_width"), c("height").alias("out_height"))), ["doc", "page"], "left")
    pages = pages.join(dealt(body_matches(source_words, output_words, plans, terms)), ["doc", "page"], "left")
    no_footer = c("bare") & c("band_footer").isNotNull() & (c("band_confidence") >= 0.65)
    resized = (F.abs(c("width") - c("out_width")) > SIZE_TOLERANCE) | (F.abs(c("height") - c("out_height")) > SIZE_TOLERANCE)
    joined = [
        (yes(no_footer), "REPEATED_FOOTER_NOT_REPLACED", F.when(c("lowest") > c("band_footer"), "warning").otherwise("error")),
        (yes(resized), "PAGE_SIZE_CHANGED", "fatal"),
        (c("retention") < MIN_RETENTION, "BODY_TEXT_LOSS", "error"),
        (c("retention").isNull() & (c("page_type") != "blank"), "BODY_TEXT_UNAVAILABLE", "info"),
        (c("shift") > MAX_SHIFT, "BODY_POSITION_SHIFT", "error"),
    ]
    none = F.array().cast("array<struct<code:string,severity:string>>")
    found = [pages.select("doc", "page", F.inline(F.concat("planned", F.coalesce("reported", none), _listed(joined))))]
    if terms:
        has_term = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower("text"), t))
        remains = output_words.filter(has_term).select("doc", "page").distinct()
        found.append(_issue(remains, F.lit(True), "LEGACY_TEXT_REMAINS", "error"))
    if side_terms:
        has_side = F.exists(F.array(*[F.lit(t.lower()) for t in side_terms]), lambda t: F.contains(F.lower("text"), t))
        sides = output_words.filter(has_side).select("doc", "page", "x0", "x1").join(output_pages.select("doc", "page", "width"), ["doc", "page"]).filter((c("x1") <= SIDE_WIDTH) | (c("x0") >= c("width") - SIDE_WIDTH))
        found.append(_issue(sides.select("doc", "page").distinct(), F.lit(True), "VERTICAL_LEGACY_TEXT_REMAINS", "warning"))
    return reduce(DataFrame.unionByName, found)


def document_issues(sources: DataFrame) -> DataFrame:
    """sources: (doc, opened, source_pages, output_pages) -> issues without page."""
    rows = sources.withColumn("page", F.lit(None).cast("int"))
    failed = _issue(rows, ~F.col("opened"), "OUTPUT_OPEN_FAILED", "fatal")
    return failed.unionByName(_issue(rows, F.col("opened") & (F.col("source_pages") != F.col("output_pages")), "PAGE_COUNT_CHANGED", "fatal"))


def report(pages: DataFrame, issues: DataFrame, kept: DataFrame, shifts: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """pages: (doc, page, page_strategy); kept: (doc, page, retention); shifts:
    (doc, page, shift, checks); changes: (doc, page, change) -> one row a
    document: passed, pages, mean retention of pages with words (null: none),
    largest shift and its checks, largest share of changed pixels (0 without
    any), issue counts and pages by strategy."""
    bad = issues.groupBy("doc").agg(F.bool_or(F.col("severity").isin("error", "fatal")).alias("bad"), F.count(F.lit(1)).alias("issues"))
    means = kept.groupBy("doc").agg(F.avg("retention").alias("average_retention"), F.count(F.lit(1)).alias("retention_pages"))
    by = pages.select("doc", "page_strategy").repartition("doc").groupBy("doc", "page_strategy").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.sum("n").alias("pages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_strategy", "n")))).alias("strategies"))
    out = by.join(bad, "doc", "left").join(means, "doc", "left")
    none = pages.select("doc").limit(0)
    moved = shifts.groupBy("doc").agg(F.max("shift").alias("max_shift"), F.sum("checks").alias("shift_checks")) if shifts is not None else none.withColumns({"max_shift": F.lit(None).cast("double"), "shift_checks": F.lit(None).cast("long")})
    changed = changes.groupBy("doc").agg(F.max("change").alias("max_change")) if changes is not None else none.withColumn("max_change", F.lit(None).cast("double"))
    out = out.join(moved, "doc", "left").join(changed, "doc", "left")
    zero = lambda x, v: F.coalesce(x, F.lit(v)).alias(x)
    return out.select("doc", (~F.coalesce(F.col("bad"), F.lit(False))).alias("passed"), "pages", "average_retention", zero("retention_pages", 0), zero("max_shift", 0.0), zero("shift_checks", 0), zero("max_change", 0.0), zero("issues", 0), "strategies")


def pixel_change(pixels: DataFrame, keys: list[str], tolerance: int = PIXEL_TOLERANCE) -> DataFrame:
    """pixels: (keys, r0, g0, b0, r1, g1, b1, masked) -> share of unmasked pixels
    one of whose channels differs by more than the tolerance."""
    delta = F.greatest(*[F.abs(F.col(f"{x}0") - F.col(f"{x}1")) for x in "rgb"])
    return pixels.filter(~F.col("masked")).groupBy(*keys).agg((F.count_if(delta > tolerance) / F.count(F.lit(1))).alias("change"), F.count(F.lit(1)).alias("pixels"))
