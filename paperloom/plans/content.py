"""What a page holds: content, remains of an old header, and what must stay.

Elements are tables with a row each, all of them with doc and page: words and
lines of text, blocks (with their largest font size), drawings, images. Facts
of a document (subject, class_name, chapter, material_type) and its bands are a
row a document. Every join is on document and page, and no page meets another.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.text import norm, repeat_signature
from ..operators.clusters import gap_clusters
from ..operators.joins import dealt
from ..operators.rects import merged_rects
from .page_plan import Layout, page_type, plan_pages

PAGE = ["doc", "page"]
BOX = ["x0", "y0", "x1", "y1"]

# Boilerplate of old publications, and the names of their courses.
BOILERPLATE, BOILERPLATE_CHARS = ("module", "foundation"), 80
COURSE = r"\bncert\s+(?:basics|course)\s*:?\s*class\s*\d+\b"
PAGE_NUMBER = r"^(?:\[?\d+\]?|page\s+\d+)$"
# Parts of a page's height or width.
TOP_ZONE, HEADER_ZONE, MARK_ZONE = 0.16, 0.20, 0.34
# How far an old mark may reach around the word that gave it away.
LOGO = {"pad_x": 30.0, "pad_y": 12.0, "min_width": 92.0, "min_height": 28.0, "max_width": 280.0, "max_height": 110.0}


def box(prefix: str = "") -> Column:
    return g.rect(*[F.col(prefix + c) for c in BOX])


def _any(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a text contains one of some phrases; empty ones are no phrases."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases if p], F.lit(False))


def norm_text(s: str) -> str:
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s.lower()).split())


def _labels(text: Column) -> Column:
    """Whether a normalised text is just the subject or the class."""
    return (text == norm(F.col("subject"))) | (text == F.concat(F.lit("class "), F.col("class_name"))) | (text == F.col("class_name"))


def headerish(text: Column, terms: Sequence[str]) -> Column:
    """Whether a normalised text, beside subject and class_name, is of a kind
    that headers have: nothing, a publisher's name, a label, a page number,
    short boilerplate."""
    short = F.length(text) < BOILERPLATE_CHARS
    known = (text == "") | _any(text, [norm_text(t) for t in terms]) | _labels(text) | F.startswith(text, F.lit("page ")) | (_any(text, BOILERPLATE) & short)
    return F.coalesce(known, F.lit(False))


def _sheets(pages: DataFrame, *of_document: DataFrame) -> DataFrame:
    """Pages with what is known of their documents. Elements, of which there are
    many more, meet it in one join and are dealt once, by page."""
    return dealt(reduce(lambda rows, more: rows.join(more, "doc"), of_document, pages))


def academic_lines(lines: DataFrame, pages: DataFrame, facts: DataFrame, bands: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The lines (doc, page, text, vertical, x0, y0, x1, y1) that are content:
    not vertical, no repeated header or footer, nothing headerish at the top."""
    c = F.col
    rows = lines.join(_sheets(pages.select(*PAGE, "height"), facts.select("doc", "subject", "class_name"), bands.select("doc", "header_bottom", "footer_top", "header_signatures", "footer_signatures")), PAGE)
    rows = rows.withColumn("_norm", norm(c("text"))).withColumn("_sig", repeat_signature(c("text")))
    top = lambda down, part: F.greatest(c("header_bottom") + down, c("height") * part)
    repeated = F.array_contains("header_signatures", c("_sig")) & (c("y1") <= top(12, HEADER_ZONE))
    label = headerish(c("_norm"), terms) & (c("y0") <= top(20, TOP_ZONE))
    course = (c("y1") <= c("height") * TOP_ZONE) & c("_norm").rlike(COURSE)
    below = c("footer_top").isNotNull() & (c("y0") >= c("footer_top")) & (F.array_contains("footer_signatures", c("_sig")) | c("_norm").rlike(PAGE_NUMBER))
    empty = (F.trim("text") == "") | (c("x0") >= c("x1")) | (c("y0") >= c("y1"))
    left_out = reduce(lambda a, b: a | b, [F.coalesce(k, F.lit(False)) for k in (empty, c("vertical"), repeated, label, course, below)])
    return rows.filter(~left_out).select(*lines.columns)


def bounds(rects: DataFrame) -> DataFrame:
    """(doc, page, first_y, last_y) of pages that have rectangles."""
    return rects.groupBy(*PAGE).agg(F.min("y0").alias("first_y"), F.max("y1").alias("last_y"))


def wide_rules(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, y, top) of lines across 45 % of a page and more near its top
    or bottom. A higher strip at the bottom counts by its upper edge."""
    c = F.col
    rows = drawings.join(pages.select(*PAGE, "width", "height"), PAGE)
    wide, high, middle = c("x1") - c("x0"), c("y1") - c("y0"), (c("y0") + c("y1")) / 2
    rows = rows.filter(wide >= c("width") * 0.45)
    upper = F.when((high <= 16) & (middle >= 4) & (middle <= c("height") * 0.28), middle)
    low = c("height") * 0.78
    strip = (high > 16) & (high <= 48) & (c("y0") >= low) & (wide >= c("width") * 0.60)
    lower = F.when((high <= 16) & (middle >= low) & (middle <= c("height") - 2), middle).when(strip, c("y0"))
    ends = F.array(F.struct(upper.alias("y"), F.lit(True).alias("top")), F.struct(lower.alias("y"), F.lit(False).alias("top")))
    return rows.select(*PAGE, F.inline(ends)).filter("y IS NOT NULL")


def row_marks(pixels: DataFrame, least: float = 0.50) -> DataFrame:
    """pixels: (doc, page, row, r, g, b), the sampled ones of a zone. (doc, page,
    row, share) of rows most of whose pixels are not white. Sums combine before
    the shuffle."""
    low, high = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    inked = (low < 246) | (high - low > 10)
    marked = pixels.groupBy(*PAGE, "row").agg(F.avg(F.when(inked, 1.0).otherwise(0.0)).alias("share"))
    return marked.filter(F.col("share") >= least)


def visual_bands(marks: DataFrame, zoom: float, top: Column, least_height: float = 0.7) -> DataFrame:
    """marks: (doc, page, row, share, ...). (doc, page, y, bottom, strength) of
    runs of marked rows with gaps of one row at most; top is the y of row 0."""
    found = gap_clusters(marks.withColumn("_top", top), PAGE, "row", F.lit(2))
    runs = found.groupBy(*PAGE, "cluster").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.avg("share").alias("strength"), F.first("_top").alias("t"))
    y, bottom = F.col("t") + F.col("a") / zoom, F.col("t") + (F.col("b") + 1) / zoom
    return runs.select(*PAGE, y.alias("y"), bottom.alias("bottom"), "strength").filter(F.col("bottom") - F.col("y") >= least_height)


def structural_headers(blocks: DataFrame, pages: DataFrame, facts: DataFrame, bands: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc, page) of pages that carry the document's repeated header itself:
    more than a publisher's name, the subject or the class."""
    c = F.col
    rows = blocks.join(pages.select(*PAGE, "height"), PAGE).filter(c("y1") <= c("height") * HEADER_ZONE)
    rows = rows.join(facts.select("doc", "subject", "class_name"), "doc").join(bands.select("doc", "header_signatures"), "doc").withColumn("_norm", norm(c("text")))
    known = F.array_contains("header_signatures", repeat_signature(c("text"))) & (F.length("_norm") >= 8)
    weak = _any(c("_norm"), [norm_text(t) for t in terms]) | F.coalesce(_labels(c("_norm")), F.lit(False))
    return rows.filter(known & ~weak).select(*PAGE).distinct()


def title_metrics(blocks: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """For each page the block in the largest font that holds the chapter's name,
    the first of equals: (doc, page, title_found, title_font, title_y0,
    title_width_ratio)."""
    c = F.col
    rows = blocks.join(facts.select("doc", norm(c("chapter")).alias("_chapter")), "doc").filter((c("_chapter") != "") & F.contains(norm(c("text")), c("_chapter")))
    best = rows.groupBy(*PAGE).agg(F.max_by(F.struct("size", "y0", F.greatest(F.lit(0.0), c("x1") - c("x0")).alias("wide")), F.struct("size", F.negative("nth"))).alias("_b"))
    out = pages.select(*PAGE, "width", "height").join(best, PAGE, "left")
    return out.select(*PAGE, c("_b").isNotNull().alias("title_found"), F.coalesce("_b.size", F.lit(0.0)).alias("title_font"), F.coalesce("_b.y0", "height").alias("title_y0"), F.coalesce(c("_b.wide") / F.greatest(c("width"), F.lit(1.0)), F.lit(0.0)).alias("title_width_ratio"))


def verified_marks(images: DataFrame, digests: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, in_footer, x0, y0, x1, y1) of images whose digest is in a
    catalogue, digests (digest), and that lie inside the band at the top or at
    the bottom; 4 points are added around them."""
    c = F.col
    rows = images.join(digests.select("digest").distinct(), "digest", "left_semi").join(pages.select(*PAGE, "width", "height"), PAGE)
    zero = F.lit(0.0)
    header = g.rect(zero, zero, c("width"), F.least(F.lit(140.0), c("height") * 0.17))
    footer = g.rect(zero, c("height") - F.least(F.lit(90.0), c("height") * 0.13), c("width"), c("height"))
    rows = rows.withColumn("in_footer", g.contains(footer, box())).filter(c("in_footer") | g.contains(header, box()))
    return rows.select(*PAGE, "in_footer", *_padded(4.0))


def _padded(by: float) -> list[Column]:
    """The box grown, inside its page."""
    c, zero = F.col, F.lit(0.0)
    return [F.greatest(zero, c("x0") - by).alias("x0"), F.greatest(zero, c("y0") - by).alias("y0"), F.least(c("width"), c("x1") + by).alias("x1"), F.least(c("height"), c("y1") + by).alias("y1")]


def term_hits(words: DataFrame, pages: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Words (doc, page, hit, x0, y0, x1, y1) in the upper third that hold one of
    the terms; hit numbers those of a page, by box and text."""
    held = words.filter(_any(F.lower("text"), [t.lower() for t in terms])).join(pages.select(*PAGE, "height"), PAGE)
    return held.filter(F.col("y0") <= F.col("height") * MARK_ZONE).select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy(*BOX, "text")).alias("hit"), *BOX)


def expanded_hits(hits: DataFrame, blocks: DataFrame, drawings: DataFrame, images: DataFrame, pages: DataFrame, terms: Sequence[str], logo: dict[str, float] = LOGO) -> DataFrame:
    """hits (doc, page, hit, box) grown to the artwork around them: fragments of
    the name, drawings and images nearby, within limits of size, and never
    beyond the upper third of the page."""
    c = F.col
    size = pages.select(*PAGE, "width", "height").withColumn("max_w", F.least(c("width") * 0.48, F.lit(logo["max_width"]))).withColumn("max_h", F.least(c("height") * 0.16, F.lit(logo["max_height"]))).withColumn("zone", c("height") * MARK_ZONE)
    text = norm(c("text"))
    parts = [
        blocks.filter(_any(text, [norm_text(t) for t in terms]) | (F.length(text) <= 2)).select(*PAGE, *BOX, F.lit(4.0).alias("reach"), F.lit(True).alias("any_height")),
        drawings.select(*PAGE, *BOX, F.lit(5.0).alias("reach"), F.lit(False).alias("any_height")),
        images.select(*PAGE, *BOX, F.lit(6.0).alias("reach"), F.lit(False).alias("any_height")),
    ]
    parts = reduce(DataFrame.unionByName, parts).join(size, PAGE)
    parts = parts.filter((c("y0") <= c("zone")) & (c("x1") - c("x0") <= c("max_w")) & (c("any_height") | (c("y1") - c("y0") <= c("max_h")))).select(*PAGE, "reach", *[c(x).alias(f"p_{x}") for x in BOX])
    zero = F.lit(0.0)
    rows = hits.join(size, PAGE)
    near = g.rect(F.greatest(zero, c("x0") - logo["pad_x"]), F.greatest(zero, c("y0") - logo["pad_y"]), F.least(c("width"), c("x1") + logo["pad_x"]), F.least(c("zone"), c("y1") + logo["pad_y"]))
    around = g.rect(c("near.x0") - c("reach"), c("near.y0") - c("reach"), c("near.x1") + c("reach"), c("near.y1") + c("reach"))
    met = rows.withColumn("near", near).join(parts, PAGE).filter(g.intersects(around, box("p_")))
    grown = met.groupBy(*PAGE, "hit").agg(*[(F.min if x[1] == "0" else F.max)(f"p_{x}").alias(f"p_{x}") for x in BOX])
    rows = rows.join(grown, [*PAGE, "hit"], "left")
    rows = rows.select(*PAGE, "hit", "width", "zone", "max_w", "max_h", *[(F.least if x[1] == "0" else F.greatest)(c(x), c(f"p_{x}")).alias(x) for x in BOX])
    w = F.least(F.greatest(c("x1") - c("x0") + 8, F.lit(logo["min_width"])), c("max_w"))
    h = F.least(F.greatest(c("y1") - c("y0") + 6, F.lit(logo["min_height"])), c("max_h"))
    x, y = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    return rows.select(*PAGE, "hit", F.greatest(zero, x - w / 2).alias("x0"), F.greatest(zero, y - h / 2).alias("y0"), F.least(c("width"), x + w / 2).alias("x1"), F.least(c("zone"), y + h / 2).alias("y1"))


def margin_text(blocks: DataFrame, pages: DataFrame, terms: Sequence[str], side: float = 68.0) -> DataFrame:
    """(doc, page, x0, y0, x1, y1) of old text along the sides, 2 points added:
    blocks (with vertical) that run upwards, or that hold one of the terms and
    are tall and narrow. With terms, short blocks without one are left alone."""
    c = F.col
    rows = blocks.join(pages.select(*PAGE, "width", "height"), PAGE)
    rows = rows.filter((c("x0") < c("x1")) & (c("y0") < c("y1")) & ((c("x1") <= side) | (c("x0") >= c("width") - side)))
    names = [n for n in map(norm_text, terms) if n]
    rows = rows.withColumn("_norm", norm(c("text"))).withColumn("_named", _any(c("_norm"), names))
    tall = c("y1") - c("y0") >= F.greatest(F.lit(36.0), (c("x1") - c("x0")) * 2.2)
    fits = c("vertical") | (c("_named") & tall)
    if names:
        fits &= c("_named") | (F.length("_norm") >= 12)
    return rows.filter(fits).select(*PAGE, *_padded(2.0))


def _regions(rects: DataFrame, name: str) -> DataFrame:
    """(doc, page, name): the page's rectangles, in order."""
    return rects.groupBy(*PAGE).agg(F.array_sort(F.collect_list(box())).cast(g.RECTS).alias(name))


def protected_text(lines: DataFrame, excluded: DataFrame) -> DataFrame:
    """Content lines that no excluded rectangle of their page contains."""
    rows = lines.join(dealt(_regions(excluded, "_out")), PAGE, "left")
    inside = F.exists(F.coalesce("_out", g.no_rects()), lambda r: g.contains(r, box()))
    return rows.filter(~inside).select(*PAGE, *BOX)


def protected_visual(drawings: DataFrame, images: DataFrame, pages: DataFrame, facts: DataFrame, bands: DataFrame, excluded: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(doc, page, x0, y0, x1, y1): drawings (with stroke, the line's width) and
    images, without backgrounds, verified bands, the first page's old artwork
    and whatever lies in excluded rectangles."""
    c = F.col
    zero = F.lit(0.0)
    drawn = drawings.select(*PAGE, *BOX, F.greatest(F.lit(0.5), F.coalesce("stroke", F.lit(0.0)) / 2).alias("pad"), F.lit(True).alias("drawn"))
    shown = images.select(*PAGE, *BOX, zero.alias("pad"), F.lit(False).alias("drawn"))
    sheets = _sheets(pages.select(*PAGE, "width", "height"), facts.select("doc", "material_type"), bands.select("doc", "header_bottom", "footer_top", "header_confidence", "footer_confidence"))
    rows = drawn.unionByName(shown).join(sheets, PAGE).join(dealt(_regions(excluded, "_out")), PAGE, "left")
    whole = g.rect(zero, zero, c("width"), c("height"))
    clipped = g.intersection(box(), whole)
    rows = rows.withColumn("r", g.intersection(g.rect(clipped["x0"] - c("pad"), clipped["y0"] - c("pad"), clipped["x1"] + c("pad"), clipped["y1"] + c("pad")), whole)).filter(~g.is_empty(c("r")))
    wide, high = c("r.x1") - c("r.x0"), c("r.y1") - c("r.y0")
    background = (wide >= c("width") * 0.80) & (high >= c("height") * 0.80)
    header = (wide >= c("width") * 0.45) & (high <= 45) & (c("header_confidence") >= 0.65) & (c("r.y1") <= c("header_bottom") + 3)
    footer = (wide >= c("width") * 0.60) & (high <= 60) & (c("footer_confidence") >= 0.65) & c("footer_top").isNotNull() & (c("r.y0") >= c("footer_top") - 3)
    target = F.element_at(F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v))]), c("material_type")) if targets else F.lit(None).cast("double")
    artwork = (c("page") == 1) & (target > 0) & (c("r.y1") <= target + 1) & (c("r.x0") >= c("width") * 0.30) & (c("r.x1") <= c("width") * 0.70) & (wide <= c("width") * 0.48) & (high <= c("height") * 0.13)
    out = F.coalesce("_out", g.no_rects())
    covered = F.exists(out, lambda x: g.contains(x, c("r")))
    dropped = reduce(lambda a, b: a | b, [F.coalesce(k, F.lit(False)) for k in (footer, c("drawn") & (background | header | F.coalesce(artwork, F.lit(False)) | covered))])
    return rows.filter(~dropped).select(*PAGE, F.explode(g.subtract(c("r"), out)).alias("r")).select(*PAGE, "r.*")


#: Where the mark of a designed page is if nothing gives it away, in parts of width and height.
DESIGNED_MARK = (0.004, 0.008, 0.18, 0.082)


def _merged(rects: DataFrame, absorb: bool) -> DataFrame:
    kinds = dict(rects.dtypes)
    found = merged_rects(rects.select(F.col("doc").cast("string"), F.col("page").cast("long"), *BOX), absorb)
    return found.select(F.col("doc").cast(kinds["doc"]), F.col("page").cast(kinds["page"]), *BOX)


def plan_elements(
    pages: DataFrame,
    facts: DataFrame,
    bands: DataFrame,
    lines: DataFrame,
    blocks: DataFrame,
    drawings: DataFrame,
    images: DataFrame,
    digests: DataFrame,
    terms: Sequence[str],
    side_terms: Sequence[str],
    layout: Layout = Layout(),
    words: DataFrame | None = None,
) -> DataFrame:
    """The plan of every page from its elements: marks and margin text are
    found, content is bounded, pages are typed and planned.

    pages: (doc, page, width, height[, dark_ratio, text_ok, image_only]); facts
    have type_confidence; words tell where the terms are (default: lines).
    Beside plan_pages' columns, a row has protected_text_rects and
    protected_visual_rects, which the audit reads.
    """
    c = F.col
    given = {"dark_ratio": F.lit(0.0), "text_ok": F.lit(True), "image_only": F.lit(False)}
    pages = pages.withColumns({k: v for k, v in given.items() if k not in pages.columns})
    hits = term_hits(lines if words is None else words, pages, terms)
    marks = verified_marks(images, digests, pages)
    searched = _merged(expanded_hits(hits, blocks, drawings, images, pages, terms), absorb=False)
    legacy = _merged(searched.unionByName(marks.filter("NOT in_footer").drop("in_footer")), absorb=True)
    footer = _merged(marks.filter("in_footer").drop("in_footer"), absorb=True)
    vertical = margin_text(blocks, pages, side_terms, 68.0)
    excluded = legacy.unionByName(footer).unionByName(vertical)
    text = protected_text(academic_lines(lines, pages, facts, bands, terms), excluded)
    visual = protected_visual(drawings, images, pages, facts, bands, excluded, layout.first_page_cleanup_targets)
    held = {"legacy_rects": legacy, "footer_legacy_rects": footer, "vertical_rects": vertical, "protected_text_rects": text, "protected_visual_rects": visual}
    rows = pages.join(facts, "doc").join(bands.withColumnRenamed("footer_top", "band_top"), "doc")
    for name, rects in held.items():
        rows = rows.join(_regions(rects, name), PAGE, "left").withColumn(name, F.coalesce(name, g.no_rects()))
    plain = lines.join(facts.select("doc", norm(c("chapter")).alias("_chapter")), "doc").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_lines"), F.bool_or((c("_chapter") != "") & F.contains(norm(c("text")), c("_chapter"))).alias("title_on_page"))
    drawn = drawings.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_drawings"))
    shown = images.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_images"), F.max(g.area(box())).alias("largest"))
    header = structural_headers(blocks, pages, facts, bands, terms).withColumn("structural_header", F.lit(True))
    for more in (bounds(text.unionByName(visual)), plain, drawn, shown, header, title_metrics(blocks, pages, facts)):
        rows = rows.join(more, PAGE, "left")
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("n_lines", "n_drawings", "n_images")}
    rows = rows.withColumns(zero | {x: F.coalesce(x, F.lit(False)) for x in ("title_on_page", "structural_header")})
    rows = rows.withColumn("large_image_ratio", F.coalesce("largest", F.lit(0.0)) / F.greatest(c("width") * c("height"), F.lit(1.0)))
    rows = rows.withColumn("blank", (c("n_lines") == 0) & (c("n_drawings") == 0) & (c("n_images") == 0))
    rows = rows.withColumn("page_type", page_type(layout)).withColumn("opener", (c("page_type") == "designed") & (c("material_type") != "KEY POINTS"))
    fallback = F.array(g.rect(*[c(side) * part for side, part in zip(("width", "height", "width", "height"), DESIGNED_MARK)])).cast(g.RECTS)
    unmarked = (c("page_type") == "designed") & (c("material_type") == "KEY POINTS") & ~c("opener") & (F.size("legacy_rects") == 0)
    rows = rows.withColumn("legacy_rects", F.when(unmarked, fallback).otherwise(c("legacy_rects")))
    return plan_pages(rows.drop("largest", "n_lines", "title_on_page"), layout)
