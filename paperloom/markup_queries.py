"""Queries of documents in HTML: their elements, plans and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .plans import audit, bands, content
from .queries import query
from .sources import elements as el
from .sources.shared import Written
from .sources.tables import table

_PIECES = f"""
WITH cut AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is){el.NO_TEXT}', ' ', 'g'), '(?i){el.BLOCK_TAG}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS pieces FROM pages
), listed AS (
  SELECT page_id, i, CASE WHEN i = 1 THEN '' ELSE lower(split_part(pieces[i], chr(2), 1)) END AS tag, CASE WHEN i = 1 THEN pieces[i] ELSE split_part(pieces[i], chr(2), 2) END AS piece
  FROM (SELECT page_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM cut)
), told AS (
  SELECT page_id, i, tag, trim(regexp_replace(regexp_replace(piece, '{el.TAG}', '', 'g'), '{el.SPACE}', ' ', 'g'), ' ') AS raw, len(regexp_extract_all(piece, '(?i){el.LINK}')) AS links FROM listed
)"""


@query(f"{_PIECES} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth, tag, raw, links::BIGINT AS links FROM told WHERE raw <> ''")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of all pages, whatever sheets they are set on."""
    from pyspark.sql.window import Window

    found = el.page_elements(table(spark, d, "pages"), "page_id", "html").filter("kind = 'block' AND raw IS NOT NULL")
    order = Window.partitionBy("doc").orderBy("page", "nth")
    return found.select(F.col("doc").alias("page_id"), F.row_number().over(order).cast("long").alias("nth"), "tag", "raw", "links")


def planned(pages: DataFrame, id_col: str, html_col: str, terms: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, bands, plans) of documents in HTML, each written once, as
    what follows reads it many times."""
    found = Written(el.page_elements(pages, id_col, html_col), "elements").df
    box = ["x0", "y0", "x1", "y1"]
    sheets = found.filter("kind = 'line'").select("doc", "page").distinct().withColumns({"width": F.lit(el.WIDTH), "height": F.lit(el.HEIGHT)})
    lines = found.filter("kind = 'line'").select("doc", "page", "text", F.lit(False).alias("vertical"), *box)
    blocks = found.filter("kind = 'block' AND text <> ''").select("doc", "page", "text", F.lit(False).alias("vertical"), *box, "size", "nth")
    drawings = found.filter("kind = 'rule'").select("doc", "page", *box, F.lit(1.0).alias("stroke"))
    images = found.limit(0).select("doc", "page", F.lit("").alias("digest"), *box)
    none = found.limit(0).select("doc", "page", F.col("y0").alias("y"), F.lit(1.0).alias("strength"))
    repeated = Written(bands.detect_bands(sheets, blocks, content.wide_rules(drawings, sheets), none), "bands").df
    facts = sheets.select("doc").distinct().select("doc", F.lit("physics").alias("subject"), F.lit("6").alias("class_name"), F.lit("").alias("chapter"), F.lit("NOTES").alias("material_type"), F.lit(0.78).alias("type_confidence"))
    digests = found.limit(0).select(F.lit("").alias("digest"))
    plans = Written(content.plan_elements(sheets, facts, repeated, lines, blocks, drawings, images, digests, terms, []), "plans").df
    return found, repeated, plans


def audited(pages: DataFrame, id_col: str, html_col: str, terms: list[str], lost) -> DataFrame:
    """(doc, page, page_strategy, footer, codes): the plan of each sheet, and
    the issues of an output that has all lines but those that `lost` holds for."""
    found, repeated, plans = planned(pages, id_col, html_col, terms)
    kind = f"struct<clip:{g.RECT},scale:double,dx:double,dy:double>"
    plans = plans.withColumn("crop", F.lit(None).cast(kind))
    words = found.filter("kind = 'line'").select("doc", "page", "x0", "y0", "x1", "y1", "text")
    sizes = plans.select("doc", "page", "width", "height")
    said = {"unsafe_image_cleanup": "false", "ocr_checked": "false", "ocr_error": "string", "ocr_unsafe": "false", "output_ocr_error": "string", "output_ocr_hits": "0", "render_size_ok": "true", "render_error": "string", "body_pixels": "1", "body_change": "0.0D", "region_change": "0.0D", "logo_left": "0", "logo_template": "0", "logo_error": "string", "source_text_error": "string", "position_error": "string"}
    facts = sizes.select("doc", "page", *[F.expr("CAST(NULL AS STRING)" if v == "string" else v).alias(k) for k, v in said.items()])
    issues = audit.audit(plans, words, words.filter(~lost), sizes, facts, repeated.select("doc", "footer_top", "footer_confidence"), terms, [])
    codes = issues.groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    told = plans.select("doc", "page", "page_strategy", F.col("footer_rect").isNotNull().alias("footer"))
    return told.join(codes, ["doc", "page"], "left").withColumn("codes", F.coalesce("codes", F.lit("")))


@query()
def html_audit(spark: SparkSession, d: str) -> DataFrame:
    """Elements, bands, plans and audit of all pages; some outputs lose lines."""
    lost = (F.col("doc") % 7 == 0) & (F.col("y0") > 400) & (F.col("y0") < el.BOTTOM)
    return audited(table(spark, d, "pages"), "page_id", "html", [], lost)
