"""Repeated header and footer bands of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import repeat_signature
from ..operators.clusters import repeated_positions
from ..operators.repeats import LEAST_SIGNATURE, sampled_pages
from ..operators.rollups import medians

HEADER_ZONE, FOOTER_ZONE = 0.22, 0.82
STRONG, LEAST_STRENGTH, MOST_SIGNATURES, MOST_CONFIDENCE = 0.60, 0.50, 16, 0.99


def _signatures(blocks: DataFrame, pages: DataFrame, zone: Column, edge: str) -> tuple[DataFrame, DataFrame]:
    """(doc, signature, support, first, middle) of text that repeats in a zone,
    and its edges as (doc, signature, y); middle is the median of a signature's."""
    inside = blocks.filter(zone).select("doc", "signature", "page", "nth", F.col(edge).alias("y"))
    signed = inside.groupBy("doc", "signature").agg(F.countDistinct("page").alias("n"), F.min(F.struct("page", "nth")).alias("first"))
    kept = signed.join(pages.select("doc", "sampled", "threshold"), "doc").filter(F.col("n") >= F.col("threshold"))
    middle = medians(inside, ["doc", "signature"], "y", "middle")
    return kept.select("doc", "signature", (F.col("n") / F.col("sampled")).alias("support"), "first").join(middle, ["doc", "signature"]), inside.select("doc", "signature", "y")


def _strong(lines: DataFrame, ends) -> DataFrame:
    """(doc, y, support): the end position among strongly supported lines, or
    among all where none is strong."""
    strong = F.when(F.col("support") >= STRONG, F.col("y"))
    return lines.groupBy("doc").agg(F.coalesce(ends(strong), ends(F.col("y"))).alias("y"), F.max("support").alias("support"))


def _text_band(signatures: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, y, support, signatures): median of all edges; the first signatures
    in order of first sight."""
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("first", "signature"))
    first = signatures.withColumn("nth", nth).filter(F.col("nth") <= MOST_SIGNATURES)
    named = first.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("nth", "signature"))).alias("s")).select("doc", F.transform("s", lambda x: x["signature"]).alias("signatures"))
    support = signatures.groupBy("doc").agg(F.max("support").alias("support"))
    middle = medians(edges.join(signatures.select("doc", "signature"), ["doc", "signature"], "left_semi"), ["doc"], "y", "y")
    return support.join(named, "doc").join(middle, "doc")


def detect_bands(pages: DataFrame, blocks: DataFrame, rules: DataFrame, bands: DataFrame) -> DataFrame:
    """One row for each document: header_bottom, footer_top (null: none),
    header_confidence, footer_confidence, header_signatures, footer_signatures.

    pages: (doc, page, height); blocks: (doc, page, nth, text, y0, y1); rules:
    (doc, page, y, top) wide lines at the top or bottom; bands: (doc, page, y,
    strength) visual bands at the bottom. Documents of one page have no bands.
    Every step groups by document: its pages are together, and nothing else is.
    """
    known = sampled_pages(pages.select("doc", "page").distinct())
    many = known.filter("n > 1")
    chosen = pages.join(many.select("doc", "first", "n"), "doc").filter((F.col("n") < 4) | (F.col("page") != F.col("first"))).select("doc", "page", "height")
    signed = blocks.withColumn("signature", repeat_signature(F.col("text"))).filter(F.length("signature") >= LEAST_SIGNATURE).join(chosen, ["doc", "page"])
    header, header_edges = _signatures(signed, many, F.col("y1") <= F.col("height") * HEADER_ZONE, "y1")
    footer, footer_edges = _signatures(signed, many, F.col("y0") >= F.col("height") * FOOTER_ZONE, "y0")
    lines = rules.join(chosen.select("doc", "page"), ["doc", "page"], "left_semi")
    top = _strong(repeated_positions(lines.filter("top"), many), F.max)
    bottom = _strong(repeated_positions(lines.filter("NOT top"), many), F.min)
    seen = bands.join(chosen.select("doc", "page"), ["doc", "page"], "left_semi")
    visual = _strong(repeated_positions(seen, many, 6.0).filter(F.col("strength") >= LEAST_STRENGTH), F.min)

    # text below a repeated rule is not a header
    header = header.join(top.select("doc", F.col("y").alias("hint")), "doc", "left").filter(F.col("hint").isNull() | (F.col("middle") <= F.col("hint") + 10))
    h, f = _text_band(header, header_edges), _text_band(footer, footer_edges)
    named = lambda df, name: df.select("doc", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "doc"])
    out = known.select("doc")
    for df, name in ((h, "h"), (f, "f"), (top, "top"), (bottom, "bottom"), (visual, "visual")):
        out = out.join(named(df, name), "doc", "left")
    zero = F.lit(0.0)
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    confidence = lambda *cs: F.least(F.lit(MOST_CONFIDENCE), F.greatest(zero, *[F.col(c) for c in cs]))
    return out.select(
        "doc",
        F.greatest(zero, F.col("h_y") + 4, F.col("top_y") + 2).alias("header_bottom"),
        F.least(F.col("f_y") - 3, F.col("bottom_y") - 2, F.col("visual_y")).alias("footer_top"),
        confidence("h_support", "top_support").alias("header_confidence"),
        confidence("f_support", "bottom_support", "visual_support").alias("footer_confidence"),
        some("h_signatures").alias("header_signatures"),
        some("f_signatures").alias("footer_signatures"),
    )
