"""Scalar text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the classification contract.
CLASS_PATTERNS = (
    r"(?:class|std|standard|grade)[ _-]*(6|7|8|9|10)\b",
    r"\b(6|7|8|9|10)(?:th|st|nd|rd)?[ _-]+(?:class|std|standard|grade)\b",
    r"^(6|7|8|9|10)(?:th|st|nd|rd)?$",
)
DURATION = r"(?i)(?:Time|Estimate\s*Time)\s*[:\-]?\s*(\d+\s*(?:minutes?|mins?|hours?|hrs?))"
MARKS = r"(?i)(?:Maximum\s*Marks|Max\.?\s*Marks|Marks)\s*[:\-]?\s*(\d+)"
CHAPTER = r"^\s*(\d+)\s+(.*)$"


def norm(c: Column) -> Column:
    """Lower case; every run of anything but a-z and 0-9 is one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def padded_norm(c: Column) -> Column:
    return F.concat(F.lit(" "), norm(c), F.lit(" "))


def repeat_signature(c: Column) -> Column:
    """norm with every number as '#'. (A rule for 'page #' can never apply to
    normalised text, so there is none.)"""
    return F.trim(F.regexp_replace(norm(c), r"\b\d+\b", "#"))


def strip_chapter_number(c: Column) -> Column:
    return F.trim(F.regexp_replace(norm(c), r"^\d+\s+", ""))


def _or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def chapter_name(c: Column) -> Column:
    """The name after a leading number, or all of it."""
    return F.when(c.rlike(CHAPTER), F.trim(F.regexp_extract(c, CHAPTER, 2))).otherwise(F.trim(c))


def chapter_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, CHAPTER, 1), F.lit(""))


def duration(c: Column) -> Column:
    return _or_null(F.regexp_extract(c, DURATION, 1))


def max_marks(c: Column) -> Column:
    return _or_null(F.regexp_extract(c, MARKS, 1))


def class_number(c: Column) -> Column:
    """The school class that a folder name states, by the first pattern that matches."""
    n = norm(c)
    return F.coalesce(*[F.nullif(F.regexp_extract(n, p, 1), F.lit("")) for p in CLASS_PATTERNS])


def word_tokens(c: Column, left_out: Column | None = None) -> Column:
    """Words of letters and digits in lower case, without those of an array."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return words if left_out is None else F.filter(words, lambda w: ~F.array_contains(left_out, w))


def brand_token(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def spans_text(spans: Column) -> Column:
    """Texts of a block's spans, joined by spaces."""
    return F.trim(F.array_join(F.transform(spans, lambda s: s["text"]), " "))


def line_text(spans: Column) -> Column:
    return F.trim(F.array_join(F.transform(spans, lambda s: s["text"]), ""))


def max_span_size(spans: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(spans, lambda s: s["size"].cast("double"))), F.lit(0.0))


def is_vertical(dx: Column, dy: Column) -> Column:
    return F.coalesce((F.abs(dx) < 0.25) & (F.abs(F.abs(dy) - 1) < 0.25), F.lit(False))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def hex_rgb(c: Column) -> Column:
    """#rrggbb -> struct(r, g, b) between 0 and 1; null if it is no colour."""
    digits = F.regexp_extract(c, r"^#?([0-9a-fA-F]{6})$", 1)
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("double") / 255
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def short_id(c: Column) -> Column:
    """First 20 hex digits of the hash of the lower-cased id. (Lower case, where
    full case folding would differ for a few non-ASCII letters.)"""
    return F.substring(content_hash(F.lower(c)), 1, 20)


def path_parts(c: Column) -> Column:
    """Order by this to order paths by their parts: 'a/b' before 'a b/c'."""
    return F.split(c, "/")


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(path_parts(c), -1), r"(?<=.)\.[^.]*$", "")


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounded to some digits, halves to the even neighbour. What counts as a
    half is told from the shortest decimal form of the number."""
    return F.bround(c, digits)
