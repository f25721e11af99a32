"""Profiles (settings of a run) and the rules that valid ones keep.

A profile is flattened to leaves, (path, kind, text, number), and each leaf is
held against the first rule of a table whose path matches. The same table works
on the driver, for one profile, and over a DataFrame of leaves of many.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import read_json


class Rule(NamedTuple):
    path: str  # an expression for the whole path; items of lists are numbered
    kind: str
    least: float = 0
    most: float = 1000


class Leaf(NamedTuple):
    path: str
    kind: str  # object, list, text, flag, number, null
    text: str | None = None
    number: float | None = None


# Colours that a profile names.
COLOURS = ("navy", "blue", "red", "gray", "white")
COLOUR, DIGEST, TEXT_CHARS = "#?[0-9a-fA-F]{6}", "[0-9a-f]{32}", 1000
# What must be there, and what its values may be. The first rule that matches a path holds.
NEEDED = ("school", "assets", "colors", "school.short_name", "school.line2", "assets.logo", *[f"colors.{c}" for c in COLOURS])
RULES = (
    Rule(r"school|assets|colors|layout|legacy|qa|legacy\.first_page_cleanup_targets", "object"),
    Rule(r"id|school\.(short_name|line2|full_name)|assets\.(logo|logo_white|ocr_eng)|legacy\.(terms|side_text_terms)\.\d+", "text"),
    Rule(r"colors\.[^.]*", "colour"),
    Rule(r"layout\.allow_rebuild_crop|legacy\.allow_designed_fallback|qa\.[^.]*_is_error", "flag"),
    Rule(r"layout\.(dark_page_threshold|designed_page_large_image_ratio|designed_page_title_top_ratio)", "number", 0, 1),
    Rule(r"qa\.[^.]*(retention|ratio)[^.]*|legacy\.designed_logo_fallback_ratio\.\d+", "number", 0, 1),
    Rule(r"layout\.[^.]*|qa\.[^.]*|legacy\.logo_(padding_[xy]|(min|max)_(width|height))|legacy\.first_page_cleanup_targets\.[^.]*", "number"),
    Rule(r"legacy\.raster_logo_digests\.\d+", "digest"),
    Rule(r"legacy\.(raster_logo_digests|side_text_terms)", "list"),
    Rule(r"legacy\.terms", "list", 1),
    Rule(r"legacy\.designed_logo_fallback_ratio", "list", 4, 4),
)
#: Values that may not fall, with their defaults; those that must rise; those above 0.
RISING = (
    (("layout.header_min_height", 42), ("layout.header_height", 54), ("layout.header_adaptive_max_height", 76)),
    (("legacy.logo_min_width", 0), ("legacy.logo_max_width", 1000)),
    (("legacy.logo_min_height", 0), ("legacy.logo_max_height", 1000)),
)
STRICT = (("legacy.designed_logo_fallback_ratio.0", "legacy.designed_logo_fallback_ratio.2"), ("legacy.designed_logo_fallback_ratio.1", "legacy.designed_logo_fallback_ratio.3"))
ABOVE_ZERO = ("layout.header_min_height",)


def leaves(value: Any, path: str = "") -> Iterator[Leaf]:
    """Everything in a profile, containers before what they hold. The number of
    a list is its length."""
    if isinstance(value, dict):
        yield Leaf(path, "object", None, float(len(value)))
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}".lstrip("."))
    elif isinstance(value, list):
        yield Leaf(path, "list", None, float(len(value)))
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}.{i}")
    elif isinstance(value, bool):
        yield Leaf(path, "flag", str(value).lower())
    elif isinstance(value, (int, float)):
        yield Leaf(path, "number", None, float(value))
    else:
        yield Leaf(path, "null" if value is None else "text", value)


def _keeps(rule: Rule, leaf: Leaf) -> bool:
    text = leaf.text or ""
    return {
        "object": lambda: leaf.kind == "object",
        "list": lambda: leaf.kind == "list" and rule.least <= leaf.number <= rule.most,
        "flag": lambda: leaf.kind == "flag",
        "number": lambda: leaf.kind == "number" and math.isfinite(leaf.number) and rule.least <= leaf.number <= rule.most,
        "text": lambda: leaf.kind == "text" and bool(text.strip()) and len(text) <= TEXT_CHARS,
        "colour": lambda: leaf.kind == "text" and re.fullmatch(COLOUR, text) is not None,
        "digest": lambda: leaf.kind == "text" and re.fullmatch(DIGEST, text) is not None,
    }[rule.kind]()


def profile_errors(raw: Any) -> list[str]:
    """Every rule that a profile breaks; empty if it is valid."""
    if not isinstance(raw, dict):
        return ["a profile is an object"]
    found = {leaf.path: leaf for leaf in leaves(raw)}
    out = [f"{path} is missing" for path in NEEDED if path not in found]
    for leaf in found.values():
        rule = next((r for r in RULES if re.fullmatch(r.path, leaf.path)), None)
        if rule and not _keeps(rule, leaf):
            out.append(f"{leaf.path} must be {rule.kind} within {rule.least:g} and {rule.most:g}")
    number = lambda path, default: found[path].number if path in found and found[path].kind == "number" else default
    for chain in RISING:
        values = [number(*x) for x in chain]
        if any(a > b for a, b in zip(values, values[1:])) or any(path in ABOVE_ZERO and v <= 0 for (path, _), v in zip(chain, values)):
            out.append(" <= ".join(path for path, _ in chain) + " does not hold")
    out += [f"{a} < {b} does not hold" for a, b in STRICT if a in found and b in found and not number(a, 0) < number(b, 1)]
    return out


def load_profile(path: str) -> dict:
    raw = read_json(path)
    wrong = profile_errors(raw)
    if wrong:
        raise ValueError("; ".join(wrong))
    return raw


def leaf_rows(spark: SparkSession, profiles: dict[str, Any]) -> DataFrame:
    rows = [(name, *leaf) for name, raw in profiles.items() for leaf in leaves(raw)]
    return spark.createDataFrame(rows, "profile string, path string, kind string, text string, number double")


def checked(rows: DataFrame) -> DataFrame:
    """Leaves with rule (the kind that is asked for, null: no rule) and ok. One
    pass over the rows; the table of rules is in the expression."""
    c = F.col
    fits = {
        "object": lambda r: c("kind") == "object",
        "list": lambda r: (c("kind") == "list") & c("number").between(r.least, r.most),
        "flag": lambda r: c("kind") == "flag",
        "number": lambda r: (c("kind") == "number") & ~F.isnan("number") & c("number").between(r.least, r.most),
        "text": lambda r: (c("kind") == "text") & (F.trim("text") != "") & (F.length("text") <= TEXT_CHARS),
        "colour": lambda r: (c("kind") == "text") & c("text").rlike(f"^{COLOUR}$"),
        "digest": lambda r: (c("kind") == "text") & c("text").rlike(f"^{DIGEST}$"),
    }

    def first(value) -> Column:
        out = F.lit(None)
        for rule in reversed(RULES):
            out = F.when(c("path").rlike(f"^(?:{rule.path})$"), value(rule)).otherwise(out)
        return out

    ok = first(lambda r: F.coalesce(fits[r.kind](r), F.lit(False)))
    return rows.withColumns({"rule": first(lambda r: F.lit(r.kind)).cast("string"), "ok": F.coalesce(ok.cast("boolean"), F.lit(True))})
