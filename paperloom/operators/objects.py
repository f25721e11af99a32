"""Objects of a document that refer to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Written
from .regions import authorised

#: Rounds after which what was found is written as one table again.
ROUNDS_A_TABLE = 16


def reachable(references: DataFrame, start: DataFrame, keys: Sequence[str] = ("doc",)) -> DataFrame:
    """references: (keys, object, target); start: (keys, object). (keys, object)
    of all objects that references lead to, the start included.

    Semi-naive rounds: only what the last round found for the first time looks
    for more, so cycles end and no way is walked twice. A round is a written
    table; objects that very many others refer to come once, for targets are
    made distinct, and combine, before their shuffle."""
    at = [*keys, "object"]
    frontier = Written(start.select(*at).distinct(), "reached")
    found = [frontier]
    while not frontier.df.isEmpty():
        seen = found[0].df
        for f in found[1:]:
            seen = seen.unionByName(f.df)
        targets = references.join(frontier.df, at, "left_semi").select(*keys, F.col("target").alias("object")).distinct()
        frontier = Written(targets.filter(F.col("object").isNotNull()).join(seen, at, "left_anti"), "reached")
        found.append(frontier)
        if len(found) > ROUNDS_A_TABLE:
            whole = Written(seen.unionByName(frontier.df), "reached")
            for f in found[:-1]:
                f.drop()
            found = [whole]
    out = found[0].df
    for f in found[1:]:
        out = out.unionByName(f.df)
    return out


def removable_images(occurrences: DataFrame, regions: DataFrame, masks: DataFrame, references: DataFrame, appearances: DataFrame) -> DataFrame:
    """occurrences: (doc, page, image, x0, y0, x1, y1); regions: (doc, page, x0,
    y0, x1, y1); masks: (doc, image), images that are another's soft mask;
    references: (doc, object, target); appearances: (doc, object), what
    annotations are drawn with.

    (doc, image) of images whose every use is inside a region: they are painted,
    on no other place, mask no image, and no appearance leads to them. Empty
    occurrences are in no region."""
    empty = (F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1"))
    loose = occurrences.filter(empty).select("doc", "image").distinct()
    inside = authorised(occurrences, regions).join(loose, ["doc", "image"], "left_anti")
    drawn = reachable(references, appearances).select("doc", F.col("object").alias("image"))
    return inside.join(masks.select("doc", "image").distinct(), ["doc", "image"], "left_anti").join(drawn, ["doc", "image"], "left_anti")
