"""Audit of pictures: what changed outside the places that may, what is left of
an old logo, and how the field under one can be repaired.

Pictures come as rows of pixels (see operators.pixels), of a page or of a
region's crop; nothing is decoded here. Regions and rectangles are in points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import pixels as px
from ..operators.joins import dealt
from ..sources.shared import Written

PAGE = ["doc", "page"]
# Tolerances of a channel, and shares of changed pixels.
TOLERANCE, MOST_BODY_CHANGE, MOST_REGION_CHANGE = 12, 0.0005, 0.01
# Fixed values of the logo template: blur, contrast against it and against the background, frame and emblem in points.
BLUR, EDGE_CONTRAST, INK_CONTRAST, LEAST_SIDE, FRAME = 1.2, 6, 8, 8, 3.0
EMBLEM_WIDTH, EMBLEM_SHARE, EMBLEM_HALF, EMBLEM_LEAST = 58.0, 0.90, 0.45, 18
# Fixed values of the field under a logo.
FLAT_PLACE, FLAT_DISTANCE, CLOSE_DISTANCE, CLOSE_SHARE, FLAT_INSET = 0.55, 6.0, 8.0, 0.55, 8
REACH = 18


def _box(zoom: float, pad: int) -> dict[str, Column]:
    """A rectangle in whole columns and rows, ends included."""
    c = F.col
    low = lambda name: (F.floor(c(name) * zoom) - pad).cast("int")
    high = lambda name: (F.ceil(c(name) * zoom) + pad).cast("int")
    return {"xa": low("x0"), "ya": low("y0"), "xb": high("x1"), "yb": high("y1")}


def excluded_runs(rects: DataFrame, sizes: DataFrame, zoom: float) -> DataFrame:
    """rects: (doc, page, x0, y0, x1, y1); sizes: (doc, page, columns, rows).
    Runs (doc, page, y, a, b) that the rectangles cover together, one pixel of
    their edges included, inside the picture."""
    boxes = rects.join(dealt(sizes), PAGE).select(*PAGE, "columns", "rows", *[v.alias(k) for k, v in _box(zoom, 1).items()])
    inside = boxes.withColumns({"xa": F.greatest("xa", F.lit(0)), "ya": F.greatest("ya", F.lit(0)), "xb": F.least("xb", F.col("columns") - 1), "yb": F.least("yb", F.col("rows") - 1)})
    return px.union_runs(inside, PAGE)


def compared_rows(rows: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """rows: (doc, page, y, before, after). (doc, page, y, before, after, xs):
    how wide both rows are (-1: missing), and the columns that differ. Pixels are
    read once, here; what follows reads this small table, which is written."""
    keep = [*PAGE, "y"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (b, told, wide), (a, seen, wide_a) = px.matrix(batch.column("before")), px.matrix(batch.column("after"))
            n = min(b.shape[1], a.shape[1])
            differ = told[:, :n] & seen[:, :n] & (px.differing(b[:, :n], a[:, :n]) > tolerance)
            xs = px.lists(np.broadcast_to(np.arange(n), differ.shape), differ)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], xs, pa.array(wide, pa.int32()), pa.array(wide_a, pa.int32())], [*keep, "xs", "before", "after"])

    read = rows.select(*keep, "before", "after")
    schema = T.StructType([*read.select(*keep).schema.fields, T.StructField("xs", T.ArrayType(T.IntegerType())), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])
    return Written(px.bounded(read).mapInArrow(of, schema), "compared").df


def changed_pixels(compared: DataFrame) -> DataFrame:
    """(doc, page, y, x) of pixels that differ."""
    return compared.select(*PAGE, "y", F.explode("xs").alias("x"))


def picture_sizes(compared: DataFrame) -> DataFrame:
    """(doc, page, columns, rows, same): same is false where the two pictures
    have different sizes, a missing row included."""
    return compared.groupBy(*PAGE).agg(F.max(F.greatest("before", "after")).alias("columns"), (F.max("y") + 1).alias("rows"), F.bool_and(F.col("before") == F.col("after")).alias("same"))


def body_changes(rows: DataFrame, rects: DataFrame, zoom: float, tolerance: int = TOLERANCE, most: float = MOST_BODY_CHANGE) -> DataFrame:
    """(doc, page, compared, changed, ratio, code): pixels outside all
    rectangles, how many of them changed, and the error that follows, if any.
    Pictures of different sizes, or with nothing to compare, have ratio 1."""
    seen = compared_rows(rows, tolerance)
    sizes = picture_sizes(seen)
    runs = excluded_runs(rects, sizes, zoom)
    covered = runs.groupBy(*PAGE).agg(F.sum(F.col("b") - F.col("a") + 1).alias("covered"))
    changed = px.not_covered(changed_pixels(seen), runs, PAGE).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("changed"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = sizes.join(dealt(covered), PAGE, "left").join(dealt(changed), PAGE, "left").select(*PAGE, "same", (F.col("columns").cast("long") * F.col("rows") - zero(F.col("covered"))).alias("compared"), zero(F.col("changed")).alias("changed"))
    fine = F.col("same") & (F.col("compared") > 0)
    ratio = F.when(fine, F.col("changed") / F.col("compared")).otherwise(1.0)
    code = F.when(~F.col("same"), "RENDER_SIZE_MISMATCH").when(F.col("compared") == 0, "NO_BODY_REGION_VERIFIED").when(ratio > most, "BODY_RENDER_CHANGED")
    return found.select(*PAGE, "compared", "changed", ratio.alias("ratio"), code.alias("code"))


def region_changes(rows: DataFrame, rects: DataFrame, regions: DataFrame, zoom: float, tolerance: int = TOLERANCE, most: float = MOST_REGION_CHANGE) -> DataFrame:
    """regions: (doc, page, region, x0, y0, x1, y1), protected visuals. (doc,
    page, region, checked, changed, ratio, code) of those that hold a pixel
    outside all rectangles; each is judged by itself, so that a small one is not
    diluted by its page. Pages whose pictures differ in size are left out."""
    seen = compared_rows(rows, tolerance)
    sizes = picture_sizes(seen).filter("same").drop("same")
    runs = excluded_runs(rects, sizes, zoom)
    c = F.col
    edge = {k: v for k, v in _box(zoom, 0).items()}
    boxes = regions.join(dealt(sizes), PAGE).select(*PAGE, "region", F.greatest(edge["xa"], F.lit(0)).alias("xa"), F.greatest(edge["ya"], F.lit(0)).alias("ya"), F.least(edge["xb"], c("columns")).alias("xe"), F.least(edge["yb"], c("rows")).alias("ye")).filter("xa < xe AND ya < ye")
    met = boxes.join(dealt(runs), PAGE).filter((c("y") >= c("ya")) & (c("y") < c("ye")) & (c("a") < c("xe")) & (c("b") >= c("xa")))
    covered = met.groupBy(*PAGE, "region").agg(F.sum(F.least(c("b") + 1, c("xe")) - F.greatest("a", "xa")).alias("covered"))
    open_ = px.not_covered(changed_pixels(seen), runs, PAGE).join(dealt(boxes), PAGE)
    changed = open_.filter((c("y") >= c("ya")) & (c("y") < c("ye")) & (c("x") >= c("xa")) & (c("x") < c("xe"))).groupBy(*PAGE, "region").agg(F.count(F.lit(1)).alias("changed"))
    area = (c("xe") - c("xa")).cast("long") * (c("ye") - c("ya"))
    found = boxes.join(dealt(covered), [*PAGE, "region"], "left").join(dealt(changed), [*PAGE, "region"], "left").select(*PAGE, "region", (area - F.coalesce("covered", F.lit(0))).alias("checked"), F.coalesce("changed", F.lit(0)).alias("changed"))
    ratio = c("changed") / c("checked")
    return found.filter("checked > 0").select(*PAGE, "region", "checked", "changed", ratio.alias("ratio"), F.when(ratio > most, "DIAGRAM_RENDER_CHANGED").alias("code"))


def logo_residual(rows: DataFrame, regions: DataFrame, keys: Sequence[str], zoom: float = 2.0) -> DataFrame:
    """rows: (keys, y, before, after, ink), crops of old logos before and after
    their repair; ink (array of booleans, null: unknown) marks a logo's own
    pixels where its mask is known. regions: (keys, width, height in points,
    r, g, b of the background from 0 to 255, px_height, emblem, moved).

    (keys, residual, template): pixels of the old logo's edges, outside the
    frame and the new emblem, and those of them that are still there. Regions
    that are small, or that moved, have none."""
    facts = ["width", "height", "r", "g", "b", "px_height", "emblem", "moved"]
    pixels = ["before", "after", "ink"]
    halo = px.box_weights(px.box_radius(BLUR, 3))[0] * 3
    known = [F.col(k).isNotNull() for k in keys]
    for k in known:
        rows, regions = rows.filter(k), regions.filter(k)
    # a region goes before its rows, which follow by tile; both are dealt by the keys, once
    first = regions.select(*keys, *facts, F.lit(True).alias("_region"))
    dealt_rows = px.tiled(rows.select(*keys, "y", *pixels), halo).withColumn("_region", F.lit(False))
    both = dealt_rows.unionByName(first, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, F.col("_region").desc(), "_tile", "y")
    inset = int(FRAME * zoom)
    group = [*keys, "_tile"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def region_of(t: pa.Table) -> pa.Table:
            at = np.flatnonzero(t.column("_region").to_numpy())
            return t.slice(at[-1], 1) if len(at) else t.slice(0, 0)

        for t in px.whole_groups(batches, group, region_of):
            key = np.cumsum(px.changes(t, keys))
            is_region = t.column("_region").to_numpy()
            at = np.maximum.accumulate(np.where(is_region, np.arange(len(key)), -1))
            y, tile = [t.column(n).cast("double").to_numpy() for n in ("y", "_tile")]
            given = ~is_region & (at >= 0) & (key[at] == key)
            if not given.any():
                continue
            of_row = lambda n, none=0.0: t.column(n).cast("double").fill_null(none).to_numpy()[at][given][:, None]
            width, height, h, emblem, moved = of_row("width"), of_row("height"), of_row("px_height"), of_row("emblem", 1.0) > 0, of_row("moved", 1.0) > 0
            background = (of_row("r") * 65536 + of_row("g") * 256 + of_row("b")).astype(np.int64)
            t = t.filter(pa.array(given)).combine_chunks()
            p, valid, sizes = px.matrix(px.one(t, "before"))
            soft, fine = px.blur(p, valid, sizes, np.cumsum(px.changes(t, group)), BLUR, 3)
            x, y, w = np.arange(p.shape[1]), y[given][:, None], sizes[:, None]
            logo = np.minimum(width * EMBLEM_SHARE, EMBLEM_WIDTH)
            half = np.minimum(height * EMBLEM_HALF, np.maximum(logo / 2, EMBLEM_LEAST)) * zoom
            left, right = np.trunc(w / 2 - logo * zoom / 2 - 2), np.trunc(w / 2 + logo * zoom / 2 + 2)
            top, bottom = np.trunc(h / 2 - half - 2), np.trunc(h / 2 + half + 2)
            framed = (x >= inset) & (x <= w - inset - 1) & (y >= inset) & (y <= h - inset - 1)
            covered = emblem & (x >= left) & (x <= right) & (y >= top) & (y <= bottom)
            own = (np.floor(y / px.TILE_ROWS) == tile[given][:, None]) & (width >= LEAST_SIDE) & (height >= LEAST_SIDE) & ~moved
            edge = own & framed & ~covered & valid & fine & (px.differing(p, soft) > EDGE_CONTRAST) & (px.differing(p, background) > INK_CONTRAST)
            ink, said, _ = px.matrix(px.one(t, "ink"))
            n = min(edge.shape[1], ink.shape[1])
            edge[:, :n] &= ink[:, :n].astype(bool) | ~said[:, :n]
            after, there, _ = px.matrix(px.one(t, "after"))
            n = min(edge.shape[1], after.shape[1])
            kept = edge[:, :n] & there[:, :n] & (px.differing(p[:, :n], after[:, :n]) <= TOLERANCE)
            starts = np.flatnonzero(px.changes(t, keys))
            sums = [pa.array(np.add.reduceat(m.sum(1), starts), pa.int64()) for m in (kept, edge)]
            yield pa.RecordBatch.from_arrays([*[px.one(t, k).take(pa.array(starts)) for k in keys], *sums], [*keys, "residual", "template"])

    schema = T.StructType([*regions.select(*keys).schema.fields, T.StructField("residual", T.LongType()), T.StructField("template", T.LongType())])
    told = px.bounded(both).mapInArrow(of, schema)
    return told.groupBy(*keys).agg(F.sum("residual").alias("residual"), F.sum("template").alias("template"))


def _sides(keys: Sequence[str]) -> dict[str, Column]:
    least = F.least("px_width", "px_height")
    protect = F.greatest(F.lit(3), F.bround(least * 0.035).cast("int"))
    return {
        "probe": F.greatest(F.lit(3), F.bround(least * 0.075).cast("int")),
        "protect": protect,
        "frame_left": F.greatest(F.lit(3), protect - 1),
        "frame_right": F.greatest(protect + 4, F.bround(least * 0.055).cast("int")),
    }


def _square(pixel: Column) -> Column:
    parts = [px.channel(pixel, n) - F.col(n) for n in "rgb"]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def field_verdicts(rows: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows: (keys, y, pixels); regions: (keys, r, g, b from 0 to 255, px_width,
    px_height). (keys, flat, threshold) with the regions' columns: whether most
    of a region has its background's colour, and the distance from which a pixel
    is foreground, from the noise of its border.

    Squared distances are whole numbers and are counted once; a region costs one
    row for each distance it holds, for all that is asked of them."""
    c = F.col
    sized = regions.withColumns(_sides(keys))
    met = rows.join(dealt(sized), list(keys))
    x_edge = (c("x") < c("probe")) | (c("x") >= c("px_width") - c("probe"))
    y_edge = (c("y") < c("probe")) | (c("y") >= c("px_height") - c("probe"))
    each = met.select(*keys, *"rgb", "probe", "px_width", "px_height", "y", F.posexplode("pixels").alias("x", "p"))
    counted = each.select(*keys, _square(c("p")).alias("d2"), (y_edge | x_edge).alias("edge")).groupBy(*keys, "d2").agg(F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("n_edge"))
    # pixels of no colour have no distance, and no place among the others
    counted = counted.withColumns({m: F.when(c("d2").isNotNull(), c(n)).otherwise(0) for m, n in (("far", "n"), ("noise", "n_edge"))})
    region = Window.partitionBy(*keys)
    upto = region.orderBy("d2").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({f"{f}_{n}": F.sum(n).over(w) for n in ("far", "noise") for f, w in (("all", region), ("upto", upto))})
    place = lambda n, share: F.least(c(f"all_{n}") - 1, F.floor(c(f"all_{n}") * share)) + 1
    at = lambda n, share: F.min(F.when((c(f"all_{n}") > 0) & (c(f"upto_{n}") >= place(n, share)), c("d2"))).alias(n)
    close = (F.sum(F.when(F.sqrt("d2") <= CLOSE_DISTANCE, c("n")).otherwise(0)) / F.sum("n")).alias("close")
    told = ranked.groupBy(*keys).agg(at("far", FLAT_PLACE), at("noise", 0.5), close)
    told = sized.join(dealt(told), list(keys), "left")
    least = FLAT_INSET * 2 + 2
    flat = (c("px_width") > least) & (c("px_height") > least) & (F.sqrt("far") <= FLAT_DISTANCE) & (c("close") >= CLOSE_SHARE)
    threshold = F.greatest(F.lit(10.0), F.least(F.lit(22.0), F.sqrt(F.coalesce("noise", F.lit(0))) * 1.45 + 5.0))
    return told.select(*sized.columns, F.coalesce(flat, F.lit(False)).alias("flat"), threshold.alias("threshold"))


def field_repairs(rows: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, flat, threshold, repaired): pixels that a repair paints over. Flat
    fields are repaired up to their inset; of others, whatever lies within 18
    columns and rows of foreground, but for a protected frame.

    Foreground meets the thresholds in its own rows, which then only hold runs;
    a region's widened runs are one union of boxes."""
    c = F.col
    verdicts = Written(field_verdicts(rows, regions, keys), "verdicts").df
    pick = verdicts.filter("NOT flat")
    luma = lambda r, g, b: 0.2126 * r + 0.7152 * g + 0.0722 * b
    base = luma(c("r"), c("g"), c("b"))

    def fore(x: Column) -> Column:
        p = F.get(c("pixels"), x)
        inner = (x >= c("protect")) & (x < c("px_width") - c("protect")) & (c("y") >= c("protect")) & (c("y") < c("px_height") - c("protect"))
        bright = F.abs(luma(*[px.channel(p, n) for n in "rgb"]) - base) >= 6.0
        strong = F.greatest(*[F.abs(px.channel(p, n) - c(n)) for n in "rgb"]) >= 10
        return inner & (F.sqrt(_square(p)) >= c("threshold")) & (bright | strong)

    core = rows.join(dealt(pick), list(keys)).select(*keys, "y", "px_width", "px_height", "protect", "frame_left", "frame_right", px.columns_where(c("pixels"), fore).alias("xs"))
    runs = core.filter(F.size("xs") > 0).select("*", F.inline(px.runs_of(c("xs"))))
    wide = runs.select(
        *keys,
        F.greatest(c("a") - REACH, c("frame_left")).alias("xa"),
        F.least(c("b") + REACH, c("px_width") - c("frame_right") - 1).alias("xb"),
        F.greatest(c("y") - REACH, c("protect")).alias("ya"),
        F.least(c("y") + REACH, c("px_height") - c("protect") - 1).alias("yb"),
    )
    painted = px.union_runs(wide, keys).groupBy(*keys).agg(F.sum(c("b") - c("a") + 1).alias("painted"))
    inside = lambda n: c(n).cast("long") - 2 * FLAT_INSET
    repaired = F.when(c("flat"), inside("px_width") * inside("px_height")).otherwise(F.coalesce("painted", F.lit(0).cast("long")))
    return verdicts.join(dealt(painted), list(keys), "left").select(*keys, "flat", "threshold", repaired.alias("repaired"))


def rendered_facts(body: DataFrame, regions: DataFrame, logos: DataFrame) -> DataFrame:
    """body: of body_changes; regions: of region_changes; logos: (doc, page,
    residual, template) of logo_residual. What the audit asks of pictures: (doc,
    page, render_size_ok, body_pixels, body_change, region_change, logo_left,
    logo_template), the worst region and logo of each page. Of pictures that
    differ in size, or that have nothing to compare, that alone is told."""
    c = F.col
    told = c("code").isNull() | (c("code") == "BODY_RENDER_CHANGED")
    size_ok = F.coalesce(c("code") != "RENDER_SIZE_MISMATCH", F.lit(True))
    pages = body.select(*PAGE, size_ok.alias("render_size_ok"), F.when(size_ok, c("compared")).alias("body_pixels"), F.when(told, c("ratio")).alias("body_change"))
    worst = regions.groupBy(*PAGE).agg(F.max("ratio").alias("region_change"))
    share = c("residual") / F.greatest("template", F.lit(1))
    logo = logos.groupBy(*PAGE).agg(F.max_by(F.struct("residual", "template"), F.struct(share, "template")).alias("logo"))
    out = pages.join(dealt(worst), PAGE, "left").join(dealt(logo), PAGE, "left")
    return out.select(*pages.columns, "region_change", c("logo.residual").alias("logo_left"), c("logo.template").alias("logo_template"))
