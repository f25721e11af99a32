"""Pixels, objects and text paints against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import objects, paints
from paperloom.operators import pixels as px
from paperloom.plans import rendered


def test_runs_are_the_union_of_boxes(spark):
    r = random.Random(1)
    boxes = [(d, r.randint(0, 20), r.randint(0, 6), r.randint(0, 24), r.randint(0, 8)) for d in (1, 2) for _ in range(14)]
    boxes += [(1, 3, 3, 3, 3), (1, 4, 3, 6, 3), boxes[0]]  # one that touches another, and one twice
    got = px.union_runs(spark.createDataFrame(boxes, "doc int, xa int, ya int, xb int, yb int"), ["doc"]).collect()
    want = {(d, y, x) for d, xa, ya, xb, yb in boxes for y in range(ya, yb + 1) for x in range(xa, xb + 1)}
    assert {(g["doc"], g["y"], x) for g in got for x in range(g["a"], g["b"] + 1)} == want
    assert len({(g["doc"], g["y"], g["b"] + 1) for g in got} & {(g["doc"], g["y"], g["a"]) for g in got}) == 0  # longest ones
    assert px.union_runs(spark.createDataFrame([], "doc int, xa int, ya int, xb int, yb int"), ["doc"]).count() == 0


def _blurred(rows, sigma, passes=3):
    """rows: lists of single values; the same blur, one value after another."""
    reach, inside, ends = px.box_weights(px.box_radius(sigma, passes))

    def line(v):
        at = lambda i: v[max(0, min(len(v) - 1, i))]
        return [(sum(at(i + k) for k in range(1 - reach, reach)) * inside + (at(i - reach) + at(i + reach)) * ends + (1 << 23)) >> 24 for i in range(len(v))]

    for _ in range(passes):
        rows = [line(v) for v in rows]
    columns = [list(c) for c in zip(*rows)]
    for _ in range(passes):
        columns = [line(c) for c in columns]
    return [list(c) for c in zip(*columns)]


@pytest.mark.parametrize(("sigma", "tile"), [(1.2, 256), (1.2, 4), (3.0, 16)])
def test_blur_does_not_depend_on_tiles(spark, sigma, tile):
    r = random.Random(2)
    values = [[r.randint(0, 255) for _ in range(11)] for _ in range(23)]
    df = spark.createDataFrame([(1, y, [v * 65536 + v for v in row]) for y, row in enumerate(values)], "doc int, y int, before array<int>")
    got = px.blurred(df, ["doc"], "before", "soft", sigma, tile_rows=tile).orderBy("y").collect()
    want = _blurred(values, sigma)
    assert [row["soft"] for row in got] == [[v * 65536 + v for v in row] for row in want]


def test_blur_keeps_a_flat_field_and_the_weights_sum_up():
    reach, inside, ends = px.box_weights(px.box_radius(1.2, 3))
    assert reach == 1 and 0 <= (1 << 24) - inside - 2 * ends <= 1
    assert math.isclose(px.box_radius(1.2, 3), 0.46154, abs_tol=1e-5)


def _picture(spark, before, after):
    pack = lambda rows: [[v * 65536 for v in row] for row in rows]
    return spark.createDataFrame([(1, 1, y, b, a) for y, (b, a) in enumerate(zip(pack(before), pack(after)))], "doc long, page long, y int, before array<int>, after array<int>")


def test_a_tiny_region_is_not_diluted_by_its_page(spark):
    """One changed spot in a page of 100 x 100: too little for the page, and most of its region."""
    before = [[0] * 100 for _ in range(100)]
    after = [row[:] for row in before]
    for y, x in itertools.product((10, 11), (20, 21)):
        after[y][x] = 200
    after[50][50] = 200  # inside the excluded rectangle
    after[90][90] = 12  # within the tolerance
    rows = _picture(spark, before, after)
    rects = spark.createDataFrame([(1, 1, 45.0, 45.0, 60.0, 60.0)], "doc long, page long, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 1, 7, 20.0, 10.0, 22.0, 12.0), (1, 1, 8, 70.0, 70.0, 80.0, 80.0), (1, 1, 9, 46.0, 46.0, 50.0, 50.0), (1, 1, 10, 30.0, 30.0, 30.0, 40.0)], "doc long, page long, region int, x0 double, y0 double, x1 double, y1 double")
    body = rendered.body_changes(rows, rects, 1.0).first()
    assert (body["changed"], body["compared"], body["code"]) == (4, 10_000 - 18 * 18, None)
    found = {r["region"]: r for r in rendered.region_changes(rows, rects, regions, 1.0).collect()}
    assert set(found) == {7, 8} and found[7]["code"] == "DIAGRAM_RENDER_CHANGED" and found[8]["code"] is None and found[8]["checked"] == 100
    whole = spark.createDataFrame([(1, 1, -5.0, -5.0, 500.0, 500.0)], rects.schema)
    assert rendered.body_changes(rows, whole, 1.0).first()["code"] == "NO_BODY_REGION_VERIFIED"
    other = rows.withColumn("after", F.when(F.col("y") == 3, F.slice("after", 1, 99)).otherwise(F.col("after")))
    assert (r := rendered.body_changes(other, rects, 1.0).first())["code"] == "RENDER_SIZE_MISMATCH" and r["ratio"] == 1.0


@pytest.mark.parametrize("repair", [False, True])
def test_a_repaired_logo_leaves_nothing_and_a_kept_one_does(spark, repair):
    """Strokes on both sides of the new emblem, on the field's colour."""
    bg = 70 * 65536 + 50 * 256 + 26
    stroke = 250 * 65536 + 250 * 256 + 250
    old = [[stroke if 12 <= y < 48 and (x % 12 < 3) else bg for x in range(160)] for y in range(60)]
    new = [[bg] * 160 if repair else row for row in old]
    rows = spark.createDataFrame([(1, y, b, a, None) for y, (b, a) in enumerate(zip(old, new))], "region int, y int, before array<int>, after array<int>, ink array<boolean>")
    regions = spark.createDataFrame([(1, 80.0, 30.0, 70, 50, 26, 60, True, False)], "region int, width double, height double, r int, g int, b int, px_height int, emblem boolean, moved boolean")
    got = rendered.logo_residual(rows, regions, ["region"]).first()
    assert got["template"] > 100 and got["residual"] == (0 if repair else got["template"])
    inked = rows.withColumn("ink", F.transform("before", lambda p, i: i < 0))
    assert rendered.logo_residual(inked, regions, ["region"]).first()["template"] == 0
    for column, value in (("moved", True), ("width", 7.0)):
        assert rendered.logo_residual(rows, regions.withColumn(column, F.lit(value)), ["region"]).first()["template"] == 0


def test_pictures_give_the_facts_that_the_audit_asks_for(spark):
    body = spark.createDataFrame([(1, 1, 100, 1, 0.01, "BODY_RENDER_CHANGED"), (1, 2, 0, 0, 1.0, "NO_BODY_REGION_VERIFIED"), (1, 3, 90, 0, 1.0, "RENDER_SIZE_MISMATCH"), (1, 4, 90, 0, 0.0, None)], "doc long, page long, compared long, changed long, ratio double, code string")
    regions = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.1), (1, 4, 1, 0.0)], "doc long, page long, region int, ratio double")
    logos = spark.createDataFrame([(1, 1, 3, 100), (1, 1, 30, 60), (1, 4, 0, 0)], "doc long, page long, residual long, template long")
    got = {r["page"]: tuple(r)[2:] for r in rendered.rendered_facts(body, regions, logos).collect()}
    assert got == {1: (True, 100, 0.01, 0.5, 30, 60), 2: (True, 0, None, None, None, None), 3: (False, None, None, None, None, None), 4: (True, 90, 0.0, 0.0, 0, 0)}


def test_fields_are_flat_or_have_a_threshold_of_their_noise(spark):
    flat, noise = [[0x3C5028] * 64 for _ in range(64)], random.Random(3)
    drawn = [row[:] for row in flat]
    for y, x in itertools.product(range(30, 34), range(10, 20)):
        drawn[y][x] = 0xFFFFFF
    rough = [[0x3C5028 + noise.randint(0, 40) * 65536 for _ in range(64)] for _ in range(64)]
    rows = [(k, y, row) for k, picture in enumerate((flat, drawn, rough)) for y, row in enumerate(picture)]
    df = spark.createDataFrame(rows, "region int, y int, pixels array<int>")
    regions = spark.createDataFrame([(k, 60, 80, 40, 64, 64) for k in range(3)], "region int, r int, g int, b int, px_width int, px_height int")
    got = {r["region"]: r for r in rendered.field_repairs(df, regions, ["region"]).collect()}
    assert got[0]["flat"] and got[0]["repaired"] == 48 * 48 and got[1]["flat"]
    assert not got[2]["flat"] and 10 < got[2]["threshold"] <= 22 and got[2]["repaired"] > 0


def test_reachability_ends_on_cycles_and_long_chains(spark):
    chain = [(1, i, i + 1) for i in range(40)] + [(1, 40, 0), (1, 5, 5), (2, 1, 2), (2, 3, 1), (1, 7, None)]
    references = spark.createDataFrame(chain, "doc int, object int, target int")
    start = spark.createDataFrame([(1, 30), (1, 30), (2, 1), (3, 9)], "doc int, object int")
    got = {tuple(r) for r in objects.reachable(references, start).collect()}
    assert got == {(1, i) for i in range(41)} | {(2, 1), (2, 2), (3, 9)}
    assert objects.reachable(references, start.limit(0)).count() == 0


def test_an_image_that_is_used_elsewhere_is_kept(spark):
    boxes = "doc int, page int, image int, x0 double, y0 double, x1 double, y1 double"
    header = (20.0, 20.0, 120.0, 50.0)
    painted = [(1, p, i, *header) for p in (1, 2) for i in (5, 6, 7)] + [(1, 1, 8, *header), (1, 1, 8, 90.0, 300.0, 290.0, 360.0), (1, 1, 9, 30.0, 30.0, 30.0, 40.0)]
    regions = spark.createDataFrame([(1, p, 16.0, 16.0, 124.0, 54.0) for p in (1, 2)], "doc int, page int, x0 double, y0 double, x1 double, y1 double")
    masks = spark.createDataFrame([(1, 6)], "doc int, image int")
    references = spark.createDataFrame([(1, 100, 101), (1, 101, 100), (1, 101, 7)], "doc int, object int, target int")
    appearances = spark.createDataFrame([(1, 100)], "doc int, object int")
    got = objects.removable_images(spark.createDataFrame(painted, boxes), regions, masks, references, appearances)
    assert [tuple(r) for r in got.collect()] == [(1, 5)]


def test_matrices_and_stack(spark):
    rows = [("cm", [2.0, 0, 0, 2, 10, 20]), ("q", None), ("cm", [0.0, 1, -1, 0, 5, 5]), ("BT", None), ("Tm", [1.0, 0, 0, 1, 3, 4]), ("Tj", None), ("Td", [1.0, 1.0]), ("TJ", None), ("Tj", None), ("ET", None)]
    rows += [("Q", None), ("Q", None), ("BT", None), ("Td", [7.0, 8.0]), ("'", None), ("ET", None), ("BT", None), ("Tr", [7.0]), ("Tj", None), ("ET", None), ("BT", None), ("Tj", None)]
    df = spark.createDataFrame([(1, 1, i, op, args and [float(a) for a in args]) for i, (op, args) in enumerate(rows)], "doc long, page long, seq long, op string, args array<double>")
    got = {r["seq"]: r for r in paints.text_paints(df.orderBy(F.rand(3))).collect()}
    # (3, 4) turned by the inner matrix: (5 - 4, 5 + 3), then doubled and moved
    assert (got[5]["x"], got[5]["y"]) == (12.0, 36.0) and (got[7]["x"], got[7]["y"]) == (10.0, 38.0)
    assert not got[8]["explicit"] and not got[14]["explicit"] and got[18]["clip"] and (got[18]["x"], got[18]["y"]) == (0.0, 0.0)
    assert set(got) == {5, 7, 8, 14, 18}  # the last group is not closed


def test_text_is_removed_by_whole_groups_only(spark):
    ops = [("BT", None), ("Tm", [1.0, 0, 0, 1, 50, 700]), ("Tj", None), ("ET", None), ("BT", None), ("Tm", [1.0, 0, 0, 1, 50, 600]), ("Tj", None), ("Td", [0.0, -400.0]), ("Tj", None), ("ET", None)]
    df = spark.createDataFrame([(1, 1, i, op, args and [float(a) for a in args]) for i, (op, args) in enumerate(ops)], "doc long, page long, seq long, op string, args array<double>")
    spans = spark.createDataFrame([(1, 1, 50.0, 142.0, 50.0, 134.0, 90.0, 144.0), (1, 1, 50.0, 242.0, 50.0, 234.0, 90.0, 244.0), (1, 1, 50.0, 642.0, 50.0, 634.0, 400.0, 644.0)], "doc long, page long, ox double, oy double, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 1, 40.0, 100.0, 110.0, 300.0)], "doc long, page long, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 1, 842.0)], "doc long, page long, height double")
    assert [r["seq"] for r in paints.removed_paints(df, spans, regions, pages).collect()] == [2]
    assert [tuple(r) for r in paints.declined_pages(df, spans, regions, pages).collect()] == [(1, 1, 1)]
    # a region that holds a part of a span only: nothing is removed, and the page is declined
    part = spark.createDataFrame([(1, 1, 45.0, 130.0, 70.0, 150.0)], regions.schema)
    assert paints.removed_paints(df, spans, part, pages).count() == 0
    assert [tuple(r) for r in paints.declined_pages(df, spans, part, pages).collect()] == [(1, 1, 1)]


def broadcasts(df) -> int:
    """Joins whose one side would be a hash table on the driver."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def stored(df, folder):
    """df as a table of known, small size."""
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def test_paints_and_pages_are_dealt_not_broadcast(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0, "BT", []), (1, 1, 1, "Tj", []), (1, 1, 2, "ET", [])], "doc long, page long, seq long, op string, args array<double>")
    spans = spark.createDataFrame([(1, 1, 0.0, 842.0, 0.0, 830.0, 30.0, 842.0)], "doc long, page long, ox double, oy double, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 1, 0.0, 800.0, 100.0, 842.0)], "doc long, page long, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 1, 842.0)], "doc long, page long, height double")
    df, spans, regions, pages = [stored(t, tmp_path / str(i)) for i, t in enumerate((df, spans, regions, pages))]
    assert broadcasts(paints.removed_paints(df, spans, regions, pages)) == broadcasts(paints.declined_pages(df, spans, regions, pages)) == 0
    assert [tuple(r) for r in paints.removed_paints(df, spans, regions, pages).collect()] == [(1, 1, 1)]
    assert paints.declined_pages(df, spans, regions, pages).count() == 0


def test_a_page_is_dealt_once_for_its_paints(spark, tmp_path):
    at = lambda page, rows: [(1, page, i, op, args and [float(a) for a in args]) for i, (op, args) in enumerate(rows)]
    paint = lambda x, y: [("BT", None), ("Tm", [1, 0, 0, 1, x, y]), ("Tj", None), ("ET", None)]
    # page 2 has no height, page 3 two; page 4 a region that is not closed above, and a span without an origin
    df = spark.createDataFrame([r for page in (1, 2, 3, 4) for r in at(page, paint(50, 700) + paint(50.9, 700) + paint(50.7, 699.3))], "doc long, page long, seq long, op string, args array<double>")
    nan = float("nan")
    spans = [(1, page, 50.0, 142.0, 50.0, 134.0, 90.0, 144.0) for page in (1, 1, 2, 3, 4)] + [(1, 4, None, 142.0, 50.0, 134.0, 90.0, 144.0), (1, 4, 50.0, 142.0, None, 134.0, 90.0, 144.0)]
    spans = spark.createDataFrame(spans, "doc int, page long, ox double, oy double, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, page, 40.0, 100.0, nan if page == 4 else 110.0, 300.0) for page in (1, 2, 3, 4)], "doc long, page long, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 1, 842.0), (1, 1, 842.0), (1, 3, 842.0), (1, 3, 800.0), (1, 4, 842.0)], "doc long, page long, height double")
    removed, declined = paints.removed_paints(df, spans, regions, pages), paints.declined_pages(df, spans, regions, pages)
    assert sorted(map(tuple, removed.collect())) == [(1, page, seq) for page in (1, 4) for seq in (2, 10)]
    assert sorted(map(tuple, declined.collect())) == [(1, 2, 1), (1, 3, 1), (1, 4, 1)]
    assert declined.dtypes == [("doc", "int"), ("page", "bigint"), ("n_left", "bigint")]
    for found in (removed, declined):
        assert found._jdf.queryExecution().executedPlan().initialPlan().toString().count("Exchange ") == 1


def test_pictures_are_dealt_not_broadcast(spark, tmp_path):
    rows = stored(spark.range(6).selectExpr("1L AS doc", "1L AS page", "CAST(id AS INT) AS y", "array_repeat(1, 6) AS before", "array_repeat(CAST(id * 99 AS INT), 6) AS after", "array_repeat(1, 6) AS pixels", "array_repeat(true, 6) AS ink"), tmp_path / "rows")
    rects = stored(spark.range(1).selectExpr("1L AS doc", "1L AS page", "0.0D AS x0", "0.0D AS y0", "2.0D AS x1", "2.0D AS y1"), tmp_path / "rects")
    fields = stored(spark.range(1).selectExpr("1L AS doc", "60 AS r", "80 AS g", "40 AS b", "6 AS px_width", "6 AS px_height", "30.0D AS width", "30.0D AS height", "false AS emblem", "false AS moved"), tmp_path / "fields")
    logo = rendered.logo_residual(rows, fields, ["doc"])
    for found in (rendered.body_changes(rows, rects, 1.0), rendered.region_changes(rows, rects, rects.withColumns({"region": F.lit(1), "x1": F.lit(6.0)}), 1.0), rendered.field_repairs(rows.select("doc", "y", "pixels"), fields, ["doc"]), logo):
        assert broadcasts(found) == 0
        assert found.count() == 1
    # a blur is not evaluated value by value, once for each of its neighbours
    assert "lambda" not in logo._jdf.queryExecution().executedPlan().toString()
