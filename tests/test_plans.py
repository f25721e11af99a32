import random

from pyspark.sql import functions as F

from paperloom.functions import geometry as g
from paperloom.operators import clusters, matching, rects, regions, selection, state
from paperloom.operators.rollups import multiset_retention
from paperloom.plans import audit, bands, page_plan

KIND = f"struct<clip:{g.RECT},scale:double,dx:double,dy:double>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_touching_rectangles_do_not_meet(spark):
    r = spark.range(1).select(g.intersects(g.rect(0, 0, 5, 5), g.rect(5, 0, 9, 5)).alias("edge"), g.intersects(g.rect(0, 0, 5, 5), g.rect(4, 4, 9, 9)).alias("corner"), g.contains(g.rect(0, 0, 5, 5), g.rect(0, 0, 5, 5)).alias("same"), g.near(g.rect(0, 0, 5, 5), g.rect(9, 0, 12, 5), 5).alias("near")).first()
    assert tuple(r) == (False, True, True, True)


def test_subtraction_keeps_order_and_area(spark):
    pieces = spark.range(1).select(g.subtract(g.rect(0, 0, 10, 10), F.array(g.rect(2, 3, 5, 6), g.rect(0, 0, 10, 1))).alias("p")).first()["p"]
    assert [tuple(p) for p in pieces] == [(0, 1, 10, 3), (0, 6, 10, 10), (0, 3, 2, 6), (5, 3, 10, 6)]
    assert spark.range(1).select(F.size(g.subtract(g.rect(0, 0, 4, 4), F.array(g.rect(-1, -1, 9, 9)))).alias("n")).first()["n"] == 0


def test_crop_geometry(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    c = spark.range(1).select(g.crop_geometry(*lit(600, 800, 100, 50, 50, 780)).alias("c")).first()["c"]
    assert c["scale"] == 1.0 and c["dx"] == 0 and c["dy"] == 50 + (730 - 650) / 2 - 100
    try:
        spark.range(1).select(g.crop_geometry(*lit(600, 800, 500, 300, 50, 780)).alias("c")).first()
        raise AssertionError("degenerate crop passed")
    except Exception as e:
        assert "crop leaves no page area" in str(e)


def test_mean_linkage_compares_with_the_running_mean(spark):
    out = spark.range(1).select(clusters.mean_linkage(F.array(*[F.lit(x) for x in (1.0, 4.0, 7.0, 20.0, None)]), 4.0).alias("c")).first()["c"]
    assert [(c["lo"], c["hi"], c["n"]) for c in out] == [(1.0, 4.0, 2), (7.0, 7.0, 1), (20.0, 20.0, 1)]


def test_merges_depend_on_how_groups_grow():
    boxes = [[0, 0, 10, 10], [30, 0, 40, 10], [12, 2, 28, 8]]
    boxes = sorted(boxes, key=lambda r: (r[1], r[0]))
    assert rects.merged(boxes) == [[0, 0, 28, 10], [30, 0, 40, 10]]
    assert rects.merged(boxes, absorb=True) == [[0, 0, 40, 10]]


def test_merge_in_spark_is_independent_of_partitions(spark):
    rows = [("a", 1, 0.0, 0.0, 10.0, 10.0), ("a", 1, 30.0, 0.0, 40.0, 10.0), ("a", 1, 12.0, 2.0, 28.0, 8.0), ("b", 1, 0.0, 0.0, 1.0, 1.0)]
    df = frame(spark, rows, "doc string, page long, x0 double, y0 double, x1 double, y1 double")
    want = sorted(map(tuple, rects.merged_rects(df, absorb=True).collect()))
    assert sorted(map(tuple, rects.merged_rects(df.repartition(3), absorb=True).collect())) == want
    assert len(want) == 2


def test_repeated_header_and_footer_bands(spark):
    pages = frame(spark, [("d", p, 842.0) for p in range(1, 5)] + [("single", 1, 842.0)], "doc string, page int, height double")
    blocks = [("d", p, 0, "ACME Class 9", 20.0, 40.0) for p in (2, 3, 4)] + [("d", p, 1, f"Question {p} solved alike", 100.0, 110.0) for p in (2, 3, 4)] + [("d", p, 2, f"Page {p}", 815.0, 825.0) for p in (2, 3)] + [("single", 1, 0, "Title", 10.0, 20.0)]
    lines = frame(spark, [("d", p, 46.0 + p * 0.1, True) for p in (2, 3, 4)] + [("d", 2, 812.0, False), ("d", 3, 812.5, False)], "doc string, page int, y double, top boolean")
    visual = frame(spark, [("d", p, 800.0, 0.9) for p in (2, 3, 4)], "doc string, page int, y double, strength double")
    out = {r["doc"]: r for r in bands.detect_bands(pages, frame(spark, blocks, "doc string, page int, nth int, text string, y0 double, y1 double"), lines, visual).collect()}
    d = out["d"]
    assert d["header_signatures"] == ["acme class #"]  # the questions lie below the rule
    assert abs(d["header_bottom"] - 48.3) < 1e-9 and d["header_confidence"] == 0.99
    assert d["footer_top"] == 800.0 and d["footer_signatures"] == ["page #"]
    assert out["single"]["header_bottom"] == 0 and out["single"]["footer_top"] is None


def page(**more):
    base = dict(doc="d", page=2, width=595.0, height=842.0, page_type="standard", opener=False, material_type="NOTES", type_confidence=0.78, header_bottom=60.0, header_confidence=0.9, band_top=None, footer_confidence=0.0, first_y=82.0, last_y=700.0, legacy_rects=[], footer_legacy_rects=[], vertical_rects=[], text_ok=True, image_only=False)
    return base | more


SCHEMA = f"doc string, page int, width double, height double, page_type string, opener boolean, material_type string, type_confidence double, header_bottom double, header_confidence double, band_top double, footer_confidence double, first_y double, last_y double, legacy_rects {g.RECTS}, footer_legacy_rects {g.RECTS}, vertical_rects {g.RECTS}, text_ok boolean, image_only boolean"
NAMES = list(page())


def plans(spark, *pages, layout=page_plan.Layout()):
    df = spark.createDataFrame([tuple(p[n] for n in NAMES) for p in pages], SCHEMA)
    return page_plan.plan_pages(df, layout)


def test_plan_of_a_standard_page(spark):
    r = plans(spark, page()).first()
    assert (r["strategy"], r["page_strategy"], r["header_template"]) == ("overlay", "standard_header_footer_replacement", "notes")
    assert r["header_rect"]["y1"] == 60 and r["cleanup"] == 60 and r["footer_rect"]["y0"] == 824
    assert abs(r["confidence"] - (0.78 * 0.52 + 0.9 * 0.28 + 0.15)) < 1e-12


def test_content_bounds_the_header_and_null_does_not(spark):
    near, none, top = plans(spark, page(first_y=50.0), page(first_y=None, header_bottom=200.0), page(first_y=30.0)).collect()
    assert near["cleanup"] == 43 and none["cleanup"] == 150
    assert (top["strategy"], top["page_strategy"]) == ("preserve", "leave_untouched")


def test_designed_blank_and_marked_pages(spark):
    logo = [(1.0, 1.0, 50.0, 20.0)]
    a, b, c, e, f = plans(spark, page(page_type="designed", legacy_rects=logo), page(page_type="designed", opener=True), page(page_type="blank"), page(first_y=10.0, legacy_rects=logo), page(page=1, material_type="TEST", header_bottom=0.0, first_y=200.0)).collect()
    assert (a["page_strategy"], a["confidence"], a["header_rect"], a["logo_replace_rect"]["x1"]) == ("designed_page_logo_only", 0.97, None, 50.0)
    assert (b["page_strategy"], b["confidence"], c["page_strategy"], c["confidence"]) == ("designed_page_preserve", 0.92, "leave_untouched", 1.0)
    assert (e["page_strategy"], e["strategy"]) == ("legacy_only_cleanup", "replace_logo_only")
    assert (f["page_strategy"], f["cleanup"], f["header_template"]) == ("first_page_large_logo_replacement", 96.0, "test")


def test_crop_only_where_it_is_safe_and_allowed(spark):
    safe = page(header_bottom=70.0, first_y=90.0, header_confidence=0.9, last_y=None)
    assert plans(spark, safe).first()["crop_is_safe"]
    r = plans(spark, safe, layout=page_plan.Layout(allow_rebuild_crop=True)).first()
    assert r["strategy"] == "rebuild_crop" and r["crop"]["clip"]["y0"] == 70


def test_verified_footer_wins_only_when_clear(spark):
    a, b, c = plans(spark, page(band_top=800.0, footer_confidence=0.9), page(band_top=800.0, footer_confidence=0.9, last_y=799.0), page(last_y=830.0)).collect()
    assert a["footer_rect"]["y0"] == 800 and b["footer_rect"]["y0"] == 824 and c["footer_rect"] is None


def _audit(spark, source, output, size=(595.0, 842.0), **facts):
    p = plans(spark, page()).withColumns({"protected_text_rects": F.array(g.rect(50.0, 82.0, 500.0, 700.0)).cast(g.RECTS), "protected_visual_rects": g.no_rects(), "crop": F.lit(None).cast(KIND)})
    words = "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"
    base = dict(text_ok=True, unsafe_image_cleanup=False, ocr_checked=False, ocr_error=None, ocr_unsafe=False, output_ocr_error=None, output_ocr_hits=0, render_size_ok=True, render_error=None, body_pixels=10, body_change=0.0, region_change=0.0, logo_left=0, logo_template=0, logo_error=None, source_text_error=None, position_error=None) | facts
    kinds = "text_ok boolean, unsafe_image_cleanup boolean, ocr_checked boolean, ocr_error string, ocr_unsafe boolean, output_ocr_error string, output_ocr_hits int, render_size_ok boolean, render_error string, body_pixels int, body_change double, region_change double, logo_left int, logo_template int, logo_error string, source_text_error string, position_error string"
    f = spark.createDataFrame([("d", 2, *base.values())], "doc string, page int, " + kinds)
    out_pages = spark.createDataFrame([("d", 2, *size)], "doc string, page int, width double, height double")
    b = spark.createDataFrame([("d", None, 0.0)], "doc string, footer_top double, footer_confidence double")
    issues = audit.audit(p, spark.createDataFrame(source, words), spark.createDataFrame(output, words), out_pages, f, b, ["acme"], ["side"])
    return sorted({r["code"] for r in issues.collect()})


BODY = [("d", 2, 60.0 + 30 * i, 100.0, 80.0 + 30 * i, 110.0, w) for i, w in enumerate("force and motion of a body".split())]


def test_audit_accepts_an_equal_body_and_new_header(spark):
    assert _audit(spark, BODY + [("d", 2, 10.0, 10.0, 50.0, 20.0, "ACME")], BODY + [("d", 2, 10.0, 10.0, 60.0, 20.0, "School")]) == []


def test_audit_notices_damage(spark):
    moved = [(*r[:2], r[2] + 8, *r[3:4], r[4] + 8, *r[5:]) for r in BODY]
    assert _audit(spark, BODY, moved) == ["BODY_POSITION_SHIFT"]
    assert _audit(spark, BODY, BODY[1:]) == ["BODY_TEXT_LOSS"]
    # a body word that only reappears in the header is lost
    assert _audit(spark, BODY, BODY[1:] + [("d", 2, 60.0, 20.0, 80.0, 30.0, "force")]) == ["BODY_TEXT_LOSS"]
    assert _audit(spark, [], []) == ["BODY_TEXT_UNAVAILABLE"]
    assert _audit(spark, BODY, BODY + [("d", 2, 1.0, 300.0, 30.0, 310.0, "Side")]) == ["VERTICAL_LEGACY_TEXT_REMAINS"]
    assert _audit(spark, BODY, BODY + [("d", 2, 300.0, 20.0, 330.0, 30.0, "Acme")]) == ["LEGACY_TEXT_REMAINS"]
    assert _audit(spark, BODY, BODY, size=(600.0, 842.0), body_change=0.01, region_change=0.5, ocr_checked=True, ocr_error="x", logo_left=40, logo_template=50) == ["BODY_RENDER_CHANGED", "DIAGRAM_RENDER_CHANGED", "PAGE_SIZE_CHANGED", "RASTER_LEGACY_LOGO_REMAINS", "RASTER_OCR_UNAVAILABLE"]


def test_audit_report(spark):
    p = spark.createDataFrame([("a", 1, "overlay"), ("a", 2, "overlay"), ("b", 1, "preserve")], "doc string, page int, page_strategy string")
    i = spark.createDataFrame([("a", 1, "X", "warning"), ("b", 1, "Y", "fatal")], "doc string, page int, code string, severity string")
    k = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.5)], "doc string, page int, retention double")
    out = {r["doc"]: r for r in audit.report(p, i, k).collect()}
    assert out["a"]["passed"] and out["a"]["average_retention"] == 0.75 and out["a"]["strategies"] == {"overlay": 2}
    assert not out["b"]["passed"] and out["b"]["average_retention"] is None
    docs = spark.createDataFrame([("a", True, 2, 2), ("b", True, 2, 3), ("c", False, 2, 0)], "doc string, opened boolean, source_pages int, output_pages int")
    assert sorted((r["doc"], r["code"]) for r in audit.document_issues(docs).collect()) == [("b", "PAGE_COUNT_CHANGED"), ("c", "OUTPUT_OPEN_FAILED")]


def test_merges_look_at_every_group_that_can_be_near():
    """The sweep gives what comparing with all groups gives."""
    r = random.Random(12)
    near = lambda a, b: max(a[0] - 5, b[0]) < min(a[2] + 5, b[2]) and max(a[1] - 5, b[1]) < min(a[3] + 5, b[3])
    join = lambda a, b: [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
    for _ in range(40):
        boxes = sorted(([x, y, x + r.randint(0, 30), y + r.randint(0, 20)] for x, y in ((r.randint(0, 200), r.randint(0, 300)) for _ in range(60))), key=lambda b: (b[1], b[0], b[2], b[3]))
        first, every = [], []
        for b in boxes:
            at = next((i for i, e in enumerate(first) if near(e, b)), None)
            if at is None:
                first.append(b)
            else:
                first[at] = join(first[at], b)
            close, grown = [e for e in every if near(e, b)], b
            for e in close:
                grown = join(grown, e)
            every = [*[e for e in every if e not in close], grown]
        assert rects.merged(boxes) == first and rects.merged(boxes, absorb=True) == every


def test_matches_of_frequent_tokens_are_the_nearest_left():
    r = random.Random(13)
    box = lambda: (float(r.randint(0, 40)), float(r.randint(0, 40)), 50.0, 50.0)
    for n, m in ((5, 9), (40, 40), (100, 30), (30, 100), (3, 0), (0, 3)):
        outputs, sources = sorted((box() for _ in range(m)), key=lambda b: (b[1], b[0])), sorted((box() for _ in range(n)), key=lambda b: (b[1], b[0]))
        left, worst = list(outputs), []
        for s in sources:
            if left:
                got = left.pop(min(range(len(left)), key=lambda k: abs(left[k][0] - s[0]) + abs(left[k][1] - s[1])))
                worst.append(max(abs(a - b) for a, b in zip(got, s)))
        told = list(matching._greedy(iter([(False, *o) for o in outputs] + [(True, *s) for s in sources])))
        assert told == ([(max(worst), len(worst))] if worst else [])


def test_clusters_of_rows_are_those_of_arrays(spark):
    r = random.Random(14)
    rows = [(k, r.choice([None, round(r.uniform(0, 100), 1)])) for k in (1, 2, 3) for _ in range(80)] + [(4, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    want = df.groupBy("k").agg(F.collect_list("v").alias("v")).select("k", F.posexplode(clusters.mean_linkage(F.col("v"), 4.0)).alias("cluster", "c")).select("k", F.col("cluster").cast("long"), "c.lo", "c.hi", "c.n")
    assert sorted(map(tuple, clusters.mean_linkage_rows(df, ["k"], "v", 4.0).collect())) == sorted(map(tuple, want.collect()))


def test_greedy_match_takes_each_output_once(spark):
    box = lambda x: (x, 0.0, x + 1, 1.0)
    schema = f"doc string, page long, token string, box {g.RECT}"
    before = spark.createDataFrame([("d", 1, "a", box(0.0)), ("d", 1, "a", box(1.0)), ("d", 1, "b", box(5.0))], schema)
    after = spark.createDataFrame([("d", 1, "a", box(1.0)), ("d", 1, "a", box(9.0)), ("d", 1, "b", box(6.0))], schema)
    r = matching.position_shifts(before, after).first()
    assert (r["shift"], r["checks"]) == (8.0, 3)


def test_page_matches_deal_words_by_page_alone(spark):
    """Retention and shifts of random pages are those of the single measures,
    and a plan sends its words over one exchange."""
    r = random.Random(15)
    rows = [("d%d" % r.randint(0, 1), r.randint(1, 3), r.choice("abcdefghijkl"), r.random() < 0.5, *[float(r.randint(0, 90)) for _ in range(4)]) for _ in range(120)] + [("e", 1, "a", False, 0.0, 0.0, 1.0, 1.0), ("f", 1, "a", True, 0.0, 0.0, 1.0, 1.0)]
    words = spark.createDataFrame(rows, "doc string, page long, token string, is_source boolean, x0 double, y0 double, x1 double, y1 double")
    side = lambda source: words.filter(F.col("is_source") == source).select("doc", "page", "token", g.rect(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("box"))
    kept = {(x["doc"], x["page"]): x["retention"] for x in multiset_retention(side(True), side(False), ["doc", "page"]).collect()}
    shifts = {(x["doc"], x["page"]): (x["shift"], x["checks"]) for x in matching.position_shifts(side(True), side(False)).collect()}
    got = {(x["doc"], x["page"]): x for x in matching.page_matches(words).collect()}
    assert {k: x["retention"] for k, x in got.items() if x["retention"] is not None} == kept and got["e", 1]["retention"] is None
    assert {k: (x["shift"], x["checks"]) for k, x in got.items() if x["checks"]} == shifts and got["f", 1]["shift"] is None
    plan = audit.body_matches(*[words.withColumn("text", F.col("token"))] * 2, plans(spark, page()).withColumn("crop", F.lit(None).cast(KIND)), ["acme"])._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "token" in line for line in plan.splitlines()) <= 1


def test_image_regions(spark):
    occ = spark.createDataFrame([("d", 1, "x", 1.0, 1.0, 2.0, 2.0), ("d", 2, "x", 1.0, 1.0, 2.0, 2.0), ("d", 1, "y", 1.0, 1.0, 2.0, 2.0)], "doc string, page int, image string, x0 double, y0 double, x1 double, y1 double")
    reg = spark.createDataFrame([("d", 1, 0.0, 0.0, 5.0, 5.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r["image"] for r in regions.authorised(occ, reg).collect()] == ["y"]
    words = spark.createDataFrame([("d", 1, 7, 0.0, 0.0, 100.0, 10.0)], "doc string, page int, word_id int, x0 double, y0 double, x1 double, y1 double")
    images = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 95.0, 9.0), ("d", 1, 2, 0.0, 5.0, 100.0, 20.0), ("d", 1, 3, 0.0, 0.0, 500.0, 9.0)], "doc string, page int, number int, x0 double, y0 double, x1 double, y1 double")
    assert regions.brand_above_number(words, images).first()["number"] == 2


def test_recommended_workers(spark):
    runs = lambda *r: spark.createDataFrame(list(r), "workers long, elapsed double, peak double, ok boolean")
    published = runs((1, 154.553, 422.59, True), (2, 106.844, 820.35, True), (4, 101.684, 1148.96, True))
    assert state.recommend_workers(published, F.lit(1049.68)).first()["workers"] == 1
    assert state.recommend_workers(published, F.lit(4000.0)).first()["workers"] == 2
    assert state.recommend_workers(runs((2, 1.0, 1.0, False)), F.lit(4000.0)).first()["workers"] == 1


def test_review_pages_never_truncates_what_must_be_seen(spark):
    pages = spark.createDataFrame([("d", i, 0.5 if i == 23 else 0.9, "overlay", "standard") for i in range(24)], "doc string, page int, confidence double, strategy string, page_type string")
    issues = spark.createDataFrame([("d", 18)], "doc string, page int")
    got = sorted(r["page"] for r in selection.review_pages(pages, issues).collect())
    assert {0, 1, 18, 23} <= set(got) and 8 <= len(got) <= 12
    assert sorted(r["page"] for r in selection.review_pages(pages, issues, budget=2).collect()) == [0, 1, 18, 23]


def test_set_cover_both_ways(spark):
    keys = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z"), ("d", "y"), ("d", "z")], "source_id string, key string")
    pages = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 9)], "source_id string, page_count int")
    want = [(0, "b", ["x", "y"]), (1, "c", ["z"])]
    for most_local in (100, 0):
        assert [tuple(r) for r in selection.set_cover(keys, pages, most_local=most_local).orderBy("step").collect()] == want
    assert selection.set_cover(keys, pages, most=1).count() == 1
