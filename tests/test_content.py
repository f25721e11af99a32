from pyspark.sql import functions as F

from paperloom.functions import geometry as g
from paperloom.operators import intervals, rollups, state
from paperloom.plans import bands, content, page_plan

PAGES = "doc string, page long, width double, height double"
LINE = "doc string, page long, text string, vertical boolean, x0 double, y0 double, x1 double, y1 double"
BLOCK = LINE + ", size double, nth long"
DRAWING = "doc string, page long, x0 double, y0 double, x1 double, y1 double, stroke double"
IMAGE = "doc string, page long, digest string, x0 double, y0 double, x1 double, y1 double"
NO_BANDS = ("d", 0.0, None, 0.0, 0.0, [], [])
BAND = "doc string, header_bottom double, footer_top double, header_confidence double, footer_confidence double, header_signatures array<string>, footer_signatures array<string>"


def tables(spark, bands_row=NO_BANDS, chapter="Sound", material="NOTES"):
    pages = spark.createDataFrame([("d", p, 595.0, 842.0) for p in (1, 2)], PAGES)
    facts = spark.createDataFrame([("d", "physics", "9", chapter, material)], "doc string, subject string, class_name string, chapter string, material_type string")
    return pages, facts, spark.createDataFrame([bands_row], BAND)


def line(text, y, page=2, x0=50.0, x1=300.0, vertical=False, high=10.0):
    return ("d", page, text, vertical, x0, y, x1, y + high)


def test_content_is_what_no_header_or_footer_is(spark):
    pages, facts, found = tables(spark, ("d", 50.0, 800.0, 0.9, 0.9, ["acme class #"], ["page #"]))
    rows = [line("ACME Class 9", 30.0), line("Physics", 60.0), line("Class 9", 61.0), line("Page 4", 20.0), line("Foundation Module", 40.0), line("NCERT Basics : Class 9", 100.0), line("Page 3", 810.0), line("[12]", 805.0), line("side", 300.0, vertical=True), line("  ", 200.0)]
    body = [line("What is sound?", 82.0), line("Physics is fun", 90.0), line("Page 3", 400.0), line("Physics", 300.0), line("A footnote", 815.0)]
    left = content.academic_lines(spark.createDataFrame(rows + body, LINE), pages, facts, found, ["Acme"])
    assert sorted(r["text"] for r in left.collect()) == sorted(b[2] for b in body)
    assert tuple(content.bounds(left).first())[2:] == (82.0, 825.0)


def _exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    return plan.count("Exchange hashpartitioning(doc")


def _dealt_once(spark, of) -> int:
    """Exchanges of a plan whose tables are all too large to be broadcast."""
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        return _exchanges(of())
    finally:
        spark.conf.set(key, before)


def test_protected_text_deals_its_lines_once(spark):
    pages, facts, found = tables(spark)
    lines, out = spark.createDataFrame([line("a", 82.0)], LINE), spark.createDataFrame([("d", 2, 0.0, 0.0, 1.0, 1.0)], "doc string, page long, x0 double, y0 double, x1 double, y1 double")
    # pages by document and by page, facts, bands, excluded rectangles, lines
    assert _dealt_once(spark, lambda: content.protected_text(content.academic_lines(lines, pages, facts, found, ["Acme"]), out)) == 6


def test_protected_visual_deals_its_elements_once(spark):
    pages, facts, found = tables(spark)
    drawings, images = spark.createDataFrame([("d", 2, 1.0, 1.0, 9.0, 9.0, 1.0)], DRAWING), spark.createDataFrame([("d", 2, "x", 1.0, 1.0, 9.0, 9.0)], IMAGE)
    out = drawings.drop("stroke")
    # as above; drawings and images are one table
    assert _dealt_once(spark, lambda: content.protected_visual(drawings, images, pages, facts, found, out, {})) == 6


def test_wide_rules_know_strips_at_the_bottom(spark):
    pages, _, _ = tables(spark)
    rows = [("d", 1, 20.0, 46.0, 570.0, 46.0, 1.0), ("d", 1, 20.0, 60.0, 200.0, 60.0, 1.0), ("d", 1, 0.0, 2.0, 595.0, 3.0, 1.0), ("d", 1, 20.0, 790.0, 570.0, 820.0, 1.0), ("d", 1, 20.0, 812.0, 570.0, 813.0, 1.0), ("d", 1, 0.0, 700.0, 300.0, 740.0, 1.0)]
    got = sorted(map(tuple, content.wide_rules(spark.createDataFrame(rows, DRAWING), pages).collect()))
    assert got == [("d", 1, 46.0, True), ("d", 1, 790.0, False), ("d", 1, 812.5, False)]


def test_marked_rows_become_bands(spark):
    white, ink = (250, 250, 250), (200, 210, 250)
    rows = [("d", 1, row, *(ink if row in (3, 4, 6, 20) or x < 2 else white)) for row in range(30) for x in range(10)]
    marks = content.row_marks(spark.createDataFrame(rows, "doc string, page long, row long, r int, g int, b int"))
    got = sorted(map(tuple, content.visual_bands(marks, 1.0, F.lit(100.0)).collect()))
    assert got == [("d", 1, 103.0, 107.0, 1.0), ("d", 1, 120.0, 121.0, 1.0)]


def test_titles_and_structural_headers(spark):
    pages, facts, found = tables(spark, ("d", 50.0, None, 0.9, 0.0, ["ncert notes class #", "acme press"], []))
    rows = [(*line("10 Sound", 100.0, page=1, x1=348.0), 20.0, 1), (*line("All about sound", 60.0, page=1), 20.0, 2), (*line("sound", 300.0, page=1), 12.0, 3), (*line("NCERT notes: class 9", 20.0), 9.0, 1), (*line("ACME Press", 20.0, page=1), 9.0, 4)]
    df = spark.createDataFrame(rows, BLOCK)
    got = {r["page"]: tuple(r)[2:] for r in content.title_metrics(df, pages, facts).collect()}
    assert got[1] == (True, 20.0, 100.0, 298.0 / 595.0) and got[2] == (False, 0.0, 842.0, 0.0)
    assert [tuple(r) for r in content.structural_headers(df, pages, facts, found, ["acme"]).collect()] == [("d", 2)]
    assert all(not r["title_found"] for r in content.title_metrics(df, pages, tables(spark, chapter="")[1]).collect())


def test_marks_grow_over_their_artwork_and_no_further(spark):
    pages, _, _ = tables(spark)
    words = spark.createDataFrame([line("ACME", 30.0, page=1, x0=40.0, x1=80.0), line("acme", 600.0, page=1), line("other", 30.0)], LINE)
    hits = content.term_hits(words, pages, ["Acme"])
    assert hits.count() == 1
    blocks = spark.createDataFrame([line("ACME (R)", 30.0, page=1, x0=40.0, x1=120.0), line("Measurement and Motion", 44.0, page=1, x0=40.0, x1=250.0)], LINE)
    drawings = spark.createDataFrame([("d", 1, 30.0, 20.0, 140.0, 60.0, 1.0), ("d", 1, 0.0, 0.0, 595.0, 60.0, 1.0)], DRAWING)
    images = spark.createDataFrame([("d", 1, "a", 300.0, 30.0, 340.0, 60.0)], IMAGE)
    got = tuple(content.expanded_hits(hits, blocks, drawings, images, pages, ["acme"]).drop("hit").first())
    assert got == ("d", 1, 26.0, 17.0, 144.0, 63.0)


def test_verified_marks_and_margin_text(spark):
    pages, _, _ = tables(spark)
    images = spark.createDataFrame([("d", 1, "a", 10.0, 2.0, 60.0, 40.0), ("d", 1, "a", 10.0, 780.0, 60.0, 830.0), ("d", 1, "a", 10.0, 300.0, 60.0, 340.0), ("d", 1, "b", 10.0, 2.0, 60.0, 40.0)], IMAGE)
    got = sorted(map(tuple, content.verified_marks(images, spark.createDataFrame([("a",), ("a",)], "digest string"), pages).collect()))
    assert got == [("d", 1, False, 6.0, 0.0, 64.0, 44.0), ("d", 1, True, 6.0, 776.0, 64.0, 834.0)]
    blocks = [line("Old module strip", 100.0, page=1, x0=5.0, x1=30.0, high=200.0), line("Old module strip", 400.0, page=1, x0=5.0, x1=60.0), line("x y", 500.0, page=1, x0=5.0, x1=20.0, vertical=True), line("a vertical line of text", 600.0, page=1, x0=560.0, x1=590.0, vertical=True)]
    found = sorted(map(tuple, content.margin_text(spark.createDataFrame(blocks, LINE), pages, ["old module"]).collect()))
    assert found == [("d", 1, 3.0, 98.0, 32.0, 302.0), ("d", 1, 558.0, 598.0, 592.0, 612.0)]


def test_protected_geometry(spark):
    pages, facts, found = tables(spark, ("d", 60.0, 790.0, 0.9, 0.9, [], []), material="TEST")
    excluded = spark.createDataFrame([("d", 1, 0.0, 0.0, 100.0, 100.0)], "doc string, page long, x0 double, y0 double, x1 double, y1 double")
    drawings = [("d", 1, 0.0, 0.0, 595.0, 842.0, 1.0), ("d", 1, 20.0, 50.0, 570.0, 52.0, 1.0), ("d", 1, 20.0, 795.0, 570.0, 820.0, 1.0), ("d", 1, 200.0, 40.0, 390.0, 80.0, 1.0), ("d", 1, 10.0, 10.0, 50.0, 50.0, 1.0), ("d", 2, 100.0, 300.0, 200.0, 300.0, 4.0)]
    images = [("d", 1, "a", 50.0, 50.0, 150.0, 90.0), ("d", 2, "a", 50.0, 800.0, 500.0, 840.0), ("d", 2, "a", 700.0, 0.0, 800.0, 10.0)]
    got = content.protected_visual(spark.createDataFrame(drawings, DRAWING), spark.createDataFrame(images, IMAGE), pages, facts, found, excluded, page_plan.Layout().first_page_cleanup_targets)
    assert sorted(map(tuple, got.collect())) == [("d", 1, 100.0, 50.0, 150.0, 90.0), ("d", 2, 98.0, 298.0, 202.0, 302.0)]
    text = content.protected_text(spark.createDataFrame([line("in", 10.0, page=1, x0=5.0, x1=60.0), line("out", 95.0, page=1, x0=5.0, x1=60.0)], LINE), excluded)
    assert [tuple(r) for r in text.collect()] == [("d", 1, 5.0, 95.0, 60.0, 105.0)]


def test_elements_to_bands_to_plans_to_audit(spark):
    """The whole way, from elements alone: a header, a rule and a footer repeat, the body stays."""
    from paperloom.plans import audit

    n = 4
    pages = spark.createDataFrame([("d", p, 595.0, 842.0) for p in range(1, n + 1)], PAGES)
    facts = tables(spark)[1]
    lines = [line(t, y, page=p) for p in range(1, n + 1) for t, y in ((f"ACME Class {p}", 20.0), (f"Question {p}: why?", 82.0), ("Since it moves.", 700.0), (f"Page {p}", 815.0))]
    lines = spark.createDataFrame(lines, LINE)
    blocks = spark.createDataFrame([(*x, 11.0, i) for i, x in enumerate(lines.collect())], BLOCK)
    drawings = spark.createDataFrame([("d", p, 20.0, 46.0, 570.0, 46.0, 1.0) for p in range(1, n + 1)] + [("d", 2, 200.0, 300.0, 300.0, 400.0, 1.0)], DRAWING)
    images = spark.createDataFrame([], IMAGE)
    rules = content.wide_rules(drawings, pages)
    found = bands.detect_bands(pages, blocks, rules, spark.createDataFrame([], "doc string, page long, y double, strength double"))
    plans = content.plan_elements(pages, facts.withColumn("type_confidence", F.lit(0.78)), found, lines, blocks, drawings, images, spark.createDataFrame([], "digest string"), ["acme"], [])
    got = {r["page"]: r for r in plans.collect()}
    # the brand word on each page is a mark of its own, and lies in the header that goes
    assert {r["strategy"] for r in got.values()} == {"overlay"} and all(r["header_rect"]["y1"] <= 75 and r["cleanup"] <= 75 for r in got.values())
    assert all(r["first_y"] == 82.0 and r["last_y"] == 710.0 for r in got.values()) and all(r["footer_rect"] is not None for r in got.values())
    kind = f"struct<clip:{g.RECT},scale:double,dx:double,dy:double>"
    assert audit.geometry_issues(plans.withColumn("crop", F.lit(None).cast(kind))).count() == 0


def test_intervals_meet_in_buckets(spark):
    rows = [("a", i, s, e) for i, (s, e) in enumerate([(0, 10), (5, 25), (10, 11), (24, 90), (90, 91), (7, 7), (-5, 1)])] + [("b", 9, 0, 100)]
    got = {tuple(r) for r in intervals.overlapping_pairs(spark.createDataFrame(rows, "k string, id long, s long, e long"), "k", "id", "s", "e", 10).collect()}
    want = {(i, j) for k, i, s, e in rows for k2, j, s2, e2 in rows if k == k2 and i < j and s < e2 and s2 < e and e > s and e2 > s2}
    assert got == want


def test_retries_steps_and_matrix(spark):
    attempts = [("a", 0, "failed"), ("a", 1, "completed"), ("a", 2, "failed"), ("b", 0, "qa_failed"), ("c", 0, "failed"), ("d", 0, "failed"), ("d", 1, "failed"), ("d", 2, "failed")]
    got = {r["job"]: tuple(r)[1:] for r in state.after_retries(spark.createDataFrame(attempts, "job string, attempt int, status string"), "job", 2).collect()}
    assert got == {"a": (2, "completed", False), "b": (1, "qa_failed", False), "c": (1, "failed", True), "d": (3, "failed", False)}
    events = [("a", 1, "pending"), ("a", 2, "running"), ("a", 3, "completed"), ("a", 4, "failed"), ("b", 1, "running"), ("b", 2, "lost"), ("b", 3, None)]
    wrong = state.wrong_steps(spark.createDataFrame(events, "job string, n int, status string"), "job", ["n"]).collect()
    assert {(r["job"], r["n"]) for r in wrong} == {("a", 4), ("b", 2), ("b", 3)}
    hashed = lambda *rows: spark.createDataFrame(rows, "source_id string, sha256 string")
    done = spark.createDataFrame([("a", "completed"), ("b", "completed")], "source_id string, status string")
    told = state.matrix_status(hashed(("a", "1"), ("b", "2"), ("c", "3")), hashed(("a", "1"), ("b", "2")), hashed(("a", "1"), ("b", "x")), done)
    assert {tuple(r) for r in told.collect()} == {("a", "completed", True), ("b", "source_modified", False), ("c", "source_changed", None)}
    assert not state.matrix_passed(told).first()["passed"] and state.matrix_passed(told.filter("source_id = 'a'")).first()["passed"] and not state.matrix_passed(told.limit(0)).first()["passed"]


def test_backgrounds_and_sets(spark):
    rows = [("w", i, 250, 250, 250) for i in range(6)] + [("w", 9, 0, 0, 0)] + [("c", i, 100 + i % 2, 50, 10) for i in range(5)] + [("c", 9, 200, 0, 0)] + [("t", i, i * 10, i * 9, 7) for i in range(20)]
    got = {r["k"]: tuple(r)[1:] for r in rollups.local_background(spark.createDataFrame(rows, "k string, at int, r int, g int, b int"), ["k"], "at").collect()}
    assert got["w"] == (1.0, 1.0, 1.0) and got["c"] == (100 / 255, 50 / 255, 10 / 255) and got["t"] == (95 / 255, 85.5 / 255, 7 / 255)
    a, b = spark.createDataFrame([(1, None), (1, None), (2, "x")], "x int, y string"), spark.createDataFrame([(1, None), (3, "y")], "x int, y string")
    assert {tuple(r) for r in rollups.symmetric_difference(a, b).collect()} == {(2, "x", "left"), (3, "y", "right")}
