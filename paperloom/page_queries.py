"""Queries of page analysis: elements derived from the driver's tables, and SQL.

The tables hold no pages, so lines, drawings and images are derived from
lineitem and orders by the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import text
from .operators import regions, rollups, selection, state
from .plans import bands, content, page_plan
from .queries import _norm, query, split_columns
from .sources import profiles
from .sources.tables import table

_DOC, _PAGE = "CAST(floor(l_orderkey / 5) AS BIGINT) AS doc", "l_orderkey % 5 + 1 AS page"
PAGES = ["CAST(floor(o_orderkey / 5) AS BIGINT) AS doc", "o_orderkey % 5 + 1 AS page", "CAST(595 AS DOUBLE) AS width", "CAST(842 AS DOUBLE) AS height"]
FACTS = [
    "doc",
    "CASE doc % 3 WHEN 0 THEN 'physics' WHEN 1 THEN 'Biology' ELSE 'maths' END AS subject",
    "CAST(6 + doc % 5 AS STRING) AS class_name",
    "CASE doc % 4 WHEN 0 THEN '' WHEN 1 THEN 'Red Widget' WHEN 2 THEN 'Print' ELSE 'Red-Widget 1' END AS chapter",
    "CASE doc % 6 WHEN 0 THEN 'TEST' WHEN 1 THEN 'PRACTICE SHEET' WHEN 2 THEN 'KEY POINTS' ELSE 'NOTES' END AS material_type",
]
BANDS = [
    "doc",
    "CAST(40 + doc % 60 AS DOUBLE) AS header_bottom",
    "CASE WHEN doc % 4 = 0 THEN NULL ELSE CAST(700 + doc % 100 AS DOUBLE) END AS footer_top",
    "CAST(doc % 10 AS DOUBLE) / 10 AS header_confidence",
    "CAST(doc % 7 AS DOUBLE) / 7 AS footer_confidence",
]
HEADERS, FOOTERS = ("acme class #", "small print here", "class #"), ("printed by #",)
TERMS, SIDE_TERMS = ["Acme"], ["Small print", "widget"]
_TEXT = """CASE l_suppkey % 10 WHEN 0 THEN 'Page ' || l_linenumber WHEN 1 THEN 'Class ' || (6 + floor(l_orderkey / 5) % 5) WHEN 2 THEN 'Foundation Module ' || l_partkey
 WHEN 3 THEN 'ACME Class ' || l_linenumber WHEN 4 THEN 'Physics' WHEN 5 THEN 'Printed by ' || l_partkey WHEN 6 THEN 'Small print, here' WHEN 7 THEN '[' || l_linenumber || ']'
 WHEN 8 THEN ' ' ELSE 'What is a red widget ' || l_partkey END AS text"""
LINES = [_DOC, _PAGE, _TEXT, "l_partkey % 13 = 0 AS vertical", "l_extendedprice AS nth", "CAST(10 + l_partkey % 20 AS DOUBLE) AS size", "l_quantity * 11 AS x0", "l_discount * 8000 + l_linenumber AS y0", "l_quantity * 11 + l_tax * 2000 AS x1", "l_discount * 8000 + l_linenumber * 2 + l_partkey % 70 AS y1"]
DRAWINGS = [_DOC, _PAGE, "l_quantity * 3 AS x0", "l_discount * 8000 AS y0", "l_quantity * 3 + l_tax * 7000 AS x1", "l_discount * 8000 + l_partkey % 60 AS y1", "CAST(l_linenumber AS DOUBLE) AS stroke"]
IMAGES = [_DOC, _PAGE, "CAST(l_suppkey % 50 AS STRING) AS digest", "l_quantity * 10 AS x0", "l_discount * 8000 AS y0", "l_quantity * 10 + l_linenumber * 15 AS x1", "l_discount * 8000 + l_tax * 1000 + 5 AS y1"]
EXCLUDED = [*PAGES[:2], "CAST(o_custkey % 100 AS DOUBLE) AS x0", "CAST(0 AS DOUBLE) AS y0", "CAST(200 + o_custkey % 300 AS DOUBLE) AS x1", "CAST(20 + o_custkey % 400 AS DOUBLE) AS y1"]


def _sql(columns: list[str], source: str) -> str:
    # class_name || number: whole numbers print alike in both engines only as integers
    return f"SELECT {', '.join(columns)} FROM {source}".replace("(6 + floor(l_orderkey / 5) % 5)", "CAST(6 + floor(l_orderkey / 5) % 5 AS BIGINT)").replace("AS STRING", "AS VARCHAR")


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_WITH = f"""WITH pages AS ({_sql(PAGES, 'orders')}), docs AS (SELECT DISTINCT doc FROM pages), facts AS ({_sql(FACTS, 'docs')}),
bands AS (SELECT *, {_list(HEADERS)} AS header_signatures, {_list(FOOTERS)} AS footer_signatures FROM ({_sql(BANDS, 'docs')})),
lines AS ({_sql(LINES, 'lineitem')}), drawings AS ({_sql(DRAWINGS, 'lineitem')}), images AS ({_sql(IMAGES, 'lineitem')}), excluded AS ({_sql(EXCLUDED, 'orders')})"""
_SIGNATURE = r"trim(regexp_replace(" + _norm("text") + r", '\b\d+\b', '#', 'g'))"


class Elements:
    """The derived tables."""

    def __init__(self, spark: SparkSession, d: str):
        lineitem, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
        pick = lambda df, columns: df.selectExpr(*[c.replace("(6 + floor(l_orderkey / 5) % 5)", "CAST(6 + floor(l_orderkey / 5) % 5 AS BIGINT)") for c in columns])
        self.pages = pick(orders, PAGES)
        docs = self.pages.select("doc").distinct()
        self.facts = pick(docs, FACTS)
        signatures = lambda x: F.array(*map(F.lit, x))
        self.bands = pick(docs, BANDS).withColumns({"header_signatures": signatures(HEADERS), "footer_signatures": signatures(FOOTERS)})
        self.lines, self.drawings, self.images = (pick(lineitem, c) for c in (LINES, DRAWINGS, IMAGES))
        self.excluded = pick(orders, EXCLUDED)


_LABELS = f"(n = {_norm('subject')} OR n = 'class ' || class_name OR n = class_name)"
_ACADEMIC = rf"""{_WITH}, noted AS (
  SELECT l.*, height, subject, class_name, header_bottom, footer_top, header_signatures, footer_signatures, {_norm('text')} AS n, {_SIGNATURE} AS sig
  FROM lines l JOIN pages USING (doc, page) JOIN facts USING (doc) JOIN bands USING (doc)
), academic AS (
  SELECT * FROM noted
  WHERE trim(text) <> '' AND x0 < x1 AND y0 < y1 AND NOT vertical
    AND NOT (list_contains(header_signatures, sig) AND y1 <= greatest(header_bottom + 12, height * 0.20::DOUBLE))
    AND NOT ((n = '' OR contains(n, 'acme') OR {_LABELS} OR starts_with(n, 'page ') OR ((contains(n, 'module') OR contains(n, 'foundation')) AND length(n) < 80))
             AND y0 <= greatest(header_bottom + 20, height * 0.16::DOUBLE))
    AND NOT (y1 <= height * 0.16::DOUBLE AND regexp_matches(n, '{content.COURSE}'))
    AND NOT coalesce(y0 >= footer_top AND (list_contains(footer_signatures, sig) OR regexp_matches(n, '{content.PAGE_NUMBER}')), false)
)"""


@query(f"{_ACADEMIC} SELECT doc, page, min(y0) AS first_y, max(y1) AS last_y, count(*) AS n FROM academic GROUP BY doc, page")
def content_bounds(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    found = content.academic_lines(e.lines, e.pages, e.facts, e.bands, TERMS)
    return content.bounds(found).join(found.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n")), ["doc", "page"])


@query(f"{_ACADEMIC} SELECT doc, page, a.x0, a.y0, a.x1, a.y1 FROM academic a JOIN excluded x USING (doc, page) WHERE NOT (x.x0 <= a.x0 AND x.y0 <= a.y0 AND x.x1 >= a.x1 AND x.y1 >= a.y1)")
def protected_text(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    return content.protected_text(content.academic_lines(e.lines, e.pages, e.facts, e.bands, TERMS), e.excluded)


@query(f"""{_WITH}, sized AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (y0 + y1) / 2 AS m FROM drawings JOIN pages USING (doc, page) WHERE x1 - x0 >= width * 0.45::DOUBLE)
SELECT doc, page, m AS y, true AS top FROM sized WHERE h <= 16 AND m >= 4 AND m <= height * 0.28::DOUBLE
UNION ALL SELECT doc, page, CASE WHEN h <= 16 THEN m ELSE y0 END, false FROM sized
WHERE (h <= 16 AND m >= height * 0.78::DOUBLE AND m <= height - 2) OR (h > 16 AND h <= 48 AND y0 >= height * 0.78::DOUBLE AND w >= width * 0.60::DOUBLE)
""")
def wide_rules(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    return content.wide_rules(e.drawings, e.pages)


PIXELS = ["l_suppkey AS doc", "CAST(l_linenumber AS BIGINT) AS page", "CAST(floor(l_extendedprice / 500) AS BIGINT) AS row", "CAST(205 + l_quantity AS BIGINT) AS r", "CAST(250 - l_partkey % 12 AS BIGINT) AS g", "CAST(240 + l_orderkey % 15 AS BIGINT) AS b"]
_MARKED = f"""WITH pixels AS ({_sql(PIXELS, 'lineitem').replace(' row,', ' "row",')}), marked AS (
  SELECT doc, page, "row", avg(CASE WHEN least(r, g, b) < 246 OR greatest(r, g, b) - least(r, g, b) > 10 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM pixels GROUP BY ALL
  HAVING avg(CASE WHEN least(r, g, b) < 246 OR greatest(r, g, b) - least(r, g, b) > 10 THEN 1.0::DOUBLE ELSE 0 END) >= 0.97::DOUBLE
)"""


@query(f"""{_MARKED}, runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc, page ORDER BY "row" ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN "row" - lag("row") OVER (PARTITION BY doc, page ORDER BY "row") > 2 THEN 1 ELSE 0 END AS starts FROM marked)
)
SELECT doc, page, 589.4::DOUBLE + min("row") / 0.72::DOUBLE AS y, 589.4::DOUBLE + (max("row") + 1) / 0.72::DOUBLE AS bottom, round(avg(share), 9) AS strength FROM runs GROUP BY doc, page, run
HAVING (589.4::DOUBLE + (max("row") + 1) / 0.72::DOUBLE) - (589.4::DOUBLE + min("row") / 0.72::DOUBLE) >= 2
""")
def visual_bands(spark: SparkSession, d: str) -> DataFrame:
    marks = content.row_marks(table(spark, d, "lineitem").selectExpr(*PIXELS), least=0.97)
    return content.visual_bands(marks, 0.72, F.lit(589.4), least_height=2).withColumn("strength", F.round("strength", 9))


@query(f"""{_ACADEMIC} SELECT DISTINCT doc, page FROM noted
WHERE y1 <= height * 0.20::DOUBLE AND list_contains(header_signatures, sig) AND length(n) >= 8 AND NOT contains(n, 'acme') AND NOT {_LABELS}
""")
def structural_headers(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    return content.structural_headers(e.lines, e.pages, e.facts, e.bands, TERMS)


@query(f"""{_WITH}, titles AS (
  SELECT l.doc, l.page, arg_max(struct_pack(size := size, y0 := y0, wide := greatest(0, x1 - x0)), (size, -nth)) AS best
  FROM lines l JOIN facts USING (doc) WHERE {_norm('chapter')} <> '' AND contains({_norm('text')}, {_norm('chapter')}) GROUP BY l.doc, l.page
)
SELECT p.doc, p.page, best IS NOT NULL AS title_found, coalesce(best.size, 0)::DOUBLE AS title_font, coalesce(best.y0, height) AS title_y0, coalesce(best.wide / greatest(width, 1), 0)::DOUBLE AS title_width_ratio
FROM pages p LEFT JOIN titles t ON t.doc = p.doc AND t.page = p.page
""")
def title_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    return content.title_metrics(e.lines, e.pages, e.facts)


@query(f"""{_WITH}, known AS (
  SELECT *, x0 >= 0 AND y0 >= height - least(90, height * 0.13::DOUBLE) AND x1 <= width AND y1 <= height AS in_footer, x0 >= 0 AND y0 >= 0 AND x1 <= width AND y1 <= least(140, height * 0.17::DOUBLE) AS in_header
  FROM images JOIN pages USING (doc, page) WHERE digest::BIGINT IN (SELECT n_nationkey FROM nation)
)
SELECT doc, page, in_footer, greatest(0, x0 - 4)::DOUBLE AS x0, greatest(0, y0 - 4)::DOUBLE AS y0, least(width, x1 + 4) AS x1, least(height, y1 + 4) AS y1 FROM known WHERE in_footer OR in_header
""")
def verified_marks(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    digests = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("digest"))
    return content.verified_marks(e.images, digests, e.pages)


@query(f"""{_WITH}, hits AS (
  SELECT row_number() OVER () AS hit, * FROM lines JOIN pages USING (doc, page) WHERE contains(lower(text), 'acme') AND y0 <= height * 0.34::DOUBLE
), parts AS (
  SELECT doc, page, x0, y0, x1, y1, 4 AS reach, 1e9 AS limit_h FROM lines WHERE contains({_norm('text')}, 'acme') OR length({_norm('text')}) <= 2
  UNION ALL SELECT doc, page, x0, y0, x1, y1, 5, 110 FROM drawings UNION ALL SELECT doc, page, x0, y0, x1, y1, 6, 110 FROM images
), grown AS (
  SELECT h.hit, min(p.x0) AS x0, min(p.y0) AS y0, max(p.x1) AS x1, max(p.y1) AS y1 FROM hits h JOIN parts p ON p.doc = h.doc AND p.page = h.page
  WHERE p.y0 <= h.height * 0.34::DOUBLE AND p.x1 - p.x0 <= 280 AND p.y1 - p.y0 <= limit_h
    AND greatest(greatest(0, h.x0 - 30) - reach, p.x0) < least(least(h.width, h.x1 + 30) + reach, p.x1)
    AND greatest(greatest(0, h.y0 - 12) - reach, p.y0) < least(least(h.height * 0.34::DOUBLE, h.y1 + 12) + reach, p.y1)
  GROUP BY h.hit
), boxed AS (
  SELECT h.doc, h.page, h.width, h.height * 0.34::DOUBLE AS zone, least(h.x0, coalesce(g.x0, h.x0)) AS x0, least(h.y0, coalesce(g.y0, h.y0)) AS y0, greatest(h.x1, coalesce(g.x1, h.x1)) AS x1, greatest(h.y1, coalesce(g.y1, h.y1)) AS y1
  FROM hits h LEFT JOIN grown g ON g.hit = h.hit
), sized AS (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, least(greatest(x1 - x0 + 8, 92), 280) AS w, least(greatest(y1 - y0 + 6, 28), 110) AS h FROM boxed)
SELECT doc, page, greatest(0, x - w / 2)::DOUBLE AS x0, greatest(0, y - h / 2)::DOUBLE AS y0, least(width, x + w / 2) AS x1, least(zone, y + h / 2) AS y1 FROM sized
""")
def expanded_hits(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    hits = content.term_hits(e.lines, e.pages, TERMS)
    return content.expanded_hits(hits, e.lines, e.drawings, e.images, e.pages, TERMS).drop("hit")


_SIDES = " OR ".join(f"contains({_norm('text')}, '{content.norm_text(t)}')" for t in SIDE_TERMS)


@query(f"""{_WITH}, sided AS (SELECT *, {_SIDES} AS named FROM lines JOIN pages USING (doc, page) WHERE x0 < x1 AND y0 < y1 AND (x1 <= 68 OR x0 >= width - 68))
SELECT doc, page, greatest(0, x0 - 2)::DOUBLE AS x0, greatest(0, y0 - 2)::DOUBLE AS y0, least(width, x1 + 2) AS x1, least(height, y1 + 2) AS y1 FROM sided
WHERE (vertical OR (named AND y1 - y0 >= greatest(36, (x1 - x0) * 2.2::DOUBLE))) AND (named OR length({_norm('text')}) >= 12)
""")
def margin_text(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    return content.margin_text(e.lines, e.pages, SIDE_TERMS)


_TARGETS = page_plan.Layout().first_page_cleanup_targets
_TARGET = "CASE material_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _TARGETS.items()) + " END"
_R = "CASE WHEN drawn THEN {0} ELSE {1} END"


@query(f"""{_WITH}, shapes AS (
  SELECT doc, page, x0, y0, x1, y1, greatest(0.5::DOUBLE, stroke / 2) AS pad, true AS drawn FROM drawings UNION ALL SELECT doc, page, x0, y0, x1, y1, 0, false FROM images
), placed AS (
  SELECT s.doc, s.page, drawn, width, height, material_type, header_bottom, footer_top, header_confidence, footer_confidence, e.x0 AS ex0, e.y0 AS ey0, e.x1 AS ex1, e.y1 AS ey1,
    greatest(greatest(s.x0, 0) - pad, 0)::DOUBLE AS x0, greatest(greatest(s.y0, 0) - pad, 0)::DOUBLE AS y0, least(least(s.x1, width) + pad, width)::DOUBLE AS x1, least(least(s.y1, height) + pad, height)::DOUBLE AS y1
  FROM shapes s JOIN pages p ON p.doc = s.doc AND p.page = s.page JOIN facts f ON f.doc = s.doc JOIN bands b ON b.doc = s.doc JOIN excluded e ON e.doc = s.doc AND e.page = s.page
), kept AS (
  SELECT *, ex0 < x1 AND x0 < ex1 AND ey0 < y1 AND y0 < ey1 AS cut, greatest(x0, ex0) AS cx0, greatest(y0, ey0) AS cy0, least(x1, ex1) AS cx1, least(y1, ey1) AS cy1 FROM placed
  WHERE x0 < x1 AND y0 < y1
    AND NOT coalesce(x1 - x0 >= width * 0.60::DOUBLE AND y1 - y0 <= 60 AND footer_confidence >= 0.65::DOUBLE AND y0 >= footer_top - 3, false)
    AND NOT (drawn AND (
      (x1 - x0 >= width * 0.80::DOUBLE AND y1 - y0 >= height * 0.80::DOUBLE) OR (x1 - x0 >= width * 0.45::DOUBLE AND y1 - y0 <= 45 AND header_confidence >= 0.65::DOUBLE AND y1 <= header_bottom + 3)
      OR coalesce(page = 1 AND y1 <= {_TARGET} + 1 AND x0 >= width * 0.30::DOUBLE AND x1 <= width * 0.70::DOUBLE AND x1 - x0 <= width * 0.48::DOUBLE AND y1 - y0 <= height * 0.13::DOUBLE, false)
      OR (ex0 <= x0 AND ey0 <= y0 AND ex1 >= x1 AND ey1 >= y1)))
), pieces AS (
  SELECT doc, page, x0, y0, x1, y1 FROM kept WHERE NOT cut
  UNION ALL SELECT doc, page, x0, y0, x1, cy0 FROM kept WHERE cut UNION ALL SELECT doc, page, x0, cy1, x1, y1 FROM kept WHERE cut
  UNION ALL SELECT doc, page, x0, cy0, cx0, cy1 FROM kept WHERE cut UNION ALL SELECT doc, page, cx1, cy0, x1, cy1 FROM kept WHERE cut
)
SELECT * FROM pieces WHERE x1 - x0 > 0.1::DOUBLE AND y1 - y0 > 0.1::DOUBLE
""")
def protected_visual(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    return content.protected_visual(e.drawings, e.images, e.pages, e.facts, e.bands, e.excluded, _TARGETS)


TYPED = [
    "o_orderkey", "o_orderkey % 11 = 0 AS blank", "o_orderkey % 3 + 1 AS page", "CASE o_custkey % 4 WHEN 0 THEN 'KEY POINTS' WHEN 1 THEN 'TEST' ELSE 'NOTES' END AS material_type", "o_custkey % 3 > 0 AS title_on_page", "o_custkey % 5 > 0 AS title_found",
    "CAST(10 + o_custkey % 14 AS DOUBLE) AS title_font", "CAST(o_orderkey % 400 AS DOUBLE) AS title_y0", "CAST(o_custkey % 60 AS DOUBLE) / 100 AS title_width_ratio", "CAST(842 AS DOUBLE) AS height", "CAST(o_orderkey % 20 AS DOUBLE) / 200 AS large_image_ratio",
    "o_orderkey % 2 AS n_images", "o_orderkey % 7 AS n_drawings", "o_custkey % 7 = 0 AS structural_header", "CAST(o_custkey % 90 AS DOUBLE) / 100 AS dark_ratio",
]


@query(f"""WITH t AS ({_sql(TYPED, 'orders')})
SELECT o_orderkey, CASE WHEN blank THEN 'blank'
  WHEN page = 1 AND material_type = 'NOTES' AND title_on_page AND title_found AND title_font >= 17 AND title_y0 <= height * 0.30::DOUBLE
    AND (large_image_ratio >= 0.075::DOUBLE OR n_images >= 1 OR n_drawings >= 4 OR title_font >= 17 * 1.20::DOUBLE OR title_width_ratio >= 0.42::DOUBLE) AND NOT structural_header THEN 'designed'
  WHEN material_type = 'KEY POINTS' THEN 'designed' WHEN dark_ratio >= 0.45::DOUBLE THEN 'dark' ELSE 'standard' END AS page_type FROM t
""")
def page_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*TYPED).select("o_orderkey", page_plan.page_type().alias("page_type"))


COLOURS = ["l_suppkey AS doc", "l_orderkey * 10 + l_linenumber AS pos", "CAST(l_quantity * 5 AS BIGINT) AS r", "CAST(200 + l_suppkey % 3 * 25 AS BIGINT) AS g", "CAST(l_discount * 100 AS BIGINT) * 8 AS b"]
COLOURS_SQL = [c.replace("CAST(l_discount * 100 AS BIGINT)", "trunc(l_discount * 100)::BIGINT").replace("CAST(l_quantity * 5 AS BIGINT)", "trunc(l_quantity * 5)::BIGINT") for c in COLOURS]


@query(f"""WITH p AS (SELECT {', '.join(COLOURS_SQL)} FROM lineitem), coarse AS (
  SELECT doc, floor(r / 8) AS br, floor(g / 8) AS bg, floor(b / 8) AS bb, count(*) AS n, min(pos) AS first, median(r) AS r, median(g) AS g, median(b) AS b FROM p GROUP BY 1, 2, 3, 4
), best AS (SELECT doc, arg_max(struct_pack(n := n, r := r, g := g, b := b), (n, -first)) AS best FROM coarse GROUP BY doc),
whole AS (SELECT doc, count(*) AS n, avg(CASE WHEN r > 240 AND g > 240 AND b > 240 THEN 1.0::DOUBLE ELSE 0 END) AS white, median(r) AS r, median(g) AS g, median(b) AS b FROM p GROUP BY doc)
SELECT doc, CASE WHEN white >= 0.55::DOUBLE THEN 1 WHEN best.n / n >= 0.08::DOUBLE AND best.n >= 3 THEN best.r / 255 ELSE r / 255 END::DOUBLE AS r,
  CASE WHEN white >= 0.55::DOUBLE THEN 1 WHEN best.n / n >= 0.08::DOUBLE AND best.n >= 3 THEN best.g / 255 ELSE g / 255 END::DOUBLE AS g,
  CASE WHEN white >= 0.55::DOUBLE THEN 1 WHEN best.n / n >= 0.08::DOUBLE AND best.n >= 3 THEN best.b / 255 ELSE b / 255 END::DOUBLE AS b
FROM whole JOIN best USING (doc)
""")
def local_background(spark: SparkSession, d: str) -> DataFrame:
    return rollups.local_background(table(spark, d, "lineitem").selectExpr(*COLOURS), ["doc"], "pos")


_ATTEMPTS = "o_custkey AS job, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS attempt, CASE WHEN o_orderkey % 3 > 0 THEN 'failed' WHEN o_custkey % 2 = 0 THEN 'qa_failed' ELSE 'completed' END AS status"


@query(f"""WITH a AS (SELECT {_ATTEMPTS} FROM orders), ends AS (SELECT job, min(attempt) FILTER (status <> 'failed') AS e, arg_min(status, attempt) FILTER (status <> 'failed') AS s, max(attempt) AS l FROM a WHERE attempt <= 3 GROUP BY job)
SELECT job, coalesce(e, l) + 1 AS attempts, coalesce(s, 'failed') AS status, e IS NULL AND l < 3 AS again FROM ends
""")
def retry_policy(spark: SparkSession, d: str) -> DataFrame:
    attempts = table(spark, d, "orders").selectExpr(*split_columns(_ATTEMPTS))
    return state.after_retries(attempts, "job", 3)


_STEPS = "user_id AS job, event_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'lost' END AS status"


@query(f"""WITH e AS (SELECT {_STEPS}, ts FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY ts, event_id) AS before FROM e)
SELECT job, event_id, status, before FROM b WHERE status = 'lost' OR (before = 'pending' AND status NOT IN ('running')) OR (before IN ('completed', 'failed', 'lost') AND status NOT IN ('pending', 'running'))
  OR (before = 'running' AND status NOT IN ('running', 'completed', 'failed'))
""")
def wrong_steps(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").selectExpr(*split_columns(_STEPS), "ts")
    return state.wrong_steps(events, "job", ["ts", "event_id"]).select("job", "event_id", "status", "before")


@query("""
SELECT p_partkey AS source_id, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 10 = 9 THEN 'source_changed' WHEN p_partkey % 5 = 0 THEN 'source_modified' WHEN p_partkey % 3 = 0 THEN 'qa_failed' ELSE 'completed' END AS status,
       CASE WHEN p_partkey % 7 = 0 OR p_partkey % 10 = 9 THEN NULL ELSE p_partkey % 5 <> 0 END AS preserved FROM part
""")
def matrix_run(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    i = F.col("p_partkey")
    hashed = lambda salt: part.select(i.alias("source_id"), text.content_hash(F.concat("p_name", F.when(salt, F.lit("!")).otherwise(F.lit("")))).alias("sha256"))
    now = hashed(i % 7 == 0).filter("source_id % 10 <> 9")
    results = part.select(i.alias("source_id"), F.when(i % 3 == 0, "qa_failed").otherwise("completed").alias("status"))
    return state.matrix_status(hashed(F.lit(False)), now, hashed((i % 7 == 0) | (i % 5 == 0)), results)


@query(f"WITH lines AS ({_sql(LINES, 'lineitem')}) SELECT doc, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lines GROUP BY doc, page")
def rect_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rect_bounds(Elements(spark, d).lines, ["doc", "page"])


@query("SELECT source, list_sort(list_distinct(list(CASE WHEN n_chars > 3000 THEN 'dense_text' ELSE 'short' END) || list(lang)))::VARCHAR AS flags FROM documents GROUP BY source")
def document_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.array(F.when(F.col("n_chars") > 3000, "dense_text").otherwise("short"), F.col("lang")).alias("flags"))
    found = rollups.distinct_members(docs, ["source"], "flags")
    return found.select("source", F.concat(F.lit("["), F.array_join("flags", ", "), F.lit("]")).alias("flags"))


@query("""
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT *, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' AS side FROM (FROM b EXCEPT FROM a)
""")
def run_difference(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    of = lambda odd: lines.filter(F.col("l_linenumber") % 2 == odd).select("l_partkey", "l_suppkey")
    return rollups.symmetric_difference(of(0), of(1))


_CROP = """CAST(500 + o_custkey % 100 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height, CAST(o_orderkey % 120 AS DOUBLE) AS top, CAST(o_custkey % 90 AS DOUBLE) AS bottom, CAST(o_orderkey % 76 AS DOUBLE) AS header, CAST(780 - o_custkey % 40 AS DOUBLE) AS footer"""


@query(f"""WITH c AS (SELECT o_orderkey, {_CROP} FROM orders), s AS (SELECT *, least(1, (footer - header) / (height - top - bottom))::DOUBLE AS scale FROM c)
SELECT o_orderkey, scale, (width - width * scale) / 2 AS dx, header + ((footer - header) - (height - top - bottom) * scale) / 2 - top * scale AS dy, height - bottom AS clip_bottom FROM s
""")
def crop_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", *_CROP.split(", "))
    crop = g.crop_geometry(*[F.col(c) for c in ("width", "height", "top", "bottom", "header", "footer")])
    return rows.select("o_orderkey", crop.alias("c")).select("o_orderkey", "c.scale", "c.dx", "c.dy", F.col("c.clip.y1").alias("clip_bottom"))


@query(f"""{_WITH}, w AS (SELECT *, nth AS word_id FROM lines WHERE x0 < x1 AND y0 < y1), i AS (SELECT *, (x0 + y0)::BIGINT AS number FROM images)
SELECT w.doc, w.page, word_id, max(i.number) AS number FROM w JOIN i ON w.doc = i.doc AND w.page = i.page
WHERE least(w.x1, i.x1) - greatest(w.x0, i.x0) >= 0.88::DOUBLE * (w.x1 - w.x0) AND (i.x1 - i.x0) / (w.x1 - w.x0) BETWEEN 0.6::DOUBLE AND 1.2::DOUBLE AND least(w.y1, i.y1) - greatest(w.y0, i.y0) >= 0.35::DOUBLE * (w.y1 - w.y0)
GROUP BY ALL
""")
def word_images(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    words = e.lines.filter("x0 < x1 AND y0 < y1").withColumnRenamed("nth", "word_id")
    images = e.images.withColumn("number", F.round(F.col("x0") + F.col("y0")).cast("long"))
    return regions.brand_above_number(words, images)


@query(f"""{_WITH}, o AS (SELECT doc, page, digest AS image, x0, y0, x1, y1 FROM images),
loose AS (SELECT doc, image FROM o WHERE NOT EXISTS (SELECT 1 FROM excluded r WHERE r.doc = o.doc AND r.page = o.page AND r.x0 <= o.x0 AND r.y0 <= o.y0 AND r.x1 >= o.x1 AND r.y1 >= o.y1))
SELECT DISTINCT doc, image FROM o WHERE (doc, image) NOT IN (SELECT (doc, image) FROM loose)
""")
def authorised_images(spark: SparkSession, d: str) -> DataFrame:
    e = Elements(spark, d)
    return regions.authorised(e.images.withColumnRenamed("digest", "image"), e.excluded)


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/' ELSE 'a b/' END || p_brand || '/' || p_name || ' ' || p_partkey || '.pdf' AS path FROM part)
SELECT row_number() OVER (ORDER BY string_split(path, '/')) AS nth, path FROM p WHERE contains(lower(path), 'bolt') ORDER BY 1 LIMIT 50
""")
def first_in_path_order(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("p_partkey") % 3 == 0, F.lit("a/")).otherwise(F.lit("a b/"))
    paths = table(spark, d, "part").select(F.concat(folder, "p_brand", F.lit("/"), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"))
    return selection.first_paths(paths.filter(F.contains(F.lower("path"), F.lit("bolt"))), 50)


#: Bands: text, rules and strips that repeat at about the same place on a document's pages.
PAGED = ["CAST(floor(o_orderkey / 5) AS BIGINT) AS doc", "o_orderkey % 5 + 1 AS page", "CAST(842 AS DOUBLE) AS height", "o_custkey AS c", "o_orderkey AS k"]
BLOCK_KINDS = (
    ("c % 3 > 0", "'ACME, class ' || k", "20 + c % 3", "30 + c % 7"),
    ("c % 4 = 1", "'Small print ' || page", "60 + c % 50", "70 + c % 50"),
    ("c % 7 > 1", "'Page ' || page", "815 + c % 5", "825 + c % 5"),
    ("true", "'Text number ' || k || ' of ' || CASE c % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END", "300", "310"),
)
RULE_KINDS = (("c % 5 > 1", "46 + c % 4", "true"), ("c % 2 = 0", "150 + c % 3", "true"), ("c % 3 = 1", "800 + c % 4", "false"))
STRIP = ("c % 2 = 1", "790 + c % 6", "CAST(c % 8 AS DOUBLE) / 8")


def _kinds(kinds: tuple, names: tuple[str, ...]) -> list[str]:
    cast = lambda v, n: f"CAST({v} AS DOUBLE) AS {n}" if n.startswith("y") else f"{v} AS {n}"
    return [", ".join(["doc", "page", *[cast(v, n) for v, n in zip(kind[1:], names)]]) + f" FROM paged WHERE {kind[0]}" for kind in kinds]


_BLOCKS, _RULES, _STRIPS = _kinds(BLOCK_KINDS, ("text", "y0", "y1")), _kinds(RULE_KINDS, ("y", "top")), _kinds((STRIP,), ("y", "strength"))
_NUMBERED = [b.replace("doc, page,", f"doc, page, {n} AS nth,", 1) for n, b in enumerate(_BLOCKS)]


@query(f"""WITH paged AS ({_sql(PAGED, 'orders')}), docs AS (SELECT doc, min(page) AS first, count(DISTINCT page) AS n FROM paged GROUP BY doc),
known AS (SELECT *, CASE WHEN n >= 4 THEN n - 1 ELSE n END AS sampled FROM docs), limits AS (SELECT *, greatest(CASE WHEN sampled >= 2 THEN 2 ELSE 1 END, ceil(sampled * 0.45::DOUBLE)) AS threshold FROM known WHERE n > 1),
chosen AS (SELECT p.doc, p.page, height FROM paged p JOIN limits USING (doc) WHERE n < 4 OR p.page <> first),
blocks AS (SELECT {' UNION ALL SELECT '.join(_NUMBERED)}), rules AS (SELECT {' UNION ALL SELECT '.join(_RULES)}), strips AS (SELECT {_STRIPS[0]}),
signed AS (SELECT b.*, height, {_SIGNATURE} AS sig FROM blocks b JOIN chosen USING (doc, page)),
zones AS (SELECT doc, 'h' AS zone, sig, page, y1 AS y, nth FROM signed WHERE y1 <= height * 0.22::DOUBLE AND length(sig) >= 3 UNION ALL SELECT doc, 'f', sig, page, y0, nth FROM signed WHERE y0 >= height * 0.82::DOUBLE AND length(sig) >= 3),
sigs AS (SELECT z.doc, zone, sig, count(DISTINCT page) / any_value(sampled) AS support, list(y) AS ys, median(y) AS middle, min((page, nth)) AS seen FROM zones z JOIN limits USING (doc) GROUP BY z.doc, zone, sig HAVING count(DISTINCT page) >= any_value(threshold)),
-- the derived lines lie in groups further apart than the tolerance, so a group is a cluster
marks AS (SELECT doc, page, y, CASE WHEN NOT top THEN 'bottom' WHEN y < 100 THEN 'top1' ELSE 'top2' END AS kind, 1::DOUBLE AS strength FROM rules UNION ALL SELECT doc, page, y, 'strip', strength FROM strips),
clusters AS (SELECT m.doc, kind, median(y) AS y, count(DISTINCT m.page) / any_value(sampled) AS support, avg(strength) AS strength FROM marks m JOIN chosen c ON c.doc = m.doc AND c.page = m.page JOIN limits l ON l.doc = m.doc GROUP BY m.doc, kind HAVING count(DISTINCT m.page) >= any_value(threshold)),
tops AS (SELECT doc, coalesce(max(y) FILTER (support >= 0.6::DOUBLE), max(y)) AS y, max(support) AS support FROM clusters WHERE kind IN ('top1', 'top2') GROUP BY doc),
bottoms AS (SELECT doc, min(y) AS y, max(support) AS support FROM clusters WHERE kind = 'bottom' GROUP BY doc), visuals AS (SELECT doc, min(y) AS y, max(support) AS support FROM clusters WHERE kind = 'strip' AND strength >= 0.5::DOUBLE GROUP BY doc),
kept AS (SELECT s.* FROM sigs s LEFT JOIN tops t USING (doc) WHERE zone = 'f' OR t.y IS NULL OR middle <= t.y + 10),
texts AS (SELECT doc, zone, max(support) AS support, string_agg(sig, '|' ORDER BY seen, sig) AS names FROM kept GROUP BY doc, zone), middles AS (SELECT doc, zone, median(y) AS y FROM (SELECT doc, zone, unnest(ys) AS y FROM kept) GROUP BY doc, zone)
SELECT d.doc, greatest(0, hm.y + 4, t.y + 2)::DOUBLE AS header_bottom, least(fm.y - 3, b.y - 2, v.y)::DOUBLE AS footer_top, least(0.99::DOUBLE, greatest(0, h.support, t.support))::DOUBLE AS header_confidence,
  least(0.99::DOUBLE, greatest(0, f.support, b.support, v.support))::DOUBLE AS footer_confidence, coalesce(h.names, '') AS header_signatures, coalesce(f.names, '') AS footer_signatures
FROM known d LEFT JOIN texts h ON h.doc = d.doc AND h.zone = 'h' LEFT JOIN texts f ON f.doc = d.doc AND f.zone = 'f' LEFT JOIN middles hm ON hm.doc = d.doc AND hm.zone = 'h' LEFT JOIN middles fm ON fm.doc = d.doc AND fm.zone = 'f'
  LEFT JOIN tops t ON t.doc = d.doc LEFT JOIN bottoms b ON b.doc = d.doc LEFT JOIN visuals v ON v.doc = d.doc
""")
def band_detection(spark: SparkSession, d: str) -> DataFrame:
    paged = table(spark, d, "orders").selectExpr(*PAGED)

    def of(kinds: list[str]) -> DataFrame:
        found = None
        for kind in kinds:
            columns, where = kind.split(" FROM paged WHERE ")
            part = paged.filter(where).selectExpr(*split_columns(columns))
            found = part if found is None else found.unionByName(part)
        return found

    found = bands.detect_bands(paged.select("doc", "page", "height"), of(_NUMBERED), of(_RULES), of(_STRIPS))
    return found.withColumns({c: F.array_join(c, "|") for c in ("header_signatures", "footer_signatures")})



_LEAVES = """c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'layout.header_height' WHEN 1 THEN 'layout.dark_page_threshold' WHEN 2 THEN 'colors.navy' WHEN 3 THEN 'qa.text_is_error' WHEN 4 THEN 'qa.min_body_ratio'
 WHEN 5 THEN 'legacy.raster_logo_digests.3' WHEN 6 THEN 'id' WHEN 7 THEN 'legacy.terms' ELSE 'other.value' END AS path, CASE c_custkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'flag' ELSE 'list' END AS kind,
 CASE c_custkey % 5 WHEN 0 THEN '#00ff' || (10 + c_custkey % 90) WHEN 1 THEN repeat('0a', 16) WHEN 2 THEN ' ' ELSE c_name END AS text, c_acctbal / CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 10000 END AS number"""


@query(f"""WITH l AS (SELECT {_LEAVES} FROM customer), r AS (
  SELECT *, CASE path WHEN 'layout.header_height' THEN 'number' WHEN 'layout.dark_page_threshold' THEN 'number' WHEN 'colors.navy' THEN 'colour' WHEN 'qa.text_is_error' THEN 'flag' WHEN 'qa.min_body_ratio' THEN 'number'
    WHEN 'legacy.raster_logo_digests.3' THEN 'digest' WHEN 'id' THEN 'text' WHEN 'legacy.terms' THEN 'list' END AS rule, CASE WHEN path IN ('layout.dark_page_threshold', 'qa.min_body_ratio') THEN 1 ELSE 1000 END AS most FROM l
)
SELECT c_custkey, path, rule, CASE rule WHEN 'number' THEN kind = 'number' AND number BETWEEN 0 AND most WHEN 'colour' THEN kind = 'text' AND regexp_matches(text, '^#?[0-9a-fA-F]{{6}}$') WHEN 'flag' THEN kind = 'flag'
  WHEN 'digest' THEN kind = 'text' AND regexp_matches(text, '^[0-9a-f]{{32}}$') WHEN 'text' THEN kind = 'text' AND trim(text) <> '' WHEN 'list' THEN kind = 'list' AND number BETWEEN 1 AND 1000 ELSE true END AS ok FROM r
""")
def profile_rules(spark: SparkSession, d: str) -> DataFrame:
    return profiles.checked(table(spark, d, "customer").selectExpr(*split_columns(_LEAVES))).select("c_custkey", "path", "rule", "ok")
