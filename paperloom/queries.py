"""The operators of the library over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import geometry as g
from .functions import rules, text
from .operators import clusters, intervals, matching, rects, regions, repeats, rollups, selection, state
from .plans import audit, classify, page_plan
from .sources import manifests
from .sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


NORM = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def split_columns(listed: str) -> list[str]:
    """Columns of a select list; commas inside quotes and parentheses do not part them."""
    out, depth, quoted, begin = [], 0, False, 0
    for i, c in enumerate(listed):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not quoted and not depth:
            out.append(listed[begin:i].strip())
            begin = i + 1
    return [*out, listed[begin:].strip()]


def _norm(c: str) -> str:
    return NORM.format(c)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"SELECT doc_id, {_norm('text')} AS normalised FROM documents")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.norm(F.col("text")).alias("normalised"))


@query(rf"""
WITH pages AS (
  SELECT source, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM documents GROUP BY source
), sampled AS (
  SELECT *, CASE WHEN n >= 4 THEN n - 1 ELSE n END AS sampled FROM pages
), lines AS (
  SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), signed AS (
  SELECT source, doc_id, trim(regexp_replace({_norm('line')}, '\b\d+\b', '#', 'g')) AS signature FROM lines
), counted AS (
  SELECT s.source, signature, count(DISTINCT doc_id) AS support
  FROM signed s JOIN sampled p ON s.source = p.source
  WHERE length(signature) >= 3 AND (p.n < 4 OR doc_id <> p.first)
  GROUP BY s.source, signature HAVING count(DISTINCT doc_id) >= 2
)
SELECT c.source, signature, support, sampled, support::DOUBLE / sampled AS ratio,
       greatest(CASE WHEN sampled >= 2 THEN 2 ELSE 1 END, ceil(sampled * 0.45::DOUBLE))::BIGINT AS threshold,
       support >= greatest(CASE WHEN sampled >= 2 THEN 2 ELSE 1 END, ceil(sampled * 0.45::DOUBLE)) AND n > 1 AS is_repeated
FROM counted c JOIN sampled p ON c.source = p.source
""")
def repeated_signatures(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    return repeats.repeated_signatures(lines).withColumnRenamed("doc", "source")


@query(r"""
WITH tokens AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS token FROM conversations
), counts AS (
  SELECT conv_id, turn, token, count(*) AS c FROM tokens GROUP BY ALL
)
SELECT x.conv_id, x.turn, sum(least(x.c, coalesce(y.c, 0)))::DOUBLE / sum(x.c)::DOUBLE AS retention
FROM counts x LEFT JOIN counts y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 AND x.token = y.token
GROUP BY x.conv_id, x.turn
""")
def text_retention(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.word_tokens(F.col("text"))).alias("token"))
    following = turns.withColumn("turn", F.col("turn") - 1)
    return rollups.multiset_retention(turns, following, ["conv_id", "turn"])


@query("""
WITH marked AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events
), numbered AS (
  SELECT *, sum(CASE WHEN us - before > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM marked
)
SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM numbered GROUP BY user_id, cluster
""")
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    found = clusters.gap_clusters(events, ["user_id"], "us", F.lit(7_200_000_000), "event_id")
    return found.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("""
WITH RECURSIVE ordered AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i FROM events WHERE value IS NOT NULL
), walk AS (
  SELECT user_id, i, value, value AS total, 1::BIGINT AS n, 0::BIGINT AS cluster FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.user_id, o.i, o.value,
         CASE WHEN abs(o.value - w.total / w.n) <= 4 THEN w.total + o.value ELSE o.value END,
         CASE WHEN abs(o.value - w.total / w.n) <= 4 THEN w.n + 1 ELSE 1 END,
         CASE WHEN abs(o.value - w.total / w.n) <= 4 THEN w.cluster ELSE w.cluster + 1 END
  FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.i = w.i + 1
)
SELECT user_id, cluster, min(value) AS lo, max(value) AS hi, count(*) AS n FROM walk GROUP BY user_id, cluster
""")
def mean_linkage_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.mean_linkage_rows(table(spark, d, "events"), ["user_id"], "value", 4.0)


@query("""
SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) AS n
FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority AND o.o_totalprice > 300000
GROUP BY ALL
""")
def zero_filled_grid(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return selection.zero_filled(orders.filter("o_totalprice > 300000"), orders.select("o_orderstatus").distinct(), orders.select("o_orderpriority").distinct())


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return state.current_state(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"], F.col("event_type") == "click")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value,
       count(*) FILTER (event_type = 'click') AS attempts
FROM events GROUP BY user_id
""")
def latest_job_state(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).drop("last")


@query("""
WITH jobs AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id)
SELECT CASE WHEN status = 'click' THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1
""")
def recovered_snapshot(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).select("user_id", F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("status"))
    return state.snapshot(state.recovered(jobs))


@query("""
WITH jobs AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id)
SELECT CASE WHEN bool_or(status = 'error') THEN 2 ELSE 0 END AS exit_code FROM jobs
""")
def job_exit_code(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).select(F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("status"))
    return state.exit_code(jobs)


@query("""
WITH jobs AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id)
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM jobs WHERE status = 'purchase')
""")
def retry_selection(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "purchase", "failed").otherwise("completed").alias("status"))
    return state.to_retry(table(spark, d, "customer").select("c_custkey"), jobs, "c_custkey")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT doc_id, substr(sha256(lower(source || '/' || doc_id)), 1, 20) AS short_id FROM documents")
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.short_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("short_id"))


@query("""
SELECT doc_id, doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AS is_fresh FROM documents
""")
def cache_freshness(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("sha", text.content_hash(F.col("text")))
    k = F.concat(F.lit("Doc/"), F.col("doc_id").cast("string"))
    now = docs.select("doc_id", k.alias("key"), F.col("n_chars").alias("size"), F.lit(1).cast("long").alias("mtime"), "sha", F.col("sha").alias("output_sha"), (F.col("doc_id") % 11 == 0).alias("pending"))
    cache = docs.filter("doc_id % 7 <> 0").select(F.upper(k).alias("key"), F.lit("p").alias("profile_hash"), F.lit("1").alias("engine_version"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).cast("long").alias("mtime"), F.when(F.col("doc_id") % 5 == 0, F.lit("other")).otherwise(F.col("sha")).alias("sha"), F.col("sha").alias("output_sha"), F.lit(True).alias("qa_passed"))
    return state.fresh(now, cache, "p", "1").select("doc_id", "is_fresh")


@query("""
WITH merged AS (
  SELECT o_custkey, o_orderkey, o_totalprice, 0 AS new FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 2 = 1
)
SELECT o_custkey, arg_max(o_orderkey, (o_orderkey, new)) AS o_orderkey, arg_max(o_totalprice, (o_orderkey, new)) AS o_totalprice FROM merged GROUP BY o_custkey
""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return state.upsert(orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey")


@query("""
SELECT p_partkey, p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AS reused, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN p_type END AS family FROM part
""")
def inventory_reuse(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    path = F.col("p_partkey")
    files = part.select(path.alias("path"), F.col("p_size").cast("long").alias("size"), F.lit(7).cast("long").alias("mtime_ns"))
    before = part.filter("p_partkey % 4 <> 0").select(path.alias("path"), F.col("p_size").cast("long").alias("size"), F.when(path % 3 == 0, 8).otherwise(7).cast("long").alias("mtime_ns"), F.col("p_type").alias("family"), F.lit("/r").alias("root"), F.lit(1).alias("schema_version"), F.lit("s").alias("signature"))
    return state.inventory_reuse(files, before, "/r", 1, "s").select(F.col("path").alias("p_partkey"), "reused", "family")


@query("""
WITH runs AS (
  SELECT l_suppkey AS workers, count(*)::DOUBLE AS elapsed, max(l_quantity) * 10 + l_suppkey % 60 AS peak, bool_and(l_quantity <= 50) AS ok FROM lineitem GROUP BY l_suppkey
), fits AS (SELECT * FROM runs WHERE ok AND peak <= 1080 / 2)
SELECT coalesce(min(workers) FILTER (elapsed <= (SELECT min(elapsed) FROM fits) * 1.1::DOUBLE), 1) AS workers FROM fits
""")
def worker_recommendation(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("workers")).agg(F.count(F.lit(1)).cast("double").alias("elapsed"), F.max("l_quantity").alias("q"), F.bool_and(F.col("l_quantity") <= 50).alias("ok"))
    runs = runs.withColumn("peak", F.col("q") * 10 + F.col("workers") % 60)
    return state.recommend_workers(runs, F.lit(1080.0))


_PART_RULES = (("PLATED", ("steel", "plated")), ("POLISHED", ("polished",)), ("METAL", ("brass", "copper", "nickel")), ("SMALL", ("small",)))


def _phrases(column: str, table_rules, otherwise: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({column}, {_sql_text(p)})" for p in phrases) + f" THEN {_sql_text(label)}" for label, phrases in table_rules)
    return f"CASE {cases} ELSE {_sql_text(otherwise)} END"


@query(f"SELECT p_partkey, {_phrases(_norm('p_type'), _PART_RULES, 'OTHER')} AS label FROM part")
def ordered_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.phrase_rules(text.norm(F.col("p_type")), _PART_RULES, "OTHER").alias("label"))


_STEM = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' Practice_Sheet' WHEN 1 THEN ' race solutions' WHEN 2 THEN ' Key-Points' WHEN 3 THEN ' NCERT Solutions' WHEN 4 THEN '_test_' ELSE '' END"
_MATERIAL = _phrases("(' ' || " + _norm("stem") + " || ' ')", rules.MATERIAL_RULES, rules.DEFAULT_MATERIAL)
_TYPE = "CASE material " + " ".join(f"WHEN {_sql_text(k)} THEN {_sql_text(v)}" for k, v in rules.DOCUMENT_TYPES.items()) + " ELSE 'normal' END"
_TEMPLATE = "CASE " + " ".join(f"WHEN material IN ({', '.join(map(_sql_text, v))}) THEN {_sql_text(k)}" for k, v in rules.HEADER_TEMPLATES.items()) + " ELSE 'notes' END"


@query(f"""
WITH stems AS (SELECT p_partkey, p_name, {_STEM} AS stem FROM part), typed AS (SELECT p_partkey, p_name, {_MATERIAL} AS material FROM stems)
SELECT p_partkey, material, {_TYPE} AS document_type, {_TEMPLATE} AS header_template,
       CASE WHEN material = 'NOTES' THEN p_name WHEN material = 'KEY POINTS' THEN p_name || ' — KEY POINTS' ELSE material || '  ·  ' || p_name END AS label
FROM typed
""")
def material_types(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").selectExpr("p_partkey", "p_name", f"{_STEM} AS stem").withColumn("material", rules.material_type(F.col("stem")))
    m = F.col("material")
    return named.select("p_partkey", "material", rules.document_type(m).alias("document_type"), rules.header_template(m).alias("header_template"), rules.header_label(m, F.col("p_name")).alias("label"))


_FOLDER = "CASE c_custkey % 5 WHEN 0 THEN (c_custkey % 12) || 'th class' WHEN 1 THEN 'Class ' || (c_custkey % 12) WHEN 2 THEN CAST(c_custkey % 12 AS STRING) WHEN 3 THEN 'std_' || (c_custkey % 12) ELSE c_name END"
_CLASS = "coalesce(" + ", ".join(f"nullif(regexp_extract({_norm('folder')}, {_sql_text(p)}, 1), '')" for p in text.CLASS_PATTERNS) + ")"


@query(f"WITH f AS (SELECT c_custkey, {_FOLDER} AS folder FROM customer) SELECT c_custkey, {_CLASS} AS class_name FROM f")
def class_numbers(spark: SparkSession, d: str) -> DataFrame:
    folders = table(spark, d, "customer").selectExpr("c_custkey", f"{_FOLDER} AS folder")
    return folders.select("c_custkey", text.class_number(F.col("folder")).alias("class_name"))


@query(r"""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE (p_partkey % 40) || '  ' || p_name END AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '^\s*(\d+)\s+(.*)$') THEN trim(regexp_extract(name, '^\s*(\d+)\s+(.*)$', 2)) ELSE trim(name) END AS chapter,
       nullif(regexp_extract(name, '^\s*(\d+)\s+(.*)$', 1), '') AS number, upper(regexp_replace(upper(name), '[^A-Z]', '', 'g')) AS brand,
       trim(regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), '^\d+\s+', '')) AS stripped
FROM n
""")
def chapter_split(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE (p_partkey % 40) || '  ' || p_name END AS name")
    n = F.col("name")
    return part.select("p_partkey", text.chapter_name(n).alias("chapter"), text.chapter_number(n).alias("number"), text.brand_token(n).alias("brand"), text.strip_chapter_number(n).alias("stripped"))


_EXAM = "'Estimate Time : ' || (o_orderkey % 90) || CASE o_orderkey % 3 WHEN 0 THEN ' minutes' WHEN 1 THEN 'hrs' ELSE '' END || ' Max. Marks-' || (o_orderkey % 100) || ' ' || o_orderpriority"


@query(rf"""
WITH t AS (SELECT o_orderkey, {_EXAM} AS t FROM orders)
SELECT o_orderkey, nullif(trim(regexp_extract(t, '{text.DURATION}', 1)), '') AS duration, nullif(trim(regexp_extract(t, '{text.MARKS}', 1)), '') AS max_marks FROM t
""")
def duration_and_marks(spark: SparkSession, d: str) -> DataFrame:
    exams = table(spark, d, "orders").selectExpr("o_orderkey", f"{_EXAM} AS t")
    return exams.select("o_orderkey", text.duration(F.col("t")).alias("duration"), text.max_marks(F.col("t")).alias("max_marks"))


@query("""
SELECT p_partkey, (p_size * 5 % 256)::DOUBLE / 255 AS r, (p_partkey % 256)::DOUBLE / 255 AS g, (p_size % 256)::DOUBLE / 255 AS b,
       ((p_size * 5 % 256)::DOUBLE * 0.2126::DOUBLE + (p_partkey % 256)::DOUBLE * 0.7152::DOUBLE) + (p_size % 256)::DOUBLE * 0.0722::DOUBLE AS luma
FROM part
""")
def colours(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    r, gg, b = F.col("p_size") * 5 % 256, F.col("p_partkey") % 256, F.col("p_size") % 256
    hexed = F.concat(F.lit("#"), *[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, gg, b)])
    return part.select("p_partkey", text.hex_rgb(hexed).alias("c"), text.luma(r.cast("double"), gg.cast("double"), b.cast("double")).alias("luma")).select("p_partkey", "c.*", "luma")


@query("""
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS kind, coalesce(lang, source) AS key, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())
""")
def grouping_summary(spark: SparkSession, d: str) -> DataFrame:
    return rollups.counts_by(table(spark, d, "documents"), "lang", "source")


@query("SELECT l_suppkey, median(l_quantity) AS median_quantity, median(l_extendedprice) AS median_price FROM lineitem GROUP BY l_suppkey")
def medians(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    of = lambda c, name: rollups.medians(lines, ["l_suppkey"], c, name)
    return of("l_quantity", "median_quantity").join(of("l_extendedprice", "median_price"), "l_suppkey")


@query("""
WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, l_extendedprice AS statistic, n FROM r WHERE i = least(n - 1, floor(n * 0.55::DOUBLE)) + 1
""")
def order_statistic(spark: SparkSession, d: str) -> DataFrame:
    return rollups.order_statistic(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.55)


@query("""
WITH b AS (
  SELECT l_suppkey, floor(l_extendedprice / 8000)::BIGINT AS bucket, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first, median(l_extendedprice) AS median
  FROM lineitem GROUP BY 1, 2
)
SELECT l_suppkey, arg_max(bucket, (n, -first)) AS bucket, arg_max(n, (n, -first)) AS n, arg_max(median, (n, -first)) AS median FROM b GROUP BY l_suppkey
""")
def dominant_bucket(spark: SparkSession, d: str) -> DataFrame:
    return rollups.dominant_bucket(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", F.col("l_orderkey") * 10 + F.col("l_linenumber"), 8000)


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS before, b.n AS after,
       CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'added' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
""")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    count = lambda odd: orders.filter(f"o_orderkey % 2 = {odd}").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return state.compare_runs(count(0), count(1), ["o_custkey"], "n")


_BOXES = "l_orderkey AS doc, l_linenumber AS page, l_quantity AS x0, l_quantity + l_tax * 100 AS x1, l_discount * 100 AS y0, l_discount * 100 + l_linenumber AS y1"
_ZONES = "o_orderkey AS doc, 1 + o_orderkey % 4 AS page, 0.0D AS x0, 20.0D + o_orderkey % 30 AS x1, 0.0D AS y0, 5.0D AS y1"
_ZONES_SQL = "o_orderkey AS doc, 1 + o_orderkey % 4 AS page, 0.0::DOUBLE AS x0, 20.0::DOUBLE + o_orderkey % 30 AS x1, 0.0::DOUBLE AS y0, 5.0::DOUBLE AS y1"


def _regions_sql(keyword: str) -> str:
    return f"""
WITH e AS (SELECT {_BOXES} FROM lineitem), r AS (SELECT {_ZONES_SQL} FROM orders)
SELECT doc, page::BIGINT AS page, x0, x1 FROM e WHERE {keyword} (SELECT 1 FROM r WHERE r.doc = e.doc AND r.page = e.page AND e.x0 < r.x1 AND r.x0 < e.x1 AND e.y0 < r.y1 AND r.y0 < e.y1)
"""


def _regions(spark: SparkSession, d: str, outside: bool) -> DataFrame:
    elements = table(spark, d, "lineitem").selectExpr(*_BOXES.split(", "))
    zones = table(spark, d, "orders").selectExpr(*_ZONES.split(", "))
    return regions.in_regions(elements, zones, ["doc", "page"], outside).select("doc", F.col("page").cast("long"), "x0", "x1")


@query(_regions_sql("EXISTS"))
def region_collisions(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d, False)


@query(_regions_sql("NOT EXISTS"))
def region_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d, True)


@query("""
WITH i AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 60000000)::BIGINT AS e FROM events)
SELECT a.event_id AS left_id, b.event_id AS right_id FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e
""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    i = table(spark, d, "events").select("event_id", "user_id", s.alias("s"), (s + F.round(F.col("value") * 60000000).cast("long")).alias("e"))
    return intervals.overlapping_pairs(i, "user_id", "event_id", "s", "e", 3_600_000_000)


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1), '') AS lang,
       try_cast(nullif(regexp_extract(url, '/(\d+)', 1), '') AS BIGINT) AS number FROM pages
""")
def url_classification(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    part = lambda p: F.nullif(F.regexp_extract(u, p, 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/]+)", 1).alias("host"), part("^[a-z]+://[^/]+/([a-z]{2})/").alias("lang"), part(r"/(\d+)").try_cast("long").alias("number"))


@query(r"""
WITH w AS (SELECT len(regexp_extract_all(text, '[^\s]+')) AS n, doc_id FROM documents),
f AS (SELECT unnest(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'raster_images' END, CASE WHEN n < 12 AND doc_id % 3 = 0 THEN 'image_only' END, CASE WHEN n >= 450 THEN 'dense_text' END,
  CASE WHEN doc_id % 7 = 6 THEN 'tables' END, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 OR doc_id % 11 = 10 THEN 'diagrams' END], lambda x: x IS NOT NULL)) AS member FROM w)
SELECT member, count(*) AS n FROM f GROUP BY member
""")
def layout_flags(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pages = table(spark, d, "documents").select(F.regexp_count("text", F.lit(r"[^\s]+")).alias("n_words"), F.when(i % 3 == 0, 0.9).otherwise(0.0).alias("image_coverage"), F.when(i % 3 == 0, 1).otherwise(0).alias("n_images"), F.when(i % 5 == 0, 1).otherwise(0).alias("n_body_images"), F.when(i % 7 == 6, 6).otherwise(0).alias("hlines"), F.when(i % 7 == 6, 8).otherwise(1).alias("vlines"), (i % 11).alias("shapes"), F.lit(1).alias("n_drawings"))
    return rollups.member_counts(pages.select(selection.layout_flags().alias("flags")), "flags")


_KEYS_SQL = "SELECT DISTINCT unnest(['class:' || lang, 'subject:' || source, 'family:' || (doc_id % 3), 'material:None', 'class_subject:' || lang || '/' || source, 'layout:' || CASE WHEN n_chars > 3000 THEN 'dense_text' ELSE 'short' END]) AS key, doc_id AS source_id FROM documents"


def _documents_as_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("source_id"), F.col("lang").alias("class_name"), F.col("source").alias("subject"), (F.col("doc_id") % 3).cast("string").alias("family"), F.lit(None).cast("string").alias("material_type"), F.array(F.when(F.col("n_chars") > 3000, "dense_text").otherwise("short")).alias("layout_flags"))


@query(f"WITH k AS ({_KEYS_SQL}) SELECT key, count(*) AS n FROM k GROUP BY key")
def coverage_keys(spark: SparkSession, d: str) -> DataFrame:
    return selection.coverage_keys(_documents_as_sources(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH RECURSIVE keys AS ({_KEYS_SQL}), sets AS (
  SELECT ks, min(struct_pack(pages := n_chars, id := source_id)) AS best FROM (SELECT source_id, list_sort(list(key)) AS ks FROM keys GROUP BY source_id) JOIN documents ON doc_id = source_id GROUP BY ks
), walk AS (
  SELECT -1 AS step, NULL::BIGINT AS source_id, []::VARCHAR[] AS covers, []::VARCHAR[] AS done
  UNION ALL
  SELECT step + 1, best.id, fresh, list_concat(done, fresh) FROM (
    SELECT *, row_number() OVER (ORDER BY len(fresh) DESC, best.pages, best.id) AS nth FROM (SELECT step, done, best, list_filter(ks, lambda k: NOT list_contains(done, k)) AS fresh FROM walk CROSS JOIN sets)
  ) WHERE nth = 1 AND len(fresh) > 0
)
SELECT step, source_id, covers FROM walk WHERE step >= 0
""")
def greedy_set_cover(spark: SparkSession, d: str) -> DataFrame:
    sources = _documents_as_sources(spark, d)
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("n_chars").alias("page_count"))
    return selection.set_cover(selection.coverage_keys(sources), pages)


@query("""
WITH pages AS (
  SELECT source AS doc, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, lang AS strategy,
         CASE WHEN n_chars < 100 THEN 'blank' WHEN n_chars > 3000 THEN 'dense' ELSE 'standard' END AS page_type,
         CASE WHEN n_chars % 50 = 0 THEN 0.8 ELSE 0.9 END AS confidence FROM documents
), marked AS (
  SELECT p.*, coalesce(confidence < 0.82 OR id % 97 = 5 OR page <= 1, false) AS must FROM pages p
), kinds AS (
  SELECT *, NOT bool_or(must) OVER k AND page = min(page) OVER k AS new, count(*) OVER (PARTITION BY doc) AS n_pages, sum(must::INT) OVER (PARTITION BY doc) AS n_must
  FROM marked WINDOW k AS (PARTITION BY doc, strategy, page_type)
), taken AS (
  SELECT *, must OR (new AND n_must + sum(new::INT) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) <= 8) AS take FROM kinds
), counted AS (SELECT *, sum(take::INT) OVER (PARTITION BY doc) AS n_take FROM taken)
SELECT doc, page FROM counted WHERE take OR (n_take < 8 AND list_contains(list_transform(range(8), lambda s: round_even(s * (n_pages - 1) / 7.0::DOUBLE, 0)::BIGINT), page))
""")
def review_page_selection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    n = F.col("n_chars")
    pages = docs.select(F.col("source").alias("doc"), "doc_id", nth.cast("long").alias("page"), F.col("lang").alias("strategy"), F.when(n < 100, "blank").when(n > 3000, "dense").otherwise("standard").alias("page_type"), F.when(n % 50 == 0, 0.8).otherwise(0.9).alias("confidence"))
    issues = pages.filter("doc_id % 97 = 5").select("doc", "page")
    return selection.review_pages(pages.drop("doc_id"), issues)


@query(f"SELECT item_id, contains({_norm('text')}, 'the') AND contains({_norm('text')}, 'er') AS has_all FROM benchmark")
def required_anchors(spark: SparkSession, d: str) -> DataFrame:
    anchors = F.array(F.lit("the"), F.lit("er"))
    return table(spark, d, "benchmark").select("item_id", rules.all_anchors(text.norm(F.col("text")), anchors).alias("has_all"))


_PAGE_SQL = """
  SELECT o_orderkey, o_custkey, (o_orderkey % 130)::DOUBLE AS header_bottom, (o_custkey % 170)::DOUBLE AS legacy_bottom,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey % 200)::DOUBLE END AS first_y,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 700 + (o_custkey % 140)::DOUBLE END AS last_y,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 760 + (o_orderkey % 80)::DOUBLE END AS band_top,
         (o_orderkey % 100)::DOUBLE / 100 AS header_confidence, (o_custkey % 100)::DOUBLE / 100 AS footer_confidence FROM orders
"""


def _page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_custkey", "CAST(o_orderkey % 130 AS DOUBLE) AS header_bottom", "CAST(o_custkey % 170 AS DOUBLE) AS legacy_bottom",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 200 AS DOUBLE) END AS first_y",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 700 + CAST(o_custkey % 140 AS DOUBLE) END AS last_y",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 760 + CAST(o_orderkey % 80 AS DOUBLE) END AS band_top",
        "CAST(o_orderkey % 100 AS DOUBLE) / 100 AS header_confidence", "CAST(o_custkey % 100 AS DOUBLE) / 100 AS footer_confidence",
    )


@query(f"""
WITH p AS ({_PAGE_SQL}), c AS (SELECT *, CASE WHEN first_y IS NULL THEN least(greatest(54, header_bottom, legacy_bottom), 150) ELSE least(least(greatest(54, header_bottom, legacy_bottom), 150), greatest(0, first_y - 7)) END::DOUBLE AS cleanup FROM p)
SELECT o_orderkey, cleanup, cleanup >= 42 AS safe, CASE WHEN cleanup >= 42 THEN least(cleanup, 76) ELSE 0 END::DOUBLE AS visible FROM c
""")
def safe_header(spark: SparkSession, d: str) -> DataFrame:
    rows = _page_numbers(spark, d).withColumn("cleanup", page_plan.cleanup_bottom(F.col("header_bottom"), F.col("legacy_bottom"), F.col("first_y")))
    safe = F.col("cleanup") >= 42
    return rows.select("o_orderkey", "cleanup", safe.alias("safe"), page_plan.visible_height(F.col("cleanup"), safe).alias("visible"))


@query(f"""
WITH p AS ({_PAGE_SQL}), t AS (
  SELECT *, CASE WHEN band_top IS NOT NULL AND footer_confidence >= 0.55 AND 842 - band_top > 0 AND 842 - band_top <= 60 AND (last_y IS NULL OR last_y <= band_top - 7) THEN band_top
                 WHEN band_top IS NOT NULL AND footer_confidence >= 0.55 AND band_top >= 816 THEN least(band_top, 824) ELSE 824 END::DOUBLE AS top FROM p
)
SELECT o_orderkey, CASE WHEN last_y IS NULL OR last_y <= top - 7 THEN top END AS footer_top FROM t
""")
def safe_footer(spark: SparkSession, d: str) -> DataFrame:
    top = page_plan.footer_top(F.lit(842.0), F.col("band_top"), F.col("footer_confidence"), F.col("last_y"))
    return _page_numbers(spark, d).select("o_orderkey", top.alias("footer_top"))


@query(f"""
WITH p AS ({_PAGE_SQL})
SELECT o_orderkey, least(0.99::DOUBLE, greatest(0.5::DOUBLE, 0.93::DOUBLE * 0.52::DOUBLE + greatest(header_confidence, 0.35::DOUBLE) * 0.28::DOUBLE
       + CASE WHEN o_orderkey % 2 = 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.05::DOUBLE ELSE 0 END)) AS confidence FROM p
""")
def plan_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = page_plan.plan_confidence(F.lit(0.93), F.col("header_confidence"), F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0)
    return _page_numbers(spark, d).select("o_orderkey", c.alias("confidence"))


def _full_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = _page_numbers(spark, d)
    k = F.col("o_orderkey")
    legacy = F.when(k % 3 == 0, F.array(g.rect(F.lit(10.0), F.lit(5.0), F.lit(110.0), F.col("legacy_bottom") + 6))).otherwise(g.no_rects()).cast(g.RECTS)
    return rows.withColumns({
        "page": 1 + k % 4, "width": F.lit(595.0), "height": F.lit(842.0), "page_type": F.element_at(F.array(*map(F.lit, ("standard", "standard", "designed", "dark", "blank"))), (k % 5 + 1).cast("int")),
        "opener": k % 2 == 0, "material_type": F.element_at(F.array(*[F.lit(m) for m in rules.DOCUMENT_TYPES]), (k % 11 + 1).cast("int")), "type_confidence": F.lit(0.78),
        "legacy_rects": legacy, "footer_legacy_rects": g.no_rects(), "vertical_rects": F.when(k % 7 == 0, F.array(g.rect(F.lit(0.0), F.lit(200.0), F.lit(20.0), F.lit(400.0)))).otherwise(g.no_rects()).cast(g.RECTS),
        "text_ok": k % 17 != 0, "image_only": k % 19 == 0,
    })


_TYPES_SQL = "[" + ", ".join(_sql_text(m) for m in rules.DOCUMENT_TYPES) + "]"
_TARGET_SQL = "CASE material_type " + " ".join(f"WHEN {_sql_text(k)} THEN {v}" for k, v in page_plan.Layout().first_page_cleanup_targets.items()) + " END"
_PLAN_TEMPLATE = "CASE " + " ".join(f"WHEN material_type IN ({', '.join(map(_sql_text, v))}) THEN {_sql_text(k)}" for k, v in rules.HEADER_TEMPLATES.items()) + " ELSE 'notes' END"
#: The page plan, step by step, over the derived pages.
_PLANS = f"""
WITH raw AS ({_PAGE_SQL}), p AS (
  SELECT *, o_orderkey AS k, 1 + o_orderkey % 4 AS page, ['standard', 'standard', 'designed', 'dark', 'blank'][o_orderkey % 5 + 1] AS page_type, {_TYPES_SQL}[o_orderkey % 11 + 1] AS material_type,
    o_orderkey % 3 = 0 AS legacy, o_orderkey % 7 = 0 AS sided, o_orderkey % 17 <> 0 AS text_ok, o_orderkey % 19 = 0 AS image_only, CASE WHEN o_orderkey % 3 = 0 THEN legacy_bottom + 6 ELSE 0 END::DOUBLE AS mark FROM raw
), wanted AS (
  SELECT *, least(greatest(54, header_bottom, mark), 150)::DOUBLE AS wanted, {_TARGET_SQL}::DOUBLE AS target FROM p
), limited AS (
  SELECT *, CASE WHEN first_y IS NULL THEN wanted ELSE least(wanted, greatest(0, first_y - 7)) END AS first_cleanup, CASE WHEN target IS NULL OR first_y IS NULL THEN target ELSE least(target, first_y - 7) END AS fallback FROM wanted
), fell AS (
  SELECT *, coalesce(page = 1 AND NOT legacy AND fallback > first_cleanup + 2 AND fallback >= 42, false) AS used FROM limited
), cleaned AS (
  SELECT *, greatest(0, CASE WHEN used THEN fallback ELSE first_cleanup END)::DOUBLE AS cleanup, used OR first_cleanup >= 42 AS room FROM fell
), shown AS (
  SELECT *, CASE WHEN room THEN least(cleanup, 76) ELSE 0 END::DOUBLE AS visible, room AND text_ok AS safe, page_type = 'standard' AS standard,
    CASE WHEN band_top IS NOT NULL AND footer_confidence >= 0.55 AND 842 - band_top > 0 AND 842 - band_top <= 60 AND (last_y IS NULL OR last_y <= band_top - 7) THEN band_top
         WHEN band_top IS NOT NULL AND footer_confidence >= 0.55 AND band_top >= 816 THEN least(band_top, 824) ELSE 824 END::DOUBLE AS foot FROM cleaned
), footed AS (
  SELECT *, CASE WHEN standard AND text_ok AND (last_y IS NULL OR last_y <= foot - 7) THEN foot END AS footer_y, greatest(header_bottom, mark) AS old_top, CASE WHEN band_top IS NULL THEN 0 ELSE greatest(0, 842 - band_top) END::DOUBLE AS old_bottom FROM shown
), cropped AS (
  SELECT *, CASE WHEN NOT standard THEN 0 WHEN first_y IS NULL THEN old_top ELSE least(old_top, greatest(0, first_y - 7)) END::DOUBLE AS crop_top,
    CASE WHEN NOT standard THEN 0 WHEN last_y IS NULL THEN old_bottom ELSE least(old_bottom, greatest(0, 842 - last_y - 7)) END::DOUBLE AS crop_bottom FROM footed
), plans AS (
  SELECT *, CASE WHEN page_type = 'blank' THEN 'leave_untouched' WHEN NOT standard AND legacy THEN 'designed_page_logo_only' WHEN NOT standard THEN 'designed_page_preserve'
      WHEN safe AND (used OR (page = 1 AND cleanup > visible + 8)) THEN 'first_page_large_logo_replacement' WHEN safe THEN 'standard_header_footer_replacement' WHEN legacy OR sided THEN 'legacy_only_cleanup' ELSE 'leave_untouched' END AS page_strategy,
    CASE WHEN page_type = 'blank' THEN 'preserve' WHEN NOT standard THEN CASE WHEN legacy THEN 'replace_logo_only' ELSE 'preserve' END WHEN safe THEN 'overlay' WHEN legacy THEN 'replace_logo_only' WHEN sided THEN 'overlay' ELSE 'preserve' END AS strategy,
    CASE WHEN standard AND safe THEN {_PLAN_TEMPLATE} ELSE 'none' END AS header_template, CASE WHEN standard AND safe THEN visible END AS header_y,
    coalesce(standard AND text_ok AND NOT image_only AND safe AND header_confidence >= 0.72 AND crop_top > 0 AND crop_top + 0.1::DOUBLE >= old_top AND (first_y IS NULL OR crop_top <= first_y - 7 + 0.1::DOUBLE)
      AND (band_top IS NULL OR footer_confidence >= 0.65) AND (band_top IS NULL OR last_y IS NULL OR last_y + 7 <= band_top), false) AS crop_is_safe,
    CASE WHEN page_type = 'blank' THEN 1 WHEN NOT standard THEN CASE WHEN legacy THEN 0.97 WHEN k % 2 = 0 THEN 0.92 ELSE 0.78 END
      ELSE least(0.99::DOUBLE, greatest(0.5::DOUBLE, 0.78::DOUBLE * 0.52::DOUBLE + greatest(header_confidence, 0.35::DOUBLE) * 0.28::DOUBLE + CASE WHEN safe THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN legacy THEN 0.05::DOUBLE ELSE 0 END)) END::DOUBLE AS confidence,
    standard AND safe AS clears FROM cropped
)"""


@query(f"""{_PLANS}
SELECT o_orderkey, page_strategy, strategy, header_template, confidence, cleanup, header_y, footer_y, crop_top, crop_bottom, crop_is_safe, CASE WHEN clears THEN 1 + legacy::INT ELSE 0 END AS n_cleanup,
  (legacy AND NOT clears AND strategy <> 'replace_logo_only')::INT AS n_logos, strategy = 'replace_logo_only' AS replaces_logo FROM plans
""")
def page_plans(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    plans = page_plan.plan_pages(_full_pages(spark, d))
    return plans.select("o_orderkey", "page_strategy", "strategy", "header_template", "confidence", "cleanup", c("header_rect.y1").alias("header_y"), c("footer_rect.y0").alias("footer_y"), "crop_top", "crop_bottom", F.coalesce("crop_is_safe", F.lit(False)).alias("crop_is_safe"), F.size("cleanup_rects").alias("n_cleanup"), F.size("additional_logo_rects").alias("n_logos"), c("logo_replace_rect").isNotNull().alias("replaces_logo"))


def _planned(spark: SparkSession, d: str) -> DataFrame:
    """Plans of the derived pages, with one protected block on each."""
    plans = page_plan.plan_pages(_full_pages(spark, d)).withColumnRenamed("o_orderkey", "doc")
    body = F.array(g.rect(F.lit(50.0), F.coalesce("first_y", F.lit(60.0)), F.lit(500.0), F.coalesce("last_y", F.lit(800.0)))).cast(g.RECTS)
    kind = f"struct<clip:{g.RECT},scale:double,dx:double,dy:double>"
    return plans.withColumns({"protected_text_rects": body, "protected_visual_rects": g.no_rects(), "crop": F.lit(None).cast(kind)})


#: What of a plan's rectangles meets the protected block (50, top, 500, bottom).
_COLLISIONS = f"""{_PLANS}, blocks AS (
  SELECT *, coalesce(first_y, 60) AS top, coalesce(last_y, 800) AS bottom FROM plans
), hits AS (
  SELECT *, coalesce(header_y > top, false) AS header_hit, coalesce(footer_y < bottom, false) AS footer_hit,
    (clears AND cleanup > top) OR (legacy AND mark > top AND bottom > 5) AS clean_hit FROM blocks
)"""


@query(f"""{_COLLISIONS}
SELECT 'HEADER_BODY_COLLISION_PLAN' AS code, 'fatal' AS severity, count(*) AS n FROM hits WHERE header_hit HAVING count(*) > 0
UNION ALL SELECT 'FOOTER_BODY_COLLISION_PLAN', 'fatal', count(*) FROM hits WHERE footer_hit HAVING count(*) > 0
UNION ALL SELECT 'CLEANUP_BODY_COLLISION_PLAN', 'fatal', count(*) FROM hits WHERE clean_hit HAVING count(*) > 0
""")
def geometry_issues(spark: SparkSession, d: str) -> DataFrame:
    return audit.geometry_issues(_planned(spark, d)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


_FACTS = (
    "o_orderkey AS doc, 1 + o_orderkey % 4 AS page, o_orderkey % 37 = 0 AS unsafe_image_cleanup, o_orderkey % 2 = 0 AS ocr_checked, CASE WHEN o_orderkey % 41 = 0 THEN 'none' END AS ocr_error, o_orderkey % 43 = 0 AS ocr_unsafe, "
    "CASE WHEN o_orderkey % 47 = 0 THEN 'none' END AS output_ocr_error, o_orderkey % 5 AS output_ocr_hits, o_orderkey % 53 <> 0 AS render_size_ok, CASE WHEN o_orderkey % 59 = 0 THEN 'failed' END AS render_error, o_orderkey % 61 AS body_pixels, "
    "CAST(o_orderkey % 100 AS DOUBLE) / 100000 AS body_change, CAST(o_orderkey % 50 AS DOUBLE) / 1000 AS region_change, o_orderkey % 100 AS logo_left, o_orderkey % 200 AS logo_template, CASE WHEN o_orderkey % 67 = 0 THEN 'failed' END AS logo_error, "
    "CASE WHEN o_orderkey % 71 = 0 THEN 'failed' END AS source_text_error, CASE WHEN o_orderkey % 73 = 0 THEN 'failed' END AS position_error"
)
_WORD = "l_orderkey AS doc, 1 + l_orderkey % 4 AS page, {0} AS x0, {1} AS y0, {0} + 30 AS x1, {1} + 8 AS y1, {2} AS text, l_suppkey AS s"
_BODY = _WORD.format("60.0 + l_linenumber * 40", "250 + l_quantity", "'W' || l_partkey || 's' || l_suppkey || 'n' || l_linenumber")
_HEAD = _WORD.format("300.0 + l_linenumber * 30", "10 + l_tax", "'h' || l_partkey || ' acme'")
_MOVED = _WORD.format("60.0 + l_linenumber * 40 + CASE WHEN l_suppkey % 19 = 0 THEN 3 ELSE 0 END", "250 + l_quantity", "'w' || l_partkey || 'S' || l_suppkey || 'n' || l_linenumber")
_BRAND = _WORD.format("400.0 + l_linenumber", "400 + l_quantity", "'ACME Press'")
_SIDE = _WORD.format("5.0 + l_linenumber", "500 + l_quantity", "'Small Print'")
_AUDITED = f"""{_COLLISIONS}, facts AS (SELECT {_FACTS} FROM orders), resized AS (SELECT o_orderkey AS doc, o_orderkey % 31 = 0 AS resized FROM orders),
pages AS (
  SELECT h.*, f.* EXCLUDE (doc, page), resized, starts_with(page_strategy, 'designed') AS designed, band_top IS NOT NULL AND footer_confidence >= 0.65 AND page_type <> 'blank' AND NOT starts_with(page_strategy, 'designed') AND footer_y IS NULL AS no_footer
  FROM hits h JOIN facts f ON f.doc = k JOIN resized r ON r.doc = k
), before AS (
  SELECT doc, lower(text) AS token FROM (SELECT {_BODY} FROM lineitem)
  UNION ALL SELECT w.doc, regexp_extract(w.text, '^(h[0-9]+)', 1) FROM (SELECT {_HEAD} FROM lineitem) w JOIN pages p ON p.k = w.doc WHERE NOT p.clears
), after AS (
  SELECT doc, lower(text) AS token FROM (SELECT {_MOVED} FROM lineitem) WHERE s % 17 <> 0
), kept AS (
  SELECT a.doc, sum(least(a.n, coalesce(b.n, 0)))::DOUBLE / sum(a.n) AS retention FROM (SELECT doc, token, count(*) AS n FROM before GROUP BY ALL) a
  LEFT JOIN (SELECT doc, token, count(*) AS n FROM after GROUP BY ALL) b ON a.doc = b.doc AND a.token = b.token GROUP BY a.doc
), moved AS (SELECT DISTINCT l_orderkey AS doc FROM lineitem WHERE l_suppkey % 19 = 0 AND l_suppkey % 17 <> 0),
issues AS (
""" + " UNION ALL ".join(
    f"SELECT k AS doc, '{code}' AS code, {level if level.startswith('CASE') else _sql_text(level)} AS severity FROM pages WHERE coalesce({condition}, false)"
    for condition, code, level in (
        ("header_hit", "HEADER_BODY_COLLISION_PLAN", "fatal"),
        ("footer_hit", "FOOTER_BODY_COLLISION_PLAN", "fatal"),
        ("clean_hit", "CLEANUP_BODY_COLLISION_PLAN", "fatal"),
        ("unsafe_image_cleanup", "UNSAFE_SHARED_IMAGE_CLEANUP", "error"),
        ("ocr_checked AND ocr_error IS NOT NULL", "RASTER_OCR_UNAVAILABLE", "error"),
        ("ocr_checked AND ocr_unsafe", "RASTER_BRAND_UNSAFE_GEOMETRY", "error"),
        ("ocr_checked AND output_ocr_error IS NOT NULL", "RASTER_OCR_UNAVAILABLE", "error"),
        ("ocr_checked AND output_ocr_error IS NULL AND output_ocr_hits > 0", "RASTER_LEGACY_TEXT_REMAINS", "error"),
        ("NOT text_ok", "TEXT_EXTRACTION_FAILED", "error"),
        ("source_text_error IS NOT NULL", "TEXT_EXTRACTION_FAILED", "error"),
        ("designed AND header_template <> 'none'", "GENERIC_HEADER_ON_DESIGNED_PAGE", "fatal"),
        ("no_footer", "REPEATED_FOOTER_NOT_REPLACED", "CASE WHEN bottom > band_top THEN 'warning' ELSE 'error' END"),
        ("resized", "PAGE_SIZE_CHANGED", "fatal"),
        ("NOT render_size_ok", "RENDER_SIZE_MISMATCH", "fatal"),
        ("body_pixels = 0", "NO_BODY_REGION_VERIFIED", "error"),
        ("body_change > 0.0005::DOUBLE", "BODY_RENDER_CHANGED", "error"),
        ("region_change > 0.01::DOUBLE", "DIAGRAM_RENDER_CHANGED", "error"),
        ("render_error IS NOT NULL", "RENDER_VERIFICATION_FAILED", "error"),
        ("logo_template >= 24 AND logo_left >= 24 AND logo_left::DOUBLE / logo_template > 0.08::DOUBLE", "RASTER_LEGACY_LOGO_REMAINS", "error"),
        ("logo_error IS NOT NULL", "RASTER_LOGO_CHECK_FAILED", "error"),
        ("position_error IS NOT NULL", "BODY_POSITION_CHECK_FAILED", "error"),
        ("k IN (SELECT doc FROM kept WHERE retention < 0.985::DOUBLE)", "BODY_TEXT_LOSS", "error"),
        ("page_type <> 'blank' AND k NOT IN (SELECT doc FROM kept)", "BODY_TEXT_UNAVAILABLE", "info"),
        ("k IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 23 = 0)", "LEGACY_TEXT_REMAINS", "error"),
        ("k IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 29 = 0)", "VERTICAL_LEGACY_TEXT_REMAINS", "warning"),
        ("k IN (SELECT doc FROM moved)", "BODY_POSITION_SHIFT", "error"),
    )
) + ")"


def _audited(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """(plans, source words, output words, output pages, facts, bands) of the derived pages."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    select = lambda df, columns: df.selectExpr(*split_columns(columns))
    before = select(lines, _BODY).unionByName(select(lines, _HEAD))
    after = select(lines, _MOVED).filter("s % 17 <> 0").unionByName(select(lines, _BRAND).filter("s % 23 = 0")).unionByName(select(lines, _SIDE).filter("s % 29 = 0"))
    sizes = orders.selectExpr("o_orderkey AS doc", "1 + o_orderkey % 4 AS page", "CASE WHEN o_orderkey % 31 = 0 THEN 596.0D ELSE 595.0D END AS width", "842.0D AS height")
    bands = _page_numbers(spark, d).select(F.col("o_orderkey").alias("doc"), F.col("band_top").alias("footer_top"), "footer_confidence")
    return _planned(spark, d), before, after, sizes, select(orders, _FACTS), bands


@query(f"{_AUDITED} SELECT code, severity, count(*) AS n FROM issues GROUP BY ALL")
def audit_issues(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(*_audited(spark, d), ["acme"], ["small print"]).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_AUDITED}
SELECT k AS doc, coalesce(NOT bad, true) AS passed, 1::BIGINT AS pages, retention AS average_retention, (retention IS NOT NULL)::BIGINT AS retention_pages, CASE WHEN body_change > region_change THEN body_change ELSE region_change END AS max_change,
  coalesce(i.n, 0)::BIGINT AS issues, page_strategy || ':1' AS strategies
FROM pages LEFT JOIN kept ON kept.doc = k LEFT JOIN (SELECT doc, count(*) AS n, bool_or(severity IN ('error', 'fatal')) AS bad FROM issues GROUP BY doc) i ON i.doc = k
""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    plans, before, after, _, facts, _ = parts = _audited(spark, d)
    # the audit stands on the same exchange
    kept = audit.body_matches(before, after, plans, ["acme"]).filter("retention IS NOT NULL").select("doc", "page", "retention")
    changes = facts.select("doc", "page", F.greatest("body_change", "region_change").alias("change"))
    told = audit.report(plans.select("doc", "page", "page_strategy"), audit.audit(*parts, ["acme"], ["small print"]), kept, changes=changes)
    counts = F.array_join(F.transform(F.map_entries("strategies"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return told.withColumn("strategies", counts).drop("max_shift", "shift_checks")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_field_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '00')")
def run_filters(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("class_name"), F.col("c_name").alias("chapter"))
    return classify.run_filters(named, class_name="BUILDING", chapter="00").select("c_custkey")


@query(f"""
SELECT page_id, CASE WHEN list_contains(list_transform(string_split(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '/'), lambda x: {_norm('x')})[:-2], 'en') THEN 'inside excluded folder'
  WHEN regexp_matches(' ' || {_norm('url')} || ' ', '[_\\-\\s](?:{"|".join(rules.ADMIN_WORDS)}|com)[_\\-\\s]') THEN 'administrative plan/schedule file' END AS reason FROM pages
""")
def exclusion_rule(spark: SparkSession, d: str) -> DataFrame:
    # the tables have no administrative files, so a folder and a word of theirs stand for them
    u = F.col("url")
    folders = F.split(F.regexp_extract(u, "^[a-z]+://[^/]+/(.*)$", 1), "/")
    folders = F.transform(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0))), lambda x: F.when(text.norm(x) == "en", F.lit("Excluded")).otherwise(F.lit("x")))
    stem = F.regexp_replace(text.norm(u), r"\bcom\b", "Plan")
    return table(spark, d, "pages").select("page_id", rules.exclusion_reason(folders, stem).alias("reason"))


def _selection(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The labelled documents as a selection: some name other bytes, some a document that is not there, some no hash."""
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), text.content_hash(F.col("text")).alias("sha256"))
    i = F.col("source_id")
    wanted = table(spark, d, "labels").select(F.col("doc_id").alias("source_id")).join(sources, "source_id", "left")
    sha = F.when(i % 7 == 0, F.lit("0")).when(i % 5 != 0, F.col("sha256"))
    return sources, wanted.select(F.when(i % 11 == 0, -1 - i).otherwise(i).alias("source_id"), sha.alias("sha256"))


@query("SELECT doc_id AS source_id, sha256(text) AS sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE doc_id % 11 <> 0)")
def selected_sources(spark: SparkSession, d: str) -> DataFrame:
    return manifests.selected(*_selection(spark, d))[0]


@query("""
SELECT CASE WHEN doc_id % 11 = 0 THEN -1 - doc_id ELSE doc_id END AS source_id FROM labels
WHERE doc_id % 11 = 0 OR doc_id NOT IN (SELECT doc_id FROM documents) OR doc_id % 7 = 0
""")
def selection_errors(spark: SparkSession, d: str) -> DataFrame:
    return manifests.selected(*_selection(spark, d))[1]


def _turn_words(spark: SparkSession, d: str, shift: int) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", (F.col("turn") - shift).alias("turn"), F.posexplode(text.word_tokens(F.col("text"))).alias("i", "token"))
    x = F.col("i").cast("double")
    return turns.select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("page"), "token", g.rect(x, F.lit(0.0), x + 1, F.lit(1.0)).alias("box"))


@query(r"""
WITH RECURSIVE tokens AS (
  SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS x FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[A-Za-z0-9]+') AS t FROM conversations)
), sides AS (
  SELECT conv_id, turn, token, list(x::DOUBLE ORDER BY x) AS xs FROM tokens GROUP BY ALL
), walk AS (
  SELECT a.conv_id, a.turn, token, a.xs AS s, b.xs AS free, 1 AS i, 0::DOUBLE AS worst FROM sides a JOIN (SELECT conv_id, turn - 1 AS turn, token, xs FROM sides) b USING (conv_id, turn, token)
  UNION ALL
  SELECT conv_id, turn, token, s, list_filter(free, lambda x: x <> pick), i + 1, greatest(worst, abs(pick - s[i]))
  FROM (SELECT *, list_sort(list_transform(free, lambda x: struct_pack(d := abs(x - s[i]), x := x)))[1].x AS pick FROM walk WHERE i <= len(s) AND len(free) > 0)
), ends AS (SELECT conv_id, turn, token, max(i) - 1 AS checks, max(worst) AS worst FROM walk GROUP BY ALL)
SELECT conv_id::VARCHAR AS doc, turn AS page, max(worst) AS shift, sum(checks)::BIGINT AS checks FROM ends GROUP BY ALL
""")
def position_shift(spark: SparkSession, d: str) -> DataFrame:
    # an output place is taken once, however many words (of a turn that is there twice) stand on it
    return matching.position_shifts(_turn_words(spark, d, 0), _turn_words(spark, d, 1).distinct())


_MERGED = "CAST(l_suppkey AS STRING) AS doc, CAST(l_linenumber AS BIGINT) AS page, l_quantity * 12 AS x0, l_discount * 9000 AS y0, l_quantity * 12 + 30 AS x1, l_discount * 9000 + 8 AS y1"
_NEAR = "greatest(e.x0 - 5, r.x0) < least(e.x1 + 5, r.x1) AND greatest(e.y0 - 5, r.y0) < least(e.y1 + 5, r.y1)"


def _merge_sql(step: str) -> str:
    """Rectangles of a page, one after the other, against the groups so far."""
    return f"""
WITH RECURSIVE boxes AS (SELECT {_MERGED.replace("AS STRING", "AS VARCHAR")} FROM lineitem), pages AS (
  SELECT doc, page, list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1) ORDER BY y0, x0, x1, y1) AS rs FROM boxes GROUP BY ALL
), walk AS (
  SELECT doc, page, rs, 2 AS i, [rs[1]] AS groups FROM pages
  UNION ALL
  SELECT doc, page, rs, i + 1, groups FROM ({step})
), ends AS (SELECT doc, page, groups FROM walk WHERE i > len(rs))
SELECT doc, page, generate_subscripts(groups, 1) - 1 AS nth, unnest(groups, recursive := true) FROM ends
"""


_JOINED = "struct_pack(x0 := least(e.x0, r.x0), y0 := least(e.y0, r.y0), x1 := greatest(e.x1, r.x1), y1 := greatest(e.y1, r.y1))"
_FIRST = f"""
SELECT doc, page, rs, i, CASE WHEN spot IS NULL THEN list_append(groups, r) ELSE list_transform(groups, lambda e, j: CASE WHEN j = spot THEN {_JOINED} ELSE e END) END AS groups
FROM (SELECT *, rs[i] AS r, list_position(list_transform(groups, lambda e: {_NEAR.replace("r.", "rs[i].")}), true) AS spot FROM walk WHERE i <= len(rs))
"""
_ALL = f"""
SELECT doc, page, rs, i, list_append(list_filter(groups, lambda e: NOT ({_NEAR})), struct_pack(
  x0 := least(r.x0, list_min(list_transform(close, lambda e: e.x0))), y0 := least(r.y0, list_min(list_transform(close, lambda e: e.y0))),
  x1 := greatest(r.x1, list_max(list_transform(close, lambda e: e.x1))), y1 := greatest(r.y1, list_max(list_transform(close, lambda e: e.y1))))) AS groups
FROM (SELECT *, rs[i] AS r, list_filter(groups, lambda e: {_NEAR.replace("r.", "rs[i].")}) AS close FROM walk WHERE i <= len(rs))
"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*_MERGED.split(", "))


@query(_merge_sql(_FIRST))
def near_rect_merge(spark: SparkSession, d: str) -> DataFrame:
    return rects.merged_rects(_boxes(spark, d))


@query(_merge_sql(_ALL))
def near_rect_absorb(spark: SparkSession, d: str) -> DataFrame:
    return rects.merged_rects(_boxes(spark, d), absorb=True)


_WHOLE, _CUTS = "0, 0, l_quantity, 40", (("l_quantity - 20", "l_tax * 300 - 5", "l_quantity - 8", "l_tax * 300 + 12"), ("5", "l_linenumber * 3", "9 + l_discount * 200", "60"))


def _cut_sql(source: str, k: int) -> str:
    """What is left of the rectangles of a view without the k-th cut, in pieces."""
    x0, y0, x1, y1 = (f"({c})::DOUBLE" for c in _CUTS[k])
    meets = f"greatest(x0, {x0}) < least(x1, {x1}) AND greatest(y0, {y0}) < least(y1, {y1})"
    top, bottom, left, right = f"greatest(y0, {y0})", f"least(y1, {y1})", f"greatest(x0, {x0})", f"least(x1, {x1})"
    keep = "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, n * 5 + {4} AS n, {0} AS x0, {1} AS y0, {2} AS x1, {3} AS y1 FROM " + source
    parts = [keep.format("x0", "y0", "x1", "y1", 0) + f" WHERE NOT ({meets})"]
    for i, box in enumerate((("x0", "y0", "x1", top), ("x0", bottom, "x1", "y1"), ("x0", top, left, bottom), (right, top, "x1", bottom))):
        parts.append(keep.format(*box, i + 1) + f" WHERE {meets}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE x1 - x0 > 0.1::DOUBLE AND y1 - y0 > 0.1::DOUBLE"


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, 0 AS n, 0::DOUBLE AS x0, 0::DOUBLE AS y0, l_quantity AS x1, 40::DOUBLE AS y1 FROM lineitem WHERE l_quantity > 0),
one AS ({_cut_sql('r', 0)}), two AS ({_cut_sql('one', 1)})
SELECT l_orderkey, l_linenumber, x0, y0, x1, y1 FROM two
""")
def rect_subtraction(spark: SparkSession, d: str) -> DataFrame:
    cuts = F.array(*[g.rect(*[F.expr(c) for c in cut]) for cut in _CUTS])
    pieces = g.subtract(g.rect(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(40.0)), cuts)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(pieces).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("""
WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT l_partkey, l_suppkey, least(x.n, y.n) AS n FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM a GROUP BY ALL) x JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM b GROUP BY ALL) y USING (l_partkey, l_suppkey)
""")
def multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    of = lambda odd: lines.filter(F.col("l_linenumber") % 2 == odd).select("l_partkey", "l_suppkey")
    return rollups.multiset_intersection(of(1), of(0))


@query("""
SELECT l_suppkey, (count(*) FILTER (greatest(abs(l_quantity - l_linenumber), abs(l_discount * 100 - 5), abs(l_tax * 100 - 4)) > 12))::DOUBLE / count(*) AS change, count(*) AS pixels
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey
""")
def pixel_change(spark: SparkSession, d: str) -> DataFrame:
    pixels = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_quantity AS r0", "l_linenumber AS r1", "l_discount * 100 AS g0", "5 AS g1", "l_tax * 100 AS b0", "4 AS b1", "l_returnflag = 'R' AS masked")
    return audit.pixel_change(pixels, ["l_suppkey"])


@query("""
WITH m AS (SELECT l_suppkey, l_shipdate, sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2), p AS (SELECT l_suppkey, max(m) AS peak FROM m GROUP BY 1),
c AS (SELECT l_suppkey, l_linenumber, max(l_quantity) AS c FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, sum(c) AS cpu FROM c GROUP BY 1)
SELECT l_suppkey, peak, cpu FROM p JOIN s USING (l_suppkey)
""")
def peak_memory(spark: SparkSession, d: str) -> DataFrame:
    return rollups.peak_of_sums(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_linenumber", "l_quantity", "l_quantity")


@query("SELECT l_suppkey, avg(CASE WHEN l_quantity < 25 THEN 1.0::DOUBLE ELSE 0 END) AS dark, bool_and(l_quantity <= 50) AND count(*) > 0 AS passed, NOT bool_or(l_returnflag = 'X') AS clean FROM lineitem GROUP BY l_suppkey")
def shares_and_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(rollups.share_where(F.col("l_quantity") < 25).alias("dark"), rollups.all_and_some(F.col("l_quantity") <= 50).alias("passed"), rollups.none_of(F.col("l_returnflag") == "X").alias("clean"))


_CHAPTERS = ("Measurement and Motion", "Heat", "Sound", "Motion", "Air", "friend and foe", "Unheard of")
_PATH = f"""CASE doc_id % 4 WHEN 0 THEN 'Class ' || (6 + doc_id % 5) WHEN 1 THEN (6 + doc_id % 5) || 'th class' WHEN 2 THEN 'std_' || (6 + doc_id % 5) ELSE 'Class 7/grade-' || (6 + doc_id % 5) END || '/'
 || CASE doc_id % 6 WHEN 0 THEN 'maths' WHEN 1 THEN 'Phy' WHEN 2 THEN 'bio' WHEN 3 THEN 'Science' WHEN 4 THEN 'Unsorted' ELSE 'misc' END || '/' || (doc_id % 20) || ' '
 || CASE doc_id % 7 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CHAPTERS))} END || '/' || CASE doc_id % 5 WHEN 0 THEN 'Race solutions' WHEN 1 THEN 'Sheet' WHEN 2 THEN 'Chem notes' WHEN 3 THEN 'Chapter-test' ELSE 'year planner' END || ' ' || doc_id || '.pdf'"""
_SCIENCE = ", ".join(f"({n}, '{k}', '{c}', '{s}')" for n, (k, c, s) in enumerate((k, c, s) for k, rows in rules.SCIENCE_CHAPTERS.items() for c, s in rows))


@query(f"""
WITH science(n, k, c, s) AS (VALUES {_SCIENCE}), paths AS (SELECT doc_id, {_PATH} AS path FROM documents),
parts AS (SELECT *, (6 + doc_id % 5)::VARCHAR AS class, {_norm("string_split(path, '/')[-2]")} AS folder, regexp_replace({_norm("string_split(path, '/')[-2]")}, '^[0-9]+ ', '') AS plain FROM paths),
found AS (
  SELECT p.*, coalesce((SELECT min_by(s, n) FROM science WHERE k = class AND c = plain), (SELECT min_by(s, n) FROM science WHERE k = class AND (contains(plain, c) OR contains(c, plain)))) AS science FROM parts p
), told AS (
  SELECT *, CASE WHEN doc_id % 5 = 2 THEN 'chemistry' ELSE CASE doc_id % 6 WHEN 0 THEN 'mathematics' WHEN 1 THEN 'physics' WHEN 2 THEN 'biology' WHEN 3 THEN science END END AS subject_found,
    string_split(path, '/')[-2] AS chapter_folder, CASE doc_id % 5 WHEN 0 THEN 'DPP' WHEN 3 THEN 'CHAPTER TEST' ELSE 'NOTES' END AS material, doc_id % 6 = 4 AS unsorted, doc_id % 6 = 4 AND doc_id % 16 = 12 AS reviewed FROM found
), known AS (
  SELECT *, CASE WHEN reviewed THEN 'biology' WHEN NOT unsorted THEN subject_found END AS subject FROM told
)
SELECT doc_id, CASE WHEN subject IS NOT NULL THEN class END AS class_name, subject, CASE WHEN subject IS NULL THEN NULL WHEN reviewed THEN 'Checked' ELSE regexp_extract(chapter_folder, '^[0-9]+ (.*)$', 1) END AS chapter,
  CASE WHEN subject IS NOT NULL AND NOT reviewed THEN (doc_id % 20)::VARCHAR END AS chapter_number, CASE WHEN subject IS NULL THEN NULL WHEN reviewed THEN 'TEST' ELSE material END AS material_type,
  CASE WHEN doc_id % 5 = 4 THEN 'administrative plan/schedule file' END AS exclusion
FROM known
""")
def path_classification(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_PATH} AS path", "CASE WHEN doc_id % 16 = 4 THEN 'nothing of it' ELSE 'Checked by hand: page' END AS first_page")
    # records of unsorted documents: half of them are right, the others name an anchor or a class that is not there
    class_name = F.when(F.col("doc_id") % 8 == 4, (6 + F.col("doc_id") % 5).cast("string")).otherwise(F.lit("11"))
    reviewed = docs.filter("doc_id % 6 = 4").select("path", class_name.alias("class_name"), F.lit("biology").alias("subject"), F.lit("Checked").alias("chapter"), F.lit(None).cast("string").alias("chapter_number"), F.lit("TEST").alias("material_type"), F.array(F.lit("by hand")).alias("anchors"))
    return classify.classify(docs, reviewed=reviewed).select("doc_id", "class_name", "subject", "chapter", "chapter_number", "material_type", "exclusion")
