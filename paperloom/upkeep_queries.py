"""Queries of what is kept up to date: memos, merged caches, inventories, order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, rules, text
from .operators import inventory, memo, numbering, state
from .plans import classify
from .queries import query
from .sources import shared
from .sources.ledger import Ledger
from .sources.tables import table
from .streaming import lives

_USES = "CAST(floor(l_orderkey / 5) AS BIGINT) AS doc, l_orderkey % 5 + 1 AS page, CAST(l_partkey % 30 AS BIGINT) AS object"
_CHANGED = "(doc + object) % 6 = 0"


def _memo(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages and images of a second version, in which some objects have changed."""
    uses = table(spark, d, "lineitem").selectExpr(*_USES.split(", "))
    images = uses.select("doc", "object").distinct()
    first = images.withColumn("state", F.concat_ws("-", "doc", "object"))
    second = images.withColumn("state", F.when(F.expr(_CHANGED), F.concat_ws("-", "doc", "object", F.lit("x"))).otherwise(F.concat_ws("-", "doc", "object")))
    # digests travel as their bytes, half of what their digits are; both sort alike
    decode = lambda df: df.withColumn("digest", F.unhex(F.sha2("state", 256)))
    none = spark.createDataFrame([], "doc long, object long, state string, digest binary")
    no_pages = spark.createDataFrame([], "doc long, page long, signature string, digests array<binary>")
    digests = memo.refreshed_digests(images, first, none, decode)
    pages = memo.refreshed_pages(uses, first, no_pages, digests)
    again = memo.refreshed_digests(images, second, digests.drop("decoded"), decode)
    return memo.refreshed_pages(uses, second, pages.drop("reused"), again), again


@query(f"""
WITH uses AS (SELECT DISTINCT {_USES} FROM lineitem), told AS (SELECT *, {_CHANGED} AS changed FROM uses)
SELECT doc, page, NOT bool_or(changed) AS reused, array_to_string(list_sort(list(sha256(doc || '-' || object || CASE WHEN changed THEN '-x' ELSE '' END))), ',') AS digests
FROM told GROUP BY doc, page
""")
def memo_pages(spark: SparkSession, d: str) -> DataFrame:
    return _memo(spark, d)[0].select("doc", "page", "reused", F.array_join(F.transform("digests", lambda x: F.lower(F.hex(x))), ",").alias("digests"))


@query(f"SELECT DISTINCT doc, object, {_CHANGED} AS decoded FROM (SELECT {_USES} FROM lineitem)")
def memo_images(spark: SparkSession, d: str) -> DataFrame:
    return _memo(spark, d)[1].select("doc", "object", "decoded")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'second' WHEN p_partkey % 3 = 0 THEN 'first' ELSE 'base' END AS writer,
       (p_size + CASE WHEN p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS size
FROM part
""")
def cache_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two writers that start from the same version; the second finds that the
    first has been there, and merges."""
    part = table(spark, d, "part")
    rows = lambda name, plus: part.select("p_partkey", F.lit(name).alias("writer"), (F.col("p_size").cast("long") + plus).alias("size"))
    folder = f"{shared.folder(spark)}/ledger-{uuid.uuid4().hex}"
    one, other = (Ledger(spark, folder, "p_partkey", "p_partkey long, writer string, size long") for _ in range(2))
    one.commit(rows("base", 0))
    before = [lambda: one.commit(rows("first", 1).filter("p_partkey % 3 = 0"))]
    other.commit(rows("second", 2).filter("p_partkey % 5 = 0"), between=lambda: before.pop()() if before else None)
    return other.read()


_ENTRY = {
    "status": "CASE WHEN key % 13 = 0 THEN 'excluded' WHEN key % 17 = 0 THEN 'unreadable' ELSE 'classified' END",
    "family": "CASE (key + mtime_ns) % 3 WHEN 0 THEN 'notes' WHEN 1 THEN 'test' ELSE 'key_points' END",
    "class_name": "CAST(6 + size % 5 AS STRING)",
    "subject": "CASE (key + size) % 2 WHEN 0 THEN 'physics' ELSE 'maths' END",
}
_NOW = "p_partkey AS key, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 5 = 0 THEN 8 ELSE 7 END AS mtime_ns"


def _classify(files: DataFrame) -> DataFrame:
    told = files.withColumns({k: F.expr(v) for k, v in _ENTRY.items()})
    flags = F.array_compact(F.array(F.when(F.expr("key % 4 = 0"), "tables"), F.when(F.expr("size > 25"), "dense_text")))
    return told.select("path", "size", "mtime_ns", *_ENTRY, flags.alias("flags"))


@query(f"""
WITH files AS (SELECT {_NOW} FROM part), told AS (SELECT *, {', '.join(f"{v.replace('STRING', 'VARCHAR')} AS {k}" for k, v in _ENTRY.items())} FROM files), keys AS (
  SELECT 'documents' AS kind, '' AS key FROM told UNION ALL SELECT 'status', status FROM told
  UNION ALL SELECT 'family', family FROM told WHERE status = 'classified' UNION ALL SELECT 'class_subject', class_name || '/' || subject FROM told WHERE status = 'classified'
  UNION ALL SELECT 'layout_flag', 'tables' FROM told WHERE told.key % 4 = 0 UNION ALL SELECT 'layout_flag', 'dense_text' FROM told WHERE size > 25
)
SELECT kind, key, count(*) AS n FROM keys GROUP BY kind, key
""")
def inventory_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The summary after files came, changed and went, from the one before."""
    files = table(spark, d, "part").selectExpr(*_NOW.split(", ")).withColumn("path", F.concat(F.lit("p/"), F.col("key")))
    before = files.filter("key % 7 <> 0").withColumn("mtime_ns", F.lit(7)).unionByName(files.filter("key % 11 = 0").withColumn("path", F.concat(F.lit("old/"), F.col("key"))))
    return inventory.refreshed(inventory.built(before, _classify, "s"), files, _classify, "s").summary


@query("SELECT row_number() OVER (ORDER BY string_split(source || '/' || (doc_id % 97) || '/' || doc_id, '/')) AS nth, doc_id FROM documents")
def path_order(spark: SparkSession, d: str) -> DataFrame:
    from .operators import selection

    paths = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id") % 97, "doc_id").alias("path"), "doc_id")
    return selection.first_paths(paths).select("nth", "doc_id")


@query("""
WITH a AS (SELECT doc_id, source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.json' ELSE '.md' END AS path FROM documents)
SELECT row_number() OVER (ORDER BY doc_id % 3 = 0, path) AS number, doc_id FROM a
""")
def publication_order(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".json").otherwise(".md")
    artifacts = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", kind).alias("path"))
    return numbering.publication_order(artifacts).select("number", "doc_id")


_STATUS = "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'analyzed' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'completed' END"
SILENCE_MS, RETRIES = 43_200_000, 2
_LIVES_SQL = f"""
WITH RECURSIVE told AS (
  SELECT user_id AS job, epoch_us(ts) // 1000 AS t, {_STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i
  FROM events WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts) // 1000) FROM events)
), seen AS (
  SELECT *, lag(status) OVER (PARTITION BY job ORDER BY i) IN ('running', 'analyzed') AND t - lag(t) OVER (PARTITION BY job ORDER BY i) > {SILENCE_MS} AS gap,
         lag(t) OVER (PARTITION BY job ORDER BY i) + {SILENCE_MS} AS silent, i = max(i) OVER (PARTITION BY job) AS final FROM told
), walk AS (
  SELECT job, 0::BIGINT AS i, NULL::BIGINT AS began, 0 AS attempts, 0 AS retried, '' AS status, 0::BIGINT AS t, NULL::BIGINT AS cut, 0 AS cut_attempts, NULL::BIGINT AS cut_began, false AS over FROM (SELECT DISTINCT job FROM told)
  UNION ALL
  SELECT s.job, s.i, CASE WHEN x.fresh THEN s.t ELSE w.began END, CASE WHEN x.fresh THEN 0 ELSE w.attempts END + (s.status = 'running')::INT,
         CASE WHEN x.fresh THEN 0 ELSE w.retried END + (s.status = 'failed')::INT, s.status, s.t,
         CASE WHEN s.gap AND NOT w.over THEN s.silent END, w.attempts, w.began,
         s.status = 'completed' OR s.status = 'failed' AND CASE WHEN x.fresh THEN 0 ELSE w.retried END >= {RETRIES}
  FROM walk w JOIN seen s ON s.job = w.job AND s.i = w.i + 1, LATERAL (SELECT w.over OR w.i = 0 OR coalesce(s.gap, false) AS fresh) x
)
SELECT job, began, t AS ended, status, attempts FROM walk WHERE over
UNION ALL SELECT job, cut_began, cut, 'interrupted', cut_attempts FROM walk WHERE cut IS NOT NULL
UNION ALL SELECT w.job, w.began, w.t + {SILENCE_MS}, 'interrupted', w.attempts FROM walk w JOIN seen s ON s.job = w.job AND s.i = w.i
WHERE s.final AND NOT w.over AND w.status IN ('running', 'analyzed') AND w.t + {SILENCE_MS} < (SELECT max(epoch_us(ts) // 1000) FROM events)
"""


def _job_events(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("sequence"), F.expr(_STATUS).alias("status"))


@query(_LIVES_SQL)
def job_lives(spark: SparkSession, d: str) -> DataFrame:
    return lives.lives(_job_events(table(spark, d, "events")), SILENCE_MS, RETRIES)


@query(_LIVES_SQL)
def job_lives_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same events as a stream, watched with timers until its end."""
    kept = spark.conf.get(lives.STORE)
    path = f"{shared.folder(spark)}/lives-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be one file
    spark.conf.set(lives.STORE, lives.ROCKS)
    try:
        told = lives.watched(_job_events(stream), SILENCE_MS, RETRIES, "0 seconds")
        told.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(lives.STORE, kept)
    return spark.read.schema(lives.LIVES).parquet(path)


_SPAN = "array(named_struct('text', l_linestatus || ' ', 'size', CAST(l_quantity AS DOUBLE)), named_struct('text', CAST(l_suppkey AS STRING), 'size', CAST(l_linenumber * 7 AS DOUBLE)))"
_DX, _DY = "CAST(l_partkey % 5 AS DOUBLE) / 10", "CASE WHEN l_partkey % 2 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(l_suppkey % 13 AS DOUBLE) / 10 END"


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, trim(l_linestatus || '  ' || l_suppkey) AS block_text, trim(l_linestatus || ' ' || l_suppkey) AS line_text,
       greatest(l_quantity::DOUBLE, (l_linenumber * 7)::DOUBLE) AS size, abs({_DX}) < 0.25::DOUBLE AND abs(abs({_DY}) - 1) < 0.25::DOUBLE AS vertical,
       least(1::DOUBLE, (l_quantity * l_linenumber)::DOUBLE / greatest((l_partkey % 100)::DOUBLE, 1)) AS coverage,
       round_even((l_partkey * 5 + 2.5::DOUBLE), 0) AS rounded
FROM lineitem
""")
def span_facts(spark: SparkSession, d: str) -> DataFrame:
    """Texts and sizes of spans, directions, shares of a page, rounded numbers."""
    rows = table(spark, d, "lineitem").selectExpr("*", f"{_SPAN} AS spans", f"{_DX} AS dx", f"{_DY} AS dy")
    share = geometry.coverage((F.col("l_quantity") * F.col("l_linenumber")).cast("double"), (F.col("l_partkey") % 100).cast("double"))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        text.spans_text(F.col("spans")).alias("block_text"),
        text.line_text(F.col("spans")).alias("line_text"),
        text.max_span_size(F.col("spans")).alias("size"),
        text.is_vertical(F.col("dx"), F.col("dy")).alias("vertical"),
        share.alias("coverage"),
        text.half_even(F.col("l_partkey") * 5 + F.lit(2.5)).alias("rounded"),
    )


ROOT = "/library/Class 8/physics"


@query("SELECT doc_id, 'Class 8|physics|' || replace(source, '/', '|') || '|' || doc_id || '.pdf' AS parts, '8' AS class_name FROM documents")
def rooted_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths below a folder that is itself a subject of a class."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("path"))
    parts = docs.select("doc_id", classify.context_parts(F.col("path"), ROOT).alias("parts"))
    return parts.select("doc_id", F.array_join("parts", "|").alias("parts"), classify.infer_class(F.col("parts")).alias("class_name"))


_KINDS = "CASE doc_id % 4 WHEN 0 THEN 'dpp' WHEN 1 THEN 'test' WHEN 2 THEN 'ncert' ELSE 'normal' END"


@query(f"""
WITH k AS (SELECT doc_id, {_KINDS} AS kind, text FROM documents), n AS (SELECT doc_id, kind, trim(regexp_replace(lower(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' DPP 7 of NCERT: this test contains' ELSE '' END), '[^a-z0-9]+', ' ', 'g')) AS t FROM k)
SELECT doc_id, CASE {' '.join(f"WHEN kind = '{k}' AND contains(t, '{phrase}') THEN {v}::DOUBLE" for k, phrase, v in rules.TYPE_EVIDENCE)} ELSE {rules.BASE_CONFIDENCE}::DOUBLE END AS confidence FROM n
""")
def type_confidences(spark: SparkSession, d: str) -> DataFrame:
    """How sure a document's type is, by what its first page says."""
    more = F.when(F.col("doc_id") % 3 == 0, " DPP 7 of NCERT: this test contains").otherwise("")
    docs = table(spark, d, "documents").select("doc_id", F.expr(_KINDS).alias("kind"), F.concat(F.coalesce("text", F.lit("")), more).alias("first"))
    return docs.select("doc_id", rules.type_confidence(F.col("kind"), F.col("first")).alias("confidence"))


@query("SELECT arg_max('/in/' || (o_custkey % 3), (o_orderdate, o_orderkey)) AS input_root FROM orders")
def journal_root(spark: SparkSession, d: str) -> DataFrame:
    """The input of the last run; another one than expected is an error."""
    runs = table(spark, d, "orders").select(F.concat(F.lit("/in/"), (F.col("o_custkey") % 3).cast("string")).alias("input_root"), F.struct("o_orderdate", "o_orderkey").alias("started_at"))
    last = runs.agg(F.max_by("input_root", "started_at").alias("root")).first()["root"]
    return state.same_root(runs, last)
