"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan as ls
from .bpe import bpe
from .centroid_clusters import centroid_clusters
from .exact_dedup import exact_dedup
from .html_extract import html_extract
from .language_id import language_id
from .mixing import pareto_mix
from .secret_scan import secret_scan
from .shared import table
from .simhash_dedup import simhash_dedup
from .spelling_variants import corpus_words, spelling_variants
from .suffix_dedup import suffix_dedup
from .topk_search import topk_search
from .toxicity import toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("n_random")


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(table(spark, sf_dir, "documents")))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.license_scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_html_extract": op5_html_extract,
    "op6_topk_search": op6_topk_search,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_license_scan": op13_license_scan,
}

OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS total
  FROM sources
), leveled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted
), open_level AS (
  SELECT level AS open FROM leveled WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1
), goals AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(o.open, 'inf'::DOUBLE) * weight) AS target
  FROM leveled LEFT JOIN open_level o ON true
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS sure
  FROM goals
), counted AS (
  SELECT s.source, s.size, count(*) AS c, any_value(g.target - g.sure * g.source_size) AS rest
  FROM sized s JOIN rests g ON s.source IS NOT DISTINCT FROM g.source WHERE s.size > 0 GROUP BY s.source, s.size
), scaled AS (
  SELECT source, size, (rest - coalesce(sum(size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(size * size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS scale
  FROM counted
), scales AS (
  SELECT source, arg_max(scale, size) AS scale FROM scaled WHERE scale * size <= 1 GROUP BY source
), chances AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, g.sure, g.target - g.sure * g.source_size AS rest, s.u, least(1.0::DOUBLE, coalesce(k.scale, 0::DOUBLE) * s.size) AS p
  FROM sized s JOIN rests g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN scales k ON s.source IS NOT DISTINCT FROM k.source
), ranked AS (
  SELECT *, CASE WHEN p <= 0 THEN 'inf'::DOUBLE WHEN p >= 1 THEN -1 ELSE (u / (1 - u)) / (p / (1 - p)) END::DOUBLE AS rank FROM chances
), upto AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM ranked
), got AS (
  SELECT *, upto <= rest AND rest > 0 AS hit,
         coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS got
  FROM upto
), last AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT hit AND size > 0 AND abs(size - (rest - got)) < rest - got THEN 0 ELSE 1 END,
                               abs(size - (rest - got)), rank, doc_id) AS nth,
         NOT hit AND size > 0 AND abs(size - (rest - got)) < rest - got AS fits
  FROM got
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN least(2, sure + CASE WHEN hit OR (nth = 1 AND fits) THEN 1 ELSE 0 END) * size ELSE 0 END::BIGINT AS taken
FROM last
"""

OP6_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Strings of 200 bytes are 400 hex digits; equal md5 sums stand for equal strings.
OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT rid, k, md5(substr(h, 2 * k + 1, 400)) AS m FROM (SELECT rid, h, unnest(range(greatest(0, length(h) // 2 - 199))) AS k FROM d)
), hits AS (
  SELECT rid, k FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)
), runs AS (
  SELECT rid, min(k) AS a, max(k) + 200 AS b FROM (
    SELECT rid, k, sum(starts) OVER (PARTITION BY rid ORDER BY k ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT rid, k, CASE WHEN k - lag(k) OVER (PARTITION BY rid ORDER BY k) > 200 THEN 1 ELSE 0 END AS starts FROM hits)
  ) GROUP BY rid, run
), listed AS (
  SELECT rid, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS removed FROM runs GROUP BY rid
), kept AS (
  SELECT doc_id, length(h) // 2 AS n, coalesce(removed, 0) AS removed, coalesce(len(a), 0) AS spans,
         CASE WHEN a IS NULL THEN h ELSE list_aggregate(list_transform(range(len(a) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1, 2 * (CASE WHEN i = len(a) THEN length(h) // 2 ELSE a[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE b[i] END))), 'string_agg', '') END AS rest
  FROM d LEFT JOIN listed USING (rid)
)
SELECT doc_id, n::BIGINT AS n_bytes, removed::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""

#: crc32 bit by bit, lowest first, over the bytes of '<id>:<run>'; near pairs by joins on the words with one place masked or cut.
OP11_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), grouped AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), bits AS (
  SELECT run, n, list_transform(range(4 * length(x)), lambda i: ((('0x' || substr(x, (2 * (i // 8) + 1)::INT, 2))::BIGINT >> (i % 8)) & 1)) AS b FROM grouped
), hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, v: xor(c >> 1, 3988292384 * (xor(c, v) & 1)), 4294967295::BIGINT), 4294967295) AS h FROM bits
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), masked AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places
), cuts AS (
  SELECT DISTINCT word, n, a || b AS cut FROM masked
), near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM masked x JOIN masked y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
  UNION ALL SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS last FROM formed
  UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.last WHERE f.form IS NOT NULL
), ends AS (
  SELECT k.word, k.last AS root FROM walk k JOIN formed f ON f.word = k.last WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON f.word = e.word
"""

_ROUND_SQL = """, d{r} AS (
  SELECT s.rid, s.vec_id, s.v, c.k, list_sum(list_transform(list_zip(s.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM quantised s CROSS JOIN c{r} c
), a{r} AS (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY rid
)"""
_MEANS_SQL = """, m{r} AS (
  SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i
), c{next} AS (
  SELECT c.k, coalesce(g.c, c.c) AS c FROM c{r} c
  LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY k) g ON c.k = g.k
)"""
OP12_SQL = (
    """
WITH quantised AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM quantised ORDER BY h, v LIMIT 16)
)"""
    + "".join(_ROUND_SQL.format(r=r) + _MEANS_SQL.format(r=r, next=r + 1) for r in range(3))
    + _ROUND_SQL.format(r=3)
    + """
SELECT a.vec_id, a.k::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON a.k = c.k
"""
)


def _license_sql() -> str:
    """All blocks against all templates, without filters."""
    text = "VALUES " + ", ".join(f"('{label}', {sorted(set(words.split()))!r}, {ls.needed(len(set(words.split())), ls.LEAST_SHARE)})" for label, words in ls.TEMPLATES)
    phrases = "VALUES " + ", ".join(f"('{label}', {words.split()!r})" for label, words in ls.PHRASES)
    half = ls.BLOCK_WORDS // 2
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), templates(label, t, need) AS ({text}), phrases(label, p) AS ({phrases}),
starts AS (
  SELECT rid, w, unnest(range(len(w))) AS i FROM d
), places AS (
  SELECT a.rid, a.i, p.label FROM starts a JOIN phrases p ON a.w[a.i + 1] = p.p[1] AND list_slice(a.w, a.i + 1, a.i + len(p.p)) = p.p
), base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid
), blocks AS (
  SELECT rid, list_slice(w, (i + 1)::BIGINT, (i + {ls.BLOCK_WORDS})::BIGINT) AS b FROM (SELECT rid, w, unnest(range(0, greatest(1, len(w) - {half}), {half})) AS i FROM d)
), held AS (
  SELECT b.rid, t.label, len(list_intersect(t.t, b.b)) AS held, t.need, len(t.t) AS size FROM blocks b CROSS JOIN templates t
), found AS (
  SELECT rid, list(DISTINCT label) AS labels, max(held::DOUBLE / size) AS share FROM held WHERE held >= need GROUP BY rid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(f.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base b ON d.rid = b.rid LEFT JOIN found f ON d.rid = f.rid
"""


OP13_SQL = _license_sql()

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op3_pareto_mix": OP3_SQL,
    "op6_topk_search": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_license_scan": OP13_SQL,
}
