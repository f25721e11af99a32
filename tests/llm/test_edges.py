"""Nulls, empty and very long texts, repeated rows, empty tables and columns
with clashing names, for all operators and stages."""

import hashlib
import os
import random
import subprocess
import sys

import public_tokenizers as P
import pytest

import corpus_pipeline as cp
from paperloom.llm.bpe import bpe
from paperloom.llm.exact_dedup import exact_dedup
from paperloom.llm.html_extract import html_extract
from paperloom.llm.language_id import language_id
from paperloom.llm.mixing import pareto_mix
from paperloom.llm.secret_scan import secret_scan
from paperloom.llm.simhash_dedup import fingerprint, simhash_dedup
from paperloom.llm.suffix_dedup import suffix_dedup
from paperloom.llm.topk_search import topk_search
from paperloom.llm.toxicity import toxicity

#: Names that the operators use inside.
CLASHES = "rid long, raw string, buckets string, name long, round int, size string, source_size string, p string, rank string, t string, word string, chunk string, payload string, key string, code string, spans string, fp string, label string, held_out string, score string, found string, base string, runs string, predicted string, copies string, v string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
EXTRA = tuple(7 if "long" in c or "int" in c else "x" for c in CLASHES.split(", "))
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def _rows():
    r = random.Random(3)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 7)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("abcdef" if i % 2 else "klmnop", r.randint(1, 60)), "aa" if i % 2 else "bb", f"s{i % 3}") for i in range(60)]
    long = text("abcdef", 200_000)
    rows += [(100, long, "aa", "s0"), (101, "x" * 1_000_000, None, None), (102, "klm " * 250_000, "bb", "s1"), (103, long[:-1], "aa", "s0")]
    rows += [(200, None, "aa", "s0"), (None, None, None, None), (201, "", "bb", None), (None, "abc fed", "aa", "s1"), rows[5], rows[5], (5, rows[6][1], "bb", "s0")]
    return [(*x, len(x[1] or ""), *EXTRA) for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(100, 0, "y"), (None, 1, "z")], "doc_id long, toxic int, text string")


OPERATORS = {
    "exact_dedup": lambda docs, _: exact_dedup(docs),
    "secret_scan": lambda docs, _: secret_scan(docs),
    "pareto_mix": lambda docs, _: pareto_mix(docs),
    "bpe": lambda docs, _: bpe(docs, RANKS, P.PATTERN),
    "suffix_dedup": lambda docs, _: suffix_dedup(docs),
    "simhash_dedup": lambda docs, _: simhash_dedup(docs),
    "language_id": lambda docs, _: language_id(docs),
    "toxicity": lambda docs, labels: toxicity(docs, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row_and_none_for_none(docs, labels, name):
    rows = _rows()
    got = OPERATORS[name](docs, labels).collect()
    key = lambda x: (x is None, x)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((x[0] for x in rows), key=key)
    assert OPERATORS[name](docs.limit(0), labels).collect() == [] and OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    text = {x[0]: x[1] or "" for x in rows}
    if name == "exact_dedup":
        assert all(r["text_sha256"] == hashlib.sha256(text[i].encode()).hexdigest() for i in (100, 101, 102, 200) for r in by[i])
        assert [r["group_size"] for r in by[200]] == [3] and sum(r["kept"] for r in by[5]) == 1 and by[103][0]["keep_id"] == 103
    if name == "bpe":
        assert all(bytes(r["decoded"]) == text[i].encode() for i in (100, 101, 102, 201) for r in by[i])
    if name == "suffix_dedup":
        # the long text and the one without its last letter cover each other, but for that letter
        assert by[103][0]["n_removed"] == len(text[103]) and by[100][0]["n_removed"] == len(text[100]) - 1 and by[101][0]["n_spans"] == 1
    if name == "simhash_dedup":
        assert all(r["fingerprint"] == f"{fingerprint(text[i]):016x}" for i in (100, 101, 102, 201) for r in by[i])
        assert by[200][0]["fingerprint"] == "0" * 16 and by[200][0]["component_id"] == by[201][0]["component_id"]
    if name == "language_id":
        assert {r["lang_pred"] for r in by[200] + by[201]} == {"und"} and by[100][0]["lang_pred"] == "aa" and by[102][0]["lang_pred"] == "bb"
    if name == "toxicity":
        assert len({r["score"] for r in by[200] + by[201]}) == 1
    if name == "pareto_mix":
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in got) and by[100][0]["size"] == 200_000 and by[201][0]["taken"] == 0


def test_a_missing_library_is_not_taken_for_a_missing_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    assert b"xxhash" in subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).stderr


def test_vectors_and_pages(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0], 5, "x") for i in range(0, 100, 10)] + [(20, [9.0, 9.0], 5, "x"), (None, [1.0, 1.0], 5, "x"), (40, None, 5, "x")], "vec_id long, embedding array<float>, rid int, score string")
    got = topk_search(vectors).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 60, 80} and all(r["vec_id"] != r["query_id"] for r in got)
    body = "<p>" + "A sentence of the article, and another one. " * 30_000 + "</p>"
    pages = [(1, "u", f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title of it</h1>{body}</article>", "x", 1), (2, None, None, "x", 1), (None, "u", "", "x", 1), (2, None, None, "x", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int")
    found = html_extract(df).collect()
    assert len(found) == 4 and html_extract(df.limit(0)).count() == 0
    assert next(r for r in found if r["page_id"] == 1)["n_chars"] > 1_000_000 and all(r["text"] == "" for r in found if r["page_id"] != 1)


def test_stages_of_nothing(spark, docs):
    for name, stage in cp.STAGES:
        none = stage(spark, docs.limit(0), "")
        assert none.count() == 0 and (name == "byte_bpe" or none.columns == list(cp.COLUMNS))


def test_stages_take_repeated_rows_and_clashing_columns(spark, docs, tmp_path):
    rows = {(x[0], x[1] or "") for x in _rows()}
    before = len(_rows())
    now = docs
    for name, stage in cp.STAGES[:-1]:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        got = [(r["doc_id"], r["text"] or "") for r in now.collect()]
        assert set(got) <= rows and (name == "mixing" or len(got) <= before)
        before = len(got)
        if name == "exact_dedup":
            assert len({t for _, t in got}) == len(got)
        if name == "near_dedup":
            assert not {100, 103} <= {i for i, _ in got}
    assert cp.STAGES[-1][1](spark, now, "").count() == before
