import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from paperloom import queries as library

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_library_does_not_use_the_llm_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "paperloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read()), name


def test_entry_works_without_the_llm_subpackage():
    code = "import sys; sys.modules['paperloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'norm_text' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_library_query_has_an_oracle():
    # the way from markup to audit is held against plain Python in test_markup.py
    assert set(library.QUERIES) - {"html_audit"} == set(library.ORACLE_SQL)


def plain(value):
    """Values of both engines in one form; floats to 12 digits."""
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return db


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = library.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    found = duck.execute(library.ORACLE_SQL[name])
    assert sorted(c[0] for c in found.description) == columns
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = [tuple(row[i] for i in order) for row in found.fetchall()]
    rows = lambda x: sorted((plain(tuple(r)) for r in x), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want)


def test_position_shift_equals_its_sql_where_turns_are_repeated(spark, tmp_path):
    import duckdb

    turns = [(1, 0, "a b a c"), (1, 1, "b a x a"), (1, 1, "a a q b"), (1, 0, "a b a c"), (1, 2, "a")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(f"SELECT doc, page, shift, checks FROM ({library.ORACLE_SQL['position_shift']})").fetchall()
    got = library.QUERIES["position_shift"](spark, str(tmp_path)).select("doc", "page", "shift", "checks")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rows_of_a_union_are_dealt_anew(spark):
    """Sides that lie by one key each are merged apart by adaptive execution, so their union lies by none."""
    from paperloom.operators import matching

    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    words = session.sql("SELECT id % 3 AS doc, id % 5 AS page, CAST(id % 2 AS STRING) AS token, named_struct('x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 1D) AS box FROM range(60)")
    plan = matching.position_shifts(words, words.distinct())._jdf.queryExecution().executedPlan().initialPlan()
    claims, left = [], [plan]
    while left:
        node = left.pop()
        left += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Union":
            claims.append(node.outputPartitioning().toString())
    assert claims and all(c.startswith("Unknown") for c in claims)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
