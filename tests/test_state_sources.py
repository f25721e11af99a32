import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import rollups, state
from paperloom.sources import library, manifests, profiles, publish
from paperloom.streaming import jobs


def test_order_statistic_is_by_index(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("b", 7.0), ("b", None)], "k string, v double")
    got = {r["k"]: r["statistic"] for r in rollups.order_statistic(df, ["k"], "v", 0.55).collect()}
    assert got == {"a": 3.0, "b": 7.0}


def test_retention_of_a_missing_token_is_not_full(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "k int, token string")
    b = spark.createDataFrame([(1, "x")], "k int, token string")
    assert abs(rollups.multiset_retention(a, b, ["k"]).first()["retention"] - 1 / 3) < 1e-12


def test_dominant_bucket_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([("a", 1, 25.0), ("a", 2, 5.0), ("a", 3, 26.0), ("a", 4, 6.0)], "k string, at int, v double")
    r = rollups.dominant_bucket(df, ["k"], "v", F.col("at"), 10).first()
    assert (r["bucket"], r["n"], r["median"]) == (2, 2, 25.5)


def test_dominant_bucket_keeps_null_groups_and_rows_without_a_value_as_its_sql_does(spark, tmp_path):
    import duckdb

    from paperloom import queries as library

    lines = [(1, 1, 7, 9000.0), (1, 2, 7, 100.0), (2, 1, 7, 8500.0), (2, 2, None, 100.0), (3, 1, None, 300.0), (3, 2, None, 9000.0), (4, 1, 8, None), (4, 2, 8, None), (5, 1, 8, 100.0), (6, 1, 9, None), (None, 1, 5, 9000.0), (7, 1, 5, 100.0), (8, 1, 4, 7000.0), (8, 1, 4, 100.0), (8, 2, 4, 9000.0)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        expected = db.execute(library.ORACLE_SQL["dominant_bucket"]).fetchall()
    got = [tuple(r) for r in library.dominant_bucket(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_cache_is_stale_if_anything_differs(spark):
    now = spark.createDataFrame([("A", 1, 1, "h", "o", False), ("b", 1, 1, "h", "o", False), ("c", 1, 1, "h2", "o", False), ("d", 1, 1, "h", "o", True), ("e", 1, 1, "h", "o", False)], "key string, size int, mtime int, sha string, output_sha string, pending boolean")
    cache = spark.createDataFrame([("a", "p", "1", 1, 1, "h", "o", True), ("b", "p", "1", 1, 2, "h", "o", True), ("c", "p", "1", 1, 1, "h", "o", True), ("d", "p", "1", 1, 1, "h", "o", True), ("e", "q", "1", 1, 1, "h", "o", True)], "key string, profile_hash string, engine_version string, size int, mtime int, sha string, output_sha string, qa_passed boolean")
    assert {r["key"]: r["is_fresh"] for r in state.fresh(now, cache, "p", "1").collect()} == {"A": True, "b": False, "c": False, "d": False, "e": False}


def test_state_fold_recovery_and_exit(spark):
    events = spark.createDataFrame([("j", 1, "running", None), ("j", 2, "failed", "boom"), ("j", 3, "running", None), ("k", 1, "completed", "ok")], "job string, sequence int, status string, message string")
    now = state.current_state(events, "job", ["sequence"], ["status", "message"], F.col("status") == "running")
    got = {r["job"]: (r["status"], r["message"], r["attempts"]) for r in now.collect()}
    assert got == {"j": ("running", "boom", 2), "k": ("completed", "ok", 0)}
    back = state.recovered(now)
    assert {r["status"] for r in back.collect()} == {"interrupted", "completed"}
    assert state.to_retry(spark.createDataFrame([("j",), ("k",)], "job string"), back, "job").count() == 1
    assert state.exit_code(back).first()[0] == 0 and state.exit_code(back, cancelled=True).first()[0] == 130
    assert state.exit_code(back.withColumn("status", F.lit("qa_failed"))).first()[0] == 2


def test_journal_of_another_input_is_refused(spark):
    runs = spark.createDataFrame([("/a", 1), ("/b", 2)], "input_root string, started_at int")
    assert state.same_root(runs, "/b").first()[0] == "/b"
    with pytest.raises(Exception, match="another input"):
        state.same_root(runs, "/a").collect()


def test_upsert_prefers_changes_and_later_rows(spark):
    t = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept")], "k string, v int, x string")
    c = spark.createDataFrame([("a", 1, "new"), ("b", 4, "late"), ("c", 1, "added")], "k string, v int, x string")
    assert sorted(r["x"] for r in state.upsert(t, c, "k", "v").collect()) == ["added", "kept", "new"]


def test_discover_orders_hashes_and_excludes(spark, tmp_path):
    for p in ("a/b.pdf", "a b/c.PDF", "out/x.pdf", "a/n.tmp.pdf", "a/t.txt", "a/q.QA_FAILED.pdf"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    found = library.discover(spark, str(tmp_path), str(tmp_path / "out"), content=True).orderBy(library.in_path_order()).collect()
    assert [r["path"] for r in found] == ["a/b.pdf", "a b/c.PDF"]
    assert len(found[0]["sha256"]) == 64


def test_selections(spark, tmp_path):
    f = tmp_path / "m.json"
    for raw in (["x"], {"sources": [{"source_id": "x"}], "fixtures": [{"source_id": "y"}]}):
        f.write_text(json.dumps(raw))
        want = {"x"} if isinstance(raw, list) else {"y"}
        assert {r["source_id"] for r in manifests.read_selection(spark, str(f)).collect()} == want
    assert {r["source_id"] for r in manifests.read_selection(spark, str(f), manifests.BENCHMARK_KEYS).collect()} == {"x"}
    for bad in ('{"other": []}', '[{"no": 1}]', "[NaN]"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            manifests.read_selection(spark, str(f))
    sources = spark.createDataFrame([("x", "h"), ("z", "h")], "source_id string, sha256 string")
    wanted = spark.createDataFrame([("x", "other", None, None, None, None), ("gone", None, None, None, None, None)], manifests.SOURCE)
    chosen, wrong = manifests.selected(sources, wanted)
    assert [r["source_id"] for r in chosen.collect()] == ["x"] and sorted(r["source_id"] for r in wrong.collect()) == ["gone", "x"]


def test_profile_rules(tmp_path):
    good = {"school": {"short_name": "S", "line2": "L"}, "assets": {"logo": "l.png"}, "colors": dict.fromkeys(profiles.COLOURS, "#00ff00")}
    assert profiles.profile_errors(good) == []
    bad = [{"layout": {"header_height": float("inf")}}, {"layout": {"header_min_height": 60}}, {"layout": {"allow_rebuild_crop": 1}}, {"legacy": {"terms": []}}, {"legacy": {"raster_logo_digests": ["xyz"]}}, {"legacy": {"logo_min_width": 9, "logo_max_width": 3}}, {"legacy": {"designed_logo_fallback_ratio": [0.5, 0, 0.2, 1]}}, {"qa": {"min_body_text_retention": 2}}, {"colors": {}}]
    for part in bad:
        assert profiles.profile_errors(good | part), part
    f = tmp_path / "p.json"
    manifests.write_json(good, str(f))
    with pytest.raises(ValueError, match="colors.navy is missing"):
        manifests.write_json(good | {"colors": {}}, str(tmp_path / "q.json"))
        profiles.load_profile(str(tmp_path / "q.json"))
    assert profiles.load_profile(str(f)) == good
    assert manifests.settings_fingerprint(good, {"l": b"1"}) != manifests.settings_fingerprint(good, {"l": b"2"})


def test_profile_rules_over_many_profiles(spark):
    good = {"school": {"short_name": "S", "line2": "L"}, "assets": {"logo": "l.png"}, "colors": dict.fromkeys(profiles.COLOURS, "#00ff00"), "layout": {"header_height": 54, "dark_page_threshold": 0.4}}
    bad = {"a": {"layout": {"header_height": 2000, "dark_page_threshold": 3}}, "b": {"qa": {"x_is_error": 1, "min_ratio": 0.5}}, "c": {"legacy": {"terms": [], "raster_logo_digests": ["x", "0" * 32]}}, "d": {"colors": {"navy": 7}}, "e": {"school": {"short_name": " ", "line2": "y"}}, "f": {"legacy": {"designed_logo_fallback_ratio": [0, 0, 1]}}}
    rows = profiles.checked(profiles.leaf_rows(spark, {"good": good} | {k: good | v for k, v in bad.items()})).filter("NOT ok").collect()
    wrong = {}
    for r in rows:
        wrong.setdefault(r["profile"], set()).add(r["path"])
    assert wrong == {"a": {"layout.header_height", "layout.dark_page_threshold"}, "b": {"qa.x_is_error"}, "c": {"legacy.terms", "legacy.raster_logo_digests.0"}, "d": {"colors.navy"}, "e": {"school.short_name"}, "f": {"legacy.designed_logo_fallback_ratio"}}
    for name, paths in wrong.items():
        told = [m.split(" ")[0] for m in profiles.profile_errors(good | bad[name]) if " must be " in m]
        assert set(told) == paths


def test_publish_keeps_the_old_table_if_the_check_fails(spark, tmp_path):
    target = str(tmp_path / "t")
    publish.publish(spark.range(3), target)
    with pytest.raises(ValueError):
        publish.publish(spark.range(0), target, valid=lambda df: df.count() > 0)
    assert spark.read.parquet(target).count() == 3
    publish.publish(spark.range(5), target, valid=lambda df: df.count() == 5)
    assert spark.read.parquet(target).count() == 5 and len(list(tmp_path.iterdir())) == 1


def test_streamed_states_equal_the_batch_fold(spark, tmp_path):
    schema = "job string, sequence int, status string, message string"
    source = str(tmp_path / "in")
    rows = [[("j", 1, "running", None)], [("j", 2, "failed", "boom"), ("k", 1, "running", None)]]
    for batch in rows:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.follow(stream, str(tmp_path / "journal"), str(tmp_path / "state"), str(tmp_path / "cp"), "job", ["sequence"], ["status", "message"]).awaitTermination(60)
    got = {r["job"]: (r["status"], r["message"], r["attempts"]) for r in spark.read.parquet(str(tmp_path / "state")).collect()}
    assert got == {"j": ("failed", "boom", 1), "k": ("running", None, 1)}
    for late in ([("j", 0, "running", "first")], [("k", 3, "completed", None)], [("j", 4, "running", None)]):
        spark.createDataFrame(late, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.follow(stream, str(tmp_path / "journal"), str(tmp_path / "state"), str(tmp_path / "cp"), "job", ["sequence"], ["status", "message"]).awaitTermination(60)
    got = {r["job"]: (r["status"], r["message"], r["attempts"]) for r in spark.read.parquet(str(tmp_path / "state")).collect()}
    assert got == {"j": ("running", "boom", 3), "k": ("completed", None, 1)}
    whole = state.current_state(spark.read.parquet(source), "job", ["sequence"], ["status", "message"], F.col("status") == "running")
    assert got == {r["job"]: (r["status"], r["message"], r["attempts"]) for r in whole.collect()}


def test_markdown_and_json(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert "| a\\|b |  |" in manifests.markdown(df, "T")
    assert json.loads(manifests.rows_as_json(df).first()[0]) == {"x": "a|b", "y": None}


def test_medians_and_order_statistics_sort_a_group_once(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", 8.0), ("b", 2.0)], "k string, v double")
    middle, at = rollups.medians(df, ["k"], "v", "m"), rollups.order_statistic(df, ["k"], "v", 0.55)
    assert {r["k"]: r["m"] for r in middle.collect()} == {"a": 2.0, "b": 2.0}
    assert {(r["k"], r["statistic"], r["n"]) for r in at.collect()} == {("a", 3.0, 4), ("b", 2.0, 1)}
    for found in (middle, at):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
