"""Publications that are interrupted, writers that meet, and work that is kept."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from paperloom.operators import inventory, memo, numbering, selection
from paperloom.plans import content
from paperloom.sources import ledger, publish


class Killed(BaseException):
    """Nothing catches it, like the end of a process."""


def _values(df):
    return sorted(r[0] for r in df.collect())


def _prepared(spark, tmp_path, step=lambda _: None):
    report, table = str(tmp_path / "report"), str(tmp_path / "table")
    if not (tmp_path / "table").exists():
        for target, n in ((report, 2), (table, 3)):
            spark.range(n).write.parquet(target)
    p = publish.Publication(spark, table, [report, table], step)
    p.add(spark.range(20), report)
    p.add(spark.range(30), table)
    return report, table, p


def test_a_kill_at_any_step_leaves_old_or_new_whole(spark, tmp_path):
    steps = []
    _prepared(spark, tmp_path / "whole", steps.append)[2].commit()
    assert steps[0] == "journal" and steps[-2:] == ["commit", "clean"] and len(steps) == 7
    for n, name in enumerate(steps):
        seen = []

        def step(s, seen=seen, n=n):
            if len(seen) == n:
                raise Killed
            seen.append(s)

        report, table, p = _prepared(spark, tmp_path / str(n), step)
        with pytest.raises(Killed):
            p.commit()
        new = name == "clean"
        sizes = lambda f: [f(t).count() for t in (report, table)]
        assert sizes(lambda t: publish.published(spark, t, table)) == ([20, 30] if new else [2, 3]), name
        done = publish.recover(spark, table, [report, table])
        assert done == ("finished" if new else "" if name == "journal" else "taken back")
        assert sizes(spark.read.parquet) == ([20, 30] if new else [2, 3])
        assert publish.recover(spark, table, [report, table]) == ""
        left = [x.name for x in (tmp_path / str(n)).iterdir() if not x.name.endswith(".crc") and x.name not in ("report", "table")]
        assert left == [] or name == "journal" and all(".stage" in x for x in left)


def test_an_error_on_the_way_takes_all_back(spark, tmp_path):
    def step(s):
        if s.startswith("replace") and s.endswith("table"):
            raise OSError("no room")

    report, table, p = _prepared(spark, tmp_path, step)
    with pytest.raises(publish.PublicationError):
        p.commit()
    assert [spark.read.parquet(t).count() for t in (report, table)] == [2, 3]


def test_foreign_edits_are_refused_and_kept(spark, tmp_path):
    def step(s):
        if s == "commit":
            raise Killed

    report, table, p = _prepared(spark, tmp_path, step)
    with pytest.raises(Killed):
        p.commit()
    spark.range(77).write.mode("overwrite").parquet(report)
    for _ in range(2):
        with pytest.raises(publish.PublicationError) as e:
            publish.recover(spark, table, [report, table])
        assert e.value.recovery_required and spark.read.parquet(report).count() == 77
    with pytest.raises(publish.PublicationError):
        publish.publish(spark.range(1), table)  # its journal names a target it may not touch


def test_journals_are_checked(spark, tmp_path):
    def step(s):
        if s == "commit":
            raise Killed

    report, table, p = _prepared(spark, tmp_path, step)
    with pytest.raises(Killed):
        p.commit()
    path = tmp_path / "table.publication.json"
    good = json.loads(path.read_text())
    entry = good["entries"][0]
    bad = [{"version": 2}, {"token": "x"}, {"anchor": "/other"}, {"entries": []}, {"entries": [entry, entry]}, {"entries": [entry | {"backup": "/etc"}]}, {"entries": [entry | {"staged": "no"}]}, {"entries": [entry | {"previous": "no"}]}]
    for change in bad:
        (tmp_path / ".table.publication.json.crc").unlink(missing_ok=True)
        path.write_text(json.dumps(good | change))
        with pytest.raises(publish.PublicationError):
            publish.recover(spark, table, [report, table])
    path.write_text("{")
    with pytest.raises(publish.PublicationError):
        publish.recover(spark, table, [report, table])
    path.write_text(json.dumps(good))
    assert publish.recover(spark, table, [report, table]) == "taken back"


def test_a_failed_check_leaves_the_old_table(spark, tmp_path):
    target = str(tmp_path / "t")
    publish.publish(spark.range(3), target)
    with pytest.raises(ValueError):
        publish.publish(spark.range(0), target, valid=lambda df: df.count() > 0)
    assert spark.read.parquet(target).count() == 3 and [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["t"]


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    book = lambda: ledger.Ledger(spark, str(tmp_path), "k", "k int, v string")
    rows = lambda keys, v: spark.createDataFrame([(k, v) for k in keys], "k int, v string")
    book().commit(rows(range(10), "base"))
    barrier, errors = threading.Barrier(4), []

    def write(n):
        met = []

        def between():
            if not met:
                met.append(1)
                barrier.wait(60)

        try:
            book().commit(rows([n, 100 + n], f"w{n}"), between)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and book().version() == 5
    want = {n: f"w{n}" if n < 4 else "base" for n in range(10)} | {100 + n: f"w{n}" for n in range(4)}
    assert {r["k"]: r["v"] for r in book().read().collect()} == want
    assert book().compact() == 6 and len(book().parts(6)) == 1
    assert {r["k"]: r["v"] for r in book().read().collect()} == want
    assert {r["v"] for r in book().read(1).collect()} == {"base"} and ledger.Ledger(spark, str(tmp_path / "none"), "k", "k int, v string").read().count() == 0


def test_an_inventory_by_delta_equals_a_rebuild(spark):
    r = random.Random(6)
    calls = []

    def classify(files):
        calls.append(files.count())
        even = F.col("size") % 2 == 0
        return files.select("path", "size", "mtime_ns", F.when(even, "classified").otherwise("excluded").alias("status"), F.concat(F.lit("f"), F.col("mtime_ns") % 3).alias("family"), F.lit("6").alias("class_name"), F.lit("maths").alias("subject"), F.when(even, F.array(F.lit("tables"))).alias("flags"))

    now = {f"p{i}": (r.randint(1, 9), 1) for i in range(30)}
    frame = lambda: spark.createDataFrame([(p, *s) for p, s in now.items()], "path string, size int, mtime_ns int")
    kept = inventory.built(frame(), classify, "a")
    for step in range(3):
        gone, changed = r.sample(sorted(now), 4), r.sample(sorted(now), 5)
        for p in gone:
            now.pop(p)
        for p in set(changed) & set(now):
            now[p] = (r.randint(1, 9), now[p][1] + 1)
        new = {f"n{step}{i}": (r.randint(1, 9), 1) for i in range(3)}
        now |= new
        calls.clear()
        kept = inventory.refreshed(kept, frame(), classify, "a")
        assert calls == [len(set(changed) - set(gone)) + 3]
        whole = inventory.built(frame(), classify, "a")
        for a, b in ((kept.entries, whole.entries), (kept.summary, whole.summary)):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    calls.clear()
    inventory.refreshed(kept, frame(), classify, "b")
    assert calls == [len(now)]
    assert inventory.code_signature([inventory]) == inventory.code_signature([inventory]) != inventory.code_signature([memo])


def test_every_image_is_decoded_once_and_a_change_reaches_all_its_pages(spark):
    uses = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (1, 2, 10), (1, 3, 12), (1, 3, 12), (1, 4, 13)], "doc int, page int, object int")
    states = lambda **changed: spark.createDataFrame([(1, o, changed.get(f"o{o}", "s")) for o in (10, 11, 12)], "doc int, object int, state string")
    decoded = []

    def decode(df):
        decoded.append(sorted(r["object"] for r in df.collect()))
        return df.withColumn("digest", F.concat_ws(":", "object", "state"))

    images = uses.select("doc", "object")
    digests = memo.refreshed_digests(images, states(), spark.createDataFrame([], "doc int, object int, state string, digest string"), decode)
    pages = memo.refreshed_pages(uses, states(), spark.createDataFrame([], "doc int, page int, signature string, digests array<string>"), digests)
    assert decoded == [[10, 11, 12]] and pages.filter("reused").count() == 0
    again = memo.refreshed_digests(images, states(o10="t"), digests, decode)
    told = {r["page"]: (r["reused"], r["digests"]) for r in memo.refreshed_pages(uses, states(o10="t"), pages, again).collect()}
    assert decoded[1] == [10]
    assert told == {1: (False, ["10:t", "11:s"]), 2: (False, ["10:t"]), 3: (True, ["12:s"]), 4: (True, [])}
    # all tables of a refresh are dealt once
    plan = memo.refreshed_pages(uses, states(o10="t"), pages.localCheckpoint(), again.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    order = memo.page_signatures(uses.orderBy(F.rand(1)), states()).collect()
    assert {tuple(r) for r in order} == {tuple(r) for r in memo.page_signatures(uses, states()).collect()}


def test_all_paths_are_numbered_without_one_window(spark):
    r = random.Random(9)
    paths = [f"{r.choice('abc')}/{r.choice('xyz')}{r.randint(0, 5)}/{i % 40}" for i in range(300)]
    got = selection.first_paths(spark.createDataFrame([(p,) for p in paths], "path string").repartition(7))
    rows = sorted((x["nth"], x["path"]) for x in got.collect())
    assert [n for n, _ in rows] == list(range(1, 301)) and [p for _, p in rows] == sorted(paths, key=lambda p: p.split("/"))
    again = numbering.numbered(spark.createDataFrame([(p,) for p in paths], "path string"), ["path"])
    assert again.filter("number = 1").first()["path"] == min(paths)
    # the one window without a partition is over counts of partitions
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(_n" in plan and "row_number" not in plan


def test_hits_keep_their_numbers(spark):
    words = spark.createDataFrame([(1, p, "acme", float(x), 10.0, float(x) + 5, 20.0) for p in (1, 2) for x in range(20)], "doc int, page int, text string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, p, 595.0, 842.0) for p in (1, 2)], "doc int, page int, width double, height double")
    told = [{tuple(r) for r in content.term_hits(w, pages, ["acme"]).collect()} for w in (words, words.repartition(5), words.orderBy(F.rand(2)))]
    assert told[0] == told[1] == told[2] and len(told[0]) == 40


def test_remembered_signatures_travel_as_bytes(spark):
    uses = spark.createDataFrame([(1, page, page) for page in (1, 2, 3, 4)], "doc int, page int, object int")
    states = spark.createDataFrame([(1, page, "s") for page in (1, 2, 3, 4)], "doc int, object int, state string")
    digests = spark.createDataFrame([(1, page, "new") for page in (1, 2, 3, 4)], "doc int, object int, digest string")
    known = memo.page_signatures(uses, states)
    # page 1 as it was; page 2 with no digest, page 3 with none at all, page 4 with another's
    signature = F.expr("CASE page WHEN 1 THEN signature WHEN 2 THEN 'none' WHEN 4 THEN sha2('x', 256) END")
    old = known.select("doc", "page", signature.alias("signature"), F.array(F.lit("old")).alias("digests"))
    found = memo.refreshed_pages(uses, states, old, digests)
    assert sorted((r["page"], r["reused"], r["digests"]) for r in found.collect()) == [(1, True, ["old"]), *[(page, False, ["new"]) for page in (2, 3, 4)]]
    assert sorted((r["page"], r["signature"]) for r in found.collect()) == sorted((r["page"], r["signature"]) for r in known.collect())
    dealt = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "unhex(" in dealt
