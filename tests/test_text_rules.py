import pytest
from pyspark.sql import functions as F

from paperloom.functions import rules, text
from paperloom.plans.classify import classify, run_filters


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("  A--b 9 ", "a b 9"), ("été", "t"), ("", ""), ("page 12 of 7", "page 12 of 7")])
def test_norm(spark, raw, want):
    assert one(spark, text.norm(F.col("t")), t=raw) == want


def test_signature_keeps_page_numbers_apart_from_words(spark):
    assert one(spark, text.repeat_signature(F.col("t")), t="Page 12 / B2 of 30") == "page # b2 of #"


@pytest.mark.parametrize(("raw", "name", "number"), [("06 Living Things", "Living Things", "06"), ("Sound", "Sound", None), ("7up", "7up", None)])
def test_chapter(spark, raw, name, number):
    assert one(spark, text.chapter_name(F.col("t")), t=raw) == name
    assert one(spark, text.chapter_number(F.col("t")), t=raw) == number


@pytest.mark.parametrize(("raw", "want"), [("Class 9", "9"), ("10th class", "10"), ("std_6", "6"), ("8", "8"), ("10 Sound", None), ("class 11", None)])
def test_class(spark, raw, want):
    assert one(spark, text.class_number(F.col("t")), t=raw) == want


def test_duration_and_marks(spark):
    page = "TIME : 45 Minutes   Max. Marks - 30"
    assert one(spark, text.duration(F.col("t")), t=page) == "45 Minutes"
    assert one(spark, text.max_marks(F.col("t")), t=page) == "30"
    assert one(spark, text.duration(F.col("t")), t="none") is None


@pytest.mark.parametrize(
    ("stem", "want"),
    [("Race _ solutions_topic", "DPP"), ("Topic_Key point", "KEY POINTS"), ("Chapter Test 2", "CHAPTER TEST"), ("NCERT _ solutions_X", "NCERT SOLUTIONS"), ("Exercise _ solutions", "EXERCISE"), ("Test 9", "TEST"), ("Testing", "NOTES"), ("anything", "NOTES")],
)
def test_material(spark, stem, want):
    assert one(spark, rules.material_type(F.col("t")), t=stem) == want


def test_classify_paths(spark):
    rows = [
        ("9th class/science/10 Sound/Test 9.pdf", "This test contains 9 questions"),
        ("6/science/07 Measurement and Motion/notes.pdf", None),
        ("Class 7/maths/Unsorted/sheet.pdf", ""),
        ("Class 8/bio/excluded/sheet.pdf", ""),
        ("stray/x.pdf", ""),
        ("class 10/Biology/Tissues.pdf", ""),
        ("Class 7/maths/1 Sets/Lesson Planner.pdf", ""),
    ]
    out = {r["path"]: r for r in classify(spark.createDataFrame(rows, "path string, first_page string")).collect()}
    a = out[rows[0][0]]
    assert (a["class_name"], a["subject"], a["chapter"], a["chapter_number"], a["document_type"], a["confidence"]) == ("9", "physics", "Sound", "10", "test", 0.96)
    b = out[rows[1][0]]
    assert (b["class_name"], b["subject"], b["material_type"], b["confidence"]) == ("6", "physics", "NOTES", 0.78)
    assert not out[rows[2][0]]["classified"] and out[rows[2][0]]["chapter"] is None
    assert out[rows[3][0]]["exclusion"] == "inside excluded folder"
    assert not out[rows[4][0]]["classified"]
    assert out[rows[5][0]]["chapter"] == "Tissues.pdf"
    assert out[rows[6][0]]["exclusion"] == "administrative plan/schedule file"


def test_reviewed_record_needs_anchors_and_class(spark):
    path = "9th class/science/Unsorted/original (1).pdf"
    record = spark.createDataFrame([(path, "9", "biology", "Tissues", "02", "PRACTICE SHEET", ["biology", "tissues"])], "path string, class_name string, subject string, chapter string, chapter_number string, material_type string, anchors array<string>")
    docs = lambda page: spark.createDataFrame([(path, page)], "path string, first_page string")
    assert classify(docs("Biology: Tissues"), reviewed=record).first()["chapter"] == "Tissues"
    assert not classify(docs("Physics"), reviewed=record).first()["classified"]


def test_root_context(spark):
    row = classify(spark.createDataFrame([("10 Sound/a.pdf", "")], "path string, first_page string"), root="/lib/9th class/science").first()
    assert (row["class_name"], row["subject"], row["chapter"]) == ("9", "physics", "Sound")


def test_run_filters(spark):
    rows = spark.createDataFrame([("6", "Physics", "Sound Waves", "NOTES"), ("7", "physics", "Light", "TEST")], "class_name string, subject string, chapter string, material_type string")
    assert run_filters(rows).count() == 2
    assert run_filters(rows, subject="PHYSICS", chapter="sound").count() == 1
    assert run_filters(rows, class_name="07").count() == 0
