"""Ordered rules: the first that matches gives the value."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import file_stem, norm, padded_norm

# Subjects with the words that name them.
SUBJECT_ALIASES = {
    "physics": ("physics", "phy"),
    "mathematics": ("mathematics", "maths", "math"),
    "chemistry": ("chemistry", "chem"),
    "biology": ("biology", "bio"),
}
SCIENCE = "science"
NOT_CHAPTERS = ("unsorted", "excluded")

# Material types in order, with the phrases that mark them in a padded stem.
MATERIAL_RULES = (
    ("KEY POINTS", ("key point", "key points", "keypoint", "keypoints")),
    ("CHAPTER TEST", ("chapter test",)),
    ("PRACTICE TEST", ("practice test",)),
    ("PRACTICE SHEET", ("practice sheet", "practice practice sheet")),
    ("NCERT PRACTICE", ("ncert practice",)),
    ("NCERT SOLUTIONS", ("ncert solutions", "ncert solution", "ncert exercise solutions", "ncert questions solutions", "ncert question solutions", "ncert question exercise solution")),
    ("PRACTICE EXERCISE", ("practice exercise",)),
    ("EXERCISE", ("exercise solutions", "exercise solution", "exercise")),
    ("DPP", ("practice race", "race solutions", "race solution", " race ")),
    ("TEST", ("test solutions", "test solution", " test ")),
    ("NOTES", ("notes",)),
)
DEFAULT_MATERIAL = "NOTES"

# Document types and header templates of material types.
DOCUMENT_TYPES = {
    "KEY POINTS": "key_points",
    "TEST": "test",
    "PRACTICE TEST": "test",
    "CHAPTER TEST": "test",
    "DPP": "dpp",
    "PRACTICE SHEET": "practice_sheet",
    "PRACTICE EXERCISE": "exercise",
    "EXERCISE": "exercise",
    "NCERT PRACTICE": "ncert",
    "NCERT SOLUTIONS": "ncert",
    "NOTES": "notes",
}
HEADER_TEMPLATES = {
    "test": ("TEST", "PRACTICE TEST", "CHAPTER TEST", "DPP"),
    "practice": ("EXERCISE", "PRACTICE EXERCISE", "PRACTICE SHEET", "NCERT PRACTICE", "NCERT SOLUTIONS"),
    "none": ("KEY POINTS",),
}
# Phrases that raise the confidence of a document type.
TYPE_EVIDENCE = (("test", "this test contains", 0.96), ("dpp", "dpp", 0.94), ("ncert", "ncert", 0.93))
BASE_CONFIDENCE = 0.78

# File names of administrative documents.
ADMIN_WORDS = ("plan", "planner", "schedule", "timetable", "calendar")

# Science chapters of each class with their subject, in order.
SCIENCE_CHAPTERS = {
    "6": (
        ("components of food", "biology"),
        ("sorting materials into groups", "chemistry"),
        ("separation of substances", "chemistry"),
        ("getting to know plants", "biology"),
        ("body movements", "biology"),
        ("the living organisms characteristics and habitats", "biology"),
        ("measurement and motion", "physics"),
        ("light shadows and reflection", "physics"),
        ("electricity and circuits", "physics"),
        ("fun with magnets", "physics"),
        ("air around us", "chemistry"),
    ),
    "7": (
        ("nutrition in plants", "biology"),
        ("nutrition in animals", "biology"),
        ("heat", "physics"),
        ("acids bases and salts", "chemistry"),
        ("physical and chemical changes", "chemistry"),
        ("respiration in organisms", "biology"),
        ("transportation in plants and animals", "biology"),
        ("reproduction in plants", "biology"),
        ("motion and time", "physics"),
        ("electric current and its effects", "physics"),
        ("light", "physics"),
        ("forests our lifeline", "biology"),
        ("waste water story", "biology"),
    ),
    "8": (
        ("crop production and management", "biology"),
        ("microorganisms friend and foe", "biology"),
        ("coal and petroleum", "chemistry"),
        ("combustion and flame", "chemistry"),
        ("conservation of plants and animals", "biology"),
        ("reproduction in animals", "biology"),
        ("reaching the age of adolescence", "biology"),
        ("force and pressure", "physics"),
        ("friction", "physics"),
        ("sound", "physics"),
        ("chemical effects of electric current", "chemistry"),
        ("some natural phenomena", "physics"),
        ("light", "physics"),
        ("pressure winds storms and cyclones", "physics"),
    ),
    "9": (
        ("matter in our surroundings", "chemistry"),
        ("is matter around us pure", "chemistry"),
        ("atoms and molecules", "chemistry"),
        ("structure of the atom", "chemistry"),
        ("the fundamental unit of life", "biology"),
        ("tissues", "biology"),
        ("motion", "physics"),
        ("gravitation", "physics"),
        ("thrust and pressure", "physics"),
        ("work and energy", "physics"),
        ("sound", "physics"),
        ("natural resources", "biology"),
        ("improvement in food resources", "biology"),
    ),
}


def first_of(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule whose condition holds; null counts as no."""
    return reduce(lambda rest, r: F.when(r[0], F.lit(r[1]) if not isinstance(r[1], Column) else r[1]).otherwise(rest), reversed(rules), F.lit(otherwise))


def phrase_rules(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str | None = None) -> Column:
    """The label of the first rule one of whose phrases the text contains."""
    any_of = lambda phrases: reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])
    return first_of([(any_of(phrases), label) for label, phrases in rules], otherwise)


def material_type(stem: Column) -> Column:
    return phrase_rules(padded_norm(stem), MATERIAL_RULES, DEFAULT_MATERIAL)


def lookup(key: Column, values: Mapping[str, str], otherwise: str | None = None) -> Column:
    return first_of([(key == k, v) for k, v in values.items()], otherwise)


def document_type(material: Column) -> Column:
    return lookup(material, DOCUMENT_TYPES, "normal")


def header_template(material: Column) -> Column:
    return first_of([(material.isin(*names), template) for template, names in HEADER_TEMPLATES.items()], "notes")


def header_label(material: Column, chapter: Column) -> Column:
    key_points = F.concat(chapter, F.lit(" — KEY POINTS"))
    return F.when(material == "NOTES", chapter).when(material == "KEY POINTS", key_points).otherwise(F.concat(material, F.lit("  ·  "), chapter))


def type_confidence(kind: Column, first_page: Column) -> Column:
    text = norm(F.coalesce(first_page, F.lit("")))
    return first_of([((kind == k) & F.contains(text, F.lit(phrase)), v) for k, phrase, v in TYPE_EVIDENCE], BASE_CONFIDENCE)


def subject_of_words(words: Column) -> Column:
    """The first subject one of whose names is among an array of words."""
    return first_of([(F.arrays_overlap(words, F.array(*[F.lit(a) for a in names])), subject) for subject, names in SUBJECT_ALIASES.items()])


def _science_rules() -> Column:
    """The chapters as a table in one literal: array of struct(k, c, s)."""
    rows = [{"k": k, "c": name, "s": subject} for k, chapters in SCIENCE_CHAPTERS.items() for name, subject in chapters]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<k:string,c:string,s:string>>")


def science_subject(class_name: Column, chapter: Column) -> Column:
    """The chapter's subject: the same name, else the first that contains it or
    that it contains."""

    def first(x: Column) -> Column:
        of_class = F.filter(x["rules"], lambda r: r["k"] == x["class"])
        same = F.filter(of_class, lambda r: r["c"] == x["chapter"])
        near = F.filter(of_class, lambda r: F.contains(x["chapter"], r["c"]) | F.contains(r["c"], x["chapter"]))
        return F.get(F.concat(same, near), 0)["s"]

    # bound once a row
    return F.get(F.transform(F.array(F.struct(_science_rules().alias("rules"), class_name.alias("class"), chapter.alias("chapter"))), first), 0)


def exclusion_reason(folders: Column, stem: Column) -> Column:
    """Why a file is left out, or null."""
    admin = padded_norm(stem).rlike(rf"[_\-\s](?:{'|'.join(ADMIN_WORDS)})[_\-\s]")
    return F.when(F.exists(folders, lambda p: norm(p) == "excluded"), "inside excluded folder").when(admin, "administrative plan/schedule file")


def all_anchors(text: Column, anchors: Column) -> Column:
    return F.forall(anchors, lambda a: F.contains(text, a))


def stem_of(path: Column) -> Column:
    return file_stem(path)
