"""What a document is, from its path and the text of its first page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text


def _subject_marks() -> Column:
    names = [a for aliases in rules.SUBJECT_ALIASES.values() for a in aliases]
    return F.array(*[F.lit(n) for n in [*names, rules.SCIENCE]])


def context_parts(path: Column, root: str) -> Column:
    """Parts of a path below the root. If the root is itself a class folder, or
    a subject or chapter folder below one, its class and what follows it come
    first; outer folders say nothing."""
    above = [p for p in root.split("/") if p]
    marks = {a for aliases in rules.SUBJECT_ALIASES.values() for a in aliases} | {rules.SCIENCE}
    own = lambda i: _norm(above[i]) if len(above) >= -i else ""
    start = -1 if _is_class(own(-1)) else -2 if own(-1) in marks else -3 if own(-2) in marks else None
    prefix = above[start:] if start and len(above) >= -start and _is_class(_norm(above[start])) else []
    return F.concat(F.array(*[F.lit(p) for p in prefix]).cast("array<string>"), text.path_parts(path))


def _norm(s: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()


def _is_class(s: str) -> bool:
    import re

    return any(re.search(p, s) for p in text.CLASS_PATTERNS[:2])


def infer_class(parts: Column) -> Column:
    """The first pattern, in order, that a folder matches, deepest folder first."""
    folders = F.reverse(F.slice(parts, F.lit(1), F.size(parts) - 1))
    of = lambda pattern: F.transform(folders, lambda p: F.regexp_extract(text.norm(p), pattern, 1))
    first = lambda found: F.get(F.filter(found, lambda x: x != ""), 0)
    return F.coalesce(*[first(of(p)) for p in text.CLASS_PATTERNS])


def infer_subject(parts: Column, class_name: Column) -> Column:
    """A subject word in the deepest part that has one (the file's stem counts);
    else the science chapter's subject."""
    stems = F.transform(parts, lambda p: F.regexp_replace(p, r"(?<=.)\.[^.]*$", ""))
    found = F.transform(F.reverse(stems), lambda p: rules.subject_of_words(F.split(text.norm(p), " ")))
    named = F.get(F.filter(found, lambda s: s.isNotNull()), 0)
    after = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.struct(text.norm(a).alias("a"), text.strip_chapter_number(b).alias("b")))
    chapters = F.filter(F.reverse(after), lambda x: x["a"] == rules.SCIENCE)
    by_chapter = F.transform(chapters, lambda x: rules.science_subject(class_name, x["b"]))
    return F.coalesce(named, F.get(F.filter(by_chapter, lambda s: s.isNotNull()), 0))


def chapter_part(parts: Column) -> Column:
    """The part after the first subject folder that is no holding folder; else
    the file's own folder."""
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    after = F.zip_with(folder, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    usable = F.filter(after, lambda x: F.array_contains(_subject_marks(), text.norm(x["a"])) & ~text.norm(x["b"]).isin(*rules.NOT_CHAPTERS))
    return F.coalesce(F.get(usable, 0)["b"], F.try_element_at(parts, F.lit(-2)), F.lit(""))


def is_unsorted(parts: Column) -> Column:
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: text.norm(p) == "unsorted")


def classify(docs: DataFrame, root: str = "", reviewed: DataFrame | None = None) -> DataFrame:
    """docs: (path, first_page). Adds class_name, subject, chapter,
    chapter_number, material_type, duration, max_marks, document_type,
    confidence, exclusion and classified.

    reviewed: (path, class_name, subject, chapter, chapter_number,
    material_type, anchors), records that were checked by hand. Such a record
    counts if its anchors are on the first page and its class is that of the
    path; documents in unsorted folders need one. Unclassified documents have
    null class, subject and chapter.
    """
    parts = F.col("_parts")
    rows = docs.withColumn("_parts", context_parts(F.col("path"), root))
    rows = rows.withColumn("_class", infer_class(parts))
    if reviewed is None:
        reviewed = docs.sparkSession.createDataFrame([], "path string, class_name string, subject string, chapter string, chapter_number string, material_type string, anchors array<string>")
    record = reviewed.select(F.col("path").alias("_key"), F.struct("class_name", "subject", "chapter", "chapter_number", "material_type", "anchors").alias("_r"))
    rows = rows.join(record, F.array_join("_parts", "/") == F.col("_key"), "left")
    page = F.coalesce("first_page", F.lit(""))
    valid = F.coalesce(rules.all_anchors(text.norm(page), F.col("_r.anchors")) & (F.col("_class") == F.col("_r.class_name")), F.lit(False))
    rows = rows.withColumn("_ok", valid)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    pick = lambda name, inferred: F.when(F.col("_ok"), F.col(f"_r.{name}")).when(~is_unsorted(parts), inferred)
    rows = rows.withColumns({
        "class_name": pick("class_name", F.col("_class")),
        "subject": pick("subject", infer_subject(parts, F.col("_class"))),
        "chapter": pick("chapter", text.chapter_name(chapter_part(parts))),
        "chapter_number": pick("chapter_number", text.chapter_number(chapter_part(parts))),
        "material_type": pick("material_type", rules.material_type(stem)),
        "duration": text.duration(page),
        "max_marks": text.max_marks(page),
        "exclusion": rules.exclusion_reason(F.slice(parts, F.lit(1), F.size(parts) - 1), stem),
    })
    known = F.col("class_name").isNotNull() & F.col("subject").isNotNull()
    rows = rows.withColumn("classified", known)
    rows = rows.withColumns({c: F.when(known, F.col(c)) for c in ("class_name", "subject", "chapter", "chapter_number", "material_type")})
    kind = rules.document_type(F.col("material_type"))
    rows = rows.withColumn("document_type", F.when(known, kind))
    return rows.withColumn("confidence", F.when(known, rules.type_confidence(F.col("document_type"), page))).drop("_parts", "_class", "_key", "_r", "_ok")


def run_filters(docs: DataFrame, class_name: str = "", subject: str = "", chapter: str = "", material: str = "") -> DataFrame:
    """An empty filter lets everything pass. Class: equal; subject: equal in
    lower case; chapter and material: contained in lower case."""
    keep = F.lit(True)
    if class_name:
        keep &= F.col("class_name") == class_name
    if subject:
        keep &= F.lower("subject") == subject.lower()
    if chapter:
        keep &= F.contains(F.lower("chapter"), F.lit(chapter.lower()))
    if material:
        keep &= F.contains(F.lower("material_type"), F.lit(material.lower()))
    return docs.filter(keep)
