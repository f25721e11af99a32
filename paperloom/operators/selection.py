"""Representative documents and pages to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import numbered

LEAST_CONFIDENCE = 0.82
BUDGET = 8


def layout_flags(c=F.col) -> Column:
    """Flags of a page from n_words, image_coverage, n_images, n_body_images,
    hlines, vlines, shapes and n_drawings (0 where images cover 0.9 and more)."""
    flag = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_compact(F.array(
        flag(c("n_images") > 0, "raster_images"),
        flag((c("n_words") < 12) & (c("image_coverage") > 0.65), "image_only"),
        flag(c("n_words") >= 450, "dense_text"),
        flag((c("hlines") >= 6) & (c("vlines") >= 6), "tables"),
        flag(((c("n_body_images") > 0) & (c("image_coverage") < 0.85)) | (c("shapes") >= 10), "diagrams"),
        flag((c("n_words") == 0) & (c("n_images") == 0) & (c("n_drawings") == 0), "blank"),
    ))


def coverage_keys(docs: DataFrame) -> DataFrame:
    """(source_id, key) of what a document stands for."""
    c = F.col
    text = lambda x: F.coalesce(c(x), F.lit("None"))
    keys = F.concat(
        F.array(
            F.concat(F.lit("class:"), text("class_name")),
            F.concat(F.lit("subject:"), text("subject")),
            F.concat(F.lit("family:"), c("family")),
            F.concat(F.lit("material:"), text("material_type")),
            F.concat(F.lit("class_subject:"), text("class_name"), F.lit("/"), text("subject")),
        ),
        F.transform("layout_flags", lambda f: F.concat(F.lit("layout:"), f)),
    )
    return docs.select("source_id", F.explode(F.array_distinct(keys)).alias("key"))


def set_cover(keys: DataFrame, pages: DataFrame, most: int = 0, most_local: int = 100_000) -> DataFrame:
    """keys: (source_id, key); pages: (source_id, page_count) -> (step,
    source_id, covers): again and again the document that covers most keys not
    yet covered, the shorter and then the lower id of equals.

    Of documents with the same keys only the shortest can ever be picked, so
    the candidates are the different key sets: few, as keys are classes,
    subjects and flags. Up to most_local of them come to the driver; beyond
    that each step is an aggregation of its own."""
    spark = keys.sparkSession
    kind = dict(keys.dtypes)["source_id"]
    sets = keys.groupBy("source_id").agg(F.sort_array(F.collect_set("key")).alias("keys")).join(pages, "source_id")
    sets = sets.groupBy("keys").agg(F.min(F.struct("page_count", "source_id")).alias("best")).select("keys", "best.page_count", "best.source_id")
    picked: list[tuple[int, object, list[str]]] = []
    done: set[str] = set()
    local = sets.limit(most_local + 1).collect()
    if len(local) <= most_local:
        open_sets = {(r["page_count"], r["source_id"]): set(r["keys"]) for r in local}
        while open_sets and (not most or len(picked) < most):
            best = min(open_sets, key=lambda x: (-len(open_sets[x] - done), x))
            covers = open_sets.pop(best) - done
            if not covers:
                break
            done |= covers
            picked.append((len(picked), best[1], sorted(covers)))
    else:
        while not most or len(picked) < most:
            left = sets.withColumn("keys", F.array_except("keys", F.lit(sorted(done)) if done else F.array().cast("array<string>")))
            best = left.agg(F.min_by(F.struct("source_id", "keys"), F.struct(-F.size("keys"), "page_count", "source_id")).alias("b")).first()["b"]
            if best is None or not best["keys"]:
                break
            done |= set(best["keys"])
            picked.append((len(picked), best["source_id"], sorted(best["keys"])))
    return spark.createDataFrame(picked, f"step int, source_id {kind}, covers array<string>")


def review_pages(pages: DataFrame, issues: DataFrame, budget: int = BUDGET) -> DataFrame:
    """pages: (doc, page from 0, confidence, strategy, page_type); issues: (doc,
    page) -> (doc, page) to look at.

    Low confidence and issues always; the first two pages; then, within the
    budget, the first page of each (strategy, type) not yet among them; then
    evenly spaced pages if the budget is still open. Pages of new kinds are
    taken in order, so the sequential rule is a rank."""
    doc = Window.partitionBy("doc")
    rows = pages.join(issues.select("doc", "page").distinct().withColumn("_issue", F.lit(True)), ["doc", "page"], "left")
    first = (F.col("confidence") < LEAST_CONFIDENCE) | F.col("_issue").isNotNull() | (F.col("page") <= 1)
    rows = rows.withColumn("_must", F.coalesce(first, F.col("page") <= 1))
    kind = Window.partitionBy("doc", "strategy", "page_type")
    rows = rows.withColumn("_seen", F.max(F.col("_must").cast("int")).over(kind) == 1).withColumn("_new", ~F.col("_seen") & (F.col("page") == F.min("page").over(kind)))
    rows = rows.withColumn("_n", F.sum(F.col("_must").cast("int")).over(doc)).withColumn("_pages", F.count(F.lit(1)).over(doc))
    nth = F.sum(F.col("_new").cast("int")).over(doc.orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_take", F.col("_must") | (F.col("_new") & (nth + F.col("_n") <= budget)))
    taken = F.sum(F.col("_take").cast("int")).over(doc)
    slots = F.transform(F.sequence(F.lit(0), F.lit(max(1, budget) - 1)), lambda s: F.bround(s * (F.col("_pages") - 1) / F.lit(float(max(1, budget - 1)))).cast("long"))
    return rows.withColumn("_taken", taken).filter(F.col("_take") | ((F.col("_taken") < budget) & F.array_contains(slots, F.col("page").cast("long")))).select("doc", "page")


def first_paths(files: DataFrame, limit: int = 0) -> DataFrame:
    """(nth, path, ...): files in the order of their paths' parts, the first
    `limit` of them (0: all). The limit comes after whatever filters files went
    through."""
    order = F.split(F.col("path"), "/")
    if not limit:
        return numbered(files, [order], "nth").select("nth", *files.columns)
    ordered = files.orderBy(order).limit(limit)
    return ordered.select(F.row_number().over(Window.orderBy(order)).cast("long").alias("nth"), "*")


def zero_filled(df: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of df for every pair of two small lists of keys, 0 where there are
    none. Both lists are distinct values of a dimension."""
    a, b = left.columns[0], right.columns[0]
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    lists = right.agg(F.collect_set(b).alias("_all"))
    grid = left.distinct().join(lists, F.lit(True)).select(a, F.explode("_all").alias(b))  # one row on the right
    return grid.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))
