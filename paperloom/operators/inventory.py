"""An inventory that is kept up to date by what changed."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterable
from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Written

#: What of an entry says that its file has not changed.
STAMP = ("size", "mtime_ns")


def code_signature(modules: Iterable[ModuleType]) -> str:
    """A digest of the source of what classifies; entries made by other code are
    made again."""
    return hashlib.sha256("\x1f".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def summary_of(entries: DataFrame) -> DataFrame:
    """entries: (status, family, class_name, subject, flags, ...). (kind, key,
    n): documents, statuses, and, of classified ones, families and class/subject;
    layout flags of all."""
    return _counted(entries, F.lit(1))


def _counted(entries: DataFrame, weight: Column) -> DataFrame:
    done = F.col("status") == "classified"
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.array(
        pair("documents", F.lit("")),
        pair("status", F.col("status")),
        pair("family", F.when(done, F.col("family"))),
        pair("class_subject", F.when(done, F.concat_ws("/", "class_name", "subject"))),
    )
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.struct(F.lit("layout_flag").alias("kind"), f.alias("key")))
    each = entries.select(F.inline(F.concat(keys, flags)), weight.cast("long").alias("w")).filter("key IS NOT NULL")
    return each.groupBy("kind", "key").agg(F.sum("w").alias("n")).filter("n <> 0")


class Inventory:
    """entries: (path, size, mtime_ns, status, family, class_name, subject,
    flags); summary: (kind, key, n); signature: of the code that made them."""

    def __init__(self, entries: DataFrame, summary: DataFrame, signature: str):
        self.entries, self.summary, self.signature = entries, summary, signature


def built(files: DataFrame, classify: Callable[[DataFrame], DataFrame], signature: str) -> Inventory:
    entries = Written(classify(files), "entries").df
    return Inventory(entries, summary_of(entries), signature)


def refreshed(previous: Inventory, files: DataFrame, classify: Callable[[DataFrame], DataFrame], signature: str) -> Inventory:
    """files: (path, size, mtime_ns, ...) as they are now; classify turns such
    rows into entries. Only files that are new, or whose size or time changed,
    are classified, or all if the code did. The summary is not counted again: the
    rows that went are taken from it and those that came added, so its work grows
    with the change."""
    if previous.signature != signature:
        return built(files, classify, signature)
    at = ["path", *STAMP]
    known = previous.entries
    kept = known.join(files.select(*at), at, "left_semi")
    made = Written(classify(files.join(known.select(*at), at, "left_anti")), "misses").df
    gone = known.join(files.select(*at), at, "left_anti")
    changes = _counted(gone, F.lit(-1)).unionByName(_counted(made, F.lit(1)))
    summary = previous.summary.unionByName(changes).groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n <> 0")
    return Inventory(kept.unionByName(made), summary, signature)
