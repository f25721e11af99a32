"""Recursive scans of document libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of unfinished and rejected outputs.
LEFT_OUT = (".tmp.pdf", ".qa_failed.pdf")


def in_path_order() -> Column:
    """Paths order by their parts, not by their characters."""
    return F.split(F.col("path"), "/")


def discover(spark: SparkSession, root: str, output_root: str | None = None, content: bool = False, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path below root, length, modified[, sha256]) of all documents below a
    root, without an output tree inside it. Content is read, and hashed where it
    lies, only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    absolute = F.regexp_replace("path", "^file:/*", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    name = F.lower(F.element_at(F.split(absolute, "/"), -1))
    keep = F.lit(True)
    for end in LEFT_OUT:
        keep &= ~F.endswith(name, F.lit(end))
    if output_root:
        keep &= ~F.startswith(absolute, F.lit(output_root.removeprefix("file://").rstrip("/") + "/"))
    columns = [F.substring(absolute, F.lit(len(base) + 1), F.length(absolute)).alias("path"), F.col("length"), F.col("modificationTime").alias("modified")]
    if content:
        columns.append(F.sha2("content", 256).alias("sha256"))
    return files.filter(keep).select(*columns)
