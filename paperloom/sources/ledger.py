"""A keyed table with several writers at once.

Versions are numbered manifests; each lists the parts of the table, in order,
of which a later one replaces an earlier one's rows of the same keys. A writer
writes its changed rows first, then creates the next manifest, which succeeds
only if no other has. If one has, the writer reads it, puts its own part
behind, and tries again; parts are never written twice. Readers take the last
manifest there is, and never see half a change.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a version beyond which compact() is due.
MANY_PARTS = 16


class Ledger:
    """spark, the table's folder, its key column, and its schema (DDL)."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str):
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._files = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._files.mkdirs(self._path("versions"))

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._path("versions"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def parts(self, version: int) -> list[str]:
        if not version:
            return []
        text = self.spark.read.text(str(self._path(f"versions/{version:012d}.json")), wholetext=True).first()[0]
        return json.loads(text)["parts"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        return self._rows(self.parts(self.version() if version is None else version))

    def _rows(self, parts: list[str]) -> DataFrame:
        one = lambda i, p: self.spark.read.schema(self.schema).parquet(str(self._path(f"parts/{p}"))).withColumn("_part", F.lit(i))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, [one(i, p) for i, p in enumerate(parts)])
        if len(parts) == 1:
            return rows.drop("_part")
        names = [c for c in rows.columns if c != "_part"]
        return rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*names), "_part").alias("r")).select("r.*")

    def _created(self, version: int, parts: list[str]) -> bool:
        """Whether this call made the manifest, and not another writer."""
        aside = self._path(f"versions/.{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
        out.close()
        target = self._path(f"versions/{version:012d}.json")
        try:
            if self._files.getScheme() == "file":  # a local rename would replace; a link does not
                os.link(aside.toUri().getPath(), target.toUri().getPath())
                return True
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri())
            none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(aside, target, none)
            return True
        except FileExistsError:
            return False
        except Exception:
            if self._files.exists(target):
                return False
            raise
        finally:
            self._files.delete(aside, False)

    def _part(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(str(self._path(f"parts/{name}")))
        return name

    def commit(self, changes: DataFrame, between: Callable[[], None] = lambda: None) -> int:
        """Puts rows, one for each key, in place of those of the same keys; all
        other keys stay as the last version has them, whoever wrote it. between
        is called before each try. Returns the number of the new version."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        part = self._part(changes.select(*names))
        while True:
            now = self.version()
            parts = self.parts(now)
            between()
            if self._created(now + 1, [*parts, part]):
                return now + 1

    def compact(self) -> int:
        """One part in place of those of the last version; parts that others put
        behind them in the meantime stay behind."""
        whole = self.parts(self.version())
        part = self._part(self._rows(whole))
        while True:
            now = self.version()
            parts = self.parts(now)
            if parts[: len(whole)] != whole:
                return now  # another compaction was first
            if self._created(now + 1, [part, *parts[len(whole) :]]):
                return now + 1
