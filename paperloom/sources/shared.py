"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither
    is set, a temporary folder serves sessions on one machine; a cluster gets an
    error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="paperloom-"))
    return _own[0]


class Written:
    """A table whose lineage is cut; it goes with the driver if nothing drops it
    before."""

    def __init__(self, df: DataFrame, name: str):
        spark, schema = df.sparkSession, df.schema
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{name}-{uuid.uuid4().hex}")
        df.write.parquet(place.toString())
        self._files, self._place = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place
        self._files.deleteOnExit(place)
        self.df = spark.read.schema(schema).parquet(place.toString())

    def drop(self) -> None:
        self._files.delete(self._place, True)
