"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the
    context's checkpoint folder. Where neither is set, a temporary folder serves
    sessions that run on one machine; a cluster gets an error."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark._jsc.sc().getCheckpointDir().getOrElse(None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="paperloom-")
    return _own_dir


#: Settings that bound memory here. Batches that travel to Python hold whole
#: texts, so their bytes are bounded beside their rows; and the driver keeps the
#: text of every plan, in which a literal such as a rank map is printed whole.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.maxPlanStringLength": "100000"}


def bounded_memory(spark: SparkSession) -> None:
    """Sets BOUNDS in a session that has no settings of its own for them."""
    known = spark._jsparkSession.sessionState().conf()
    for key, most in BOUNDS.items():
        if not known.contains(key):
            spark.conf.set(key, most)


def release() -> None:
    """Gives back what collected tables held on the driver."""
    pa.default_memory_pool().release_unused()


class Table:
    """A DataFrame written to the shared folder: its lineage is cut, and lost
    executors lose nothing of it. Results are lazy, so a table that one of them
    reads cannot go before it; what is not dropped goes with the driver."""

    def __init__(self, df: DataFrame, label: str):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(self.path)
        files, path = self._place()
        files.deleteOnExit(path)
        self.df = spark.read.schema(schema).parquet(self.path)

    def _place(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def drop(self) -> None:
        """Deletes the files, once nothing reads them any more."""
        files, path = self._place()
        files.delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    return Table(df, label).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, and no other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0 (null ids count as empty text)."""
    digits = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(digits.cast("binary")) % 5 == 0
