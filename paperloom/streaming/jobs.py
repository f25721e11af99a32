"""Job states from a stream of events: the batch fold, kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import folded, kept_state
from ..sources.publish import batches, drop, publish


def state_updates(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """Latest status and number of attempts of each key, as the stream goes on.
    State is one row a key; it is kept, for a job may be retried any time."""
    latest = F.max_by(status, F.struct(at, "sequence")).alias(status)
    return events.groupBy(key).agg(latest, F.count_if(F.col(status) == "running").alias("attempts"))


def follow(events: DataFrame, journal: str, state: str, checkpoint: str, key: str, sequence: Sequence[str], merged: Sequence[str]) -> StreamingQuery:
    """Appends each batch to a journal, by batch number, and folds it into the
    last state, so a batch costs what it brings and the keys it finds, never the
    whole journal. States are kept by batch number too: a replay after a failure
    folds into the state before it, and replaces what it wrote. `state` is
    published anew after each batch."""
    running = F.col("status") == "running"
    kept = f"{state.rstrip('/')}.batches"

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{journal}/batch={epoch}")
        new = kept_state(spark.read.schema(df.schema).parquet(f"{journal}/batch={epoch}"), key, sequence, merged, running)
        done = [e for e in batches(spark, kept) if e < epoch]
        now = folded(spark.read.schema(new.schema).parquet(f"{kept}/batch={max(done)}"), new, key, merged) if done else new
        now.write.mode("overwrite").parquet(f"{kept}/batch={epoch}")
        whole = spark.read.schema(new.schema).parquet(f"{kept}/batch={epoch}")
        publish(whole.drop(*[f"_at_{c}" for c in merged]), state)
        for old in done[:-1] if len(done) > 1 else []:
            drop(spark, f"{kept}/batch={old}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window; windows close once the watermark passes."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col(kind), "n")
