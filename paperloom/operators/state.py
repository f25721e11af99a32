"""Caches, job journals and comparisons of runs, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Statuses of a job, and the steps between them. A job that ended may be started again.
STATUSES = ("discovered", "pending", "running", "analyzed", "completed", "cached", "excluded", "unclassified", "qa_failed", "failed", "cancelled", "interrupted")
STEPS = {
    None: STATUSES,
    "discovered": ("pending", "excluded", "unclassified", "cached", "cancelled"),
    "pending": ("running", "cached", "cancelled", "interrupted"),
    "running": ("running", "analyzed", "completed", "qa_failed", "failed", "cancelled", "interrupted"),
    "analyzed": ("running", "completed", "qa_failed", "failed", "cancelled", "interrupted"),
}
RETRIED = ("failed", "qa_failed", "cancelled", "interrupted")
FAILED = ("failed", "qa_failed")


def fresh(sources: DataFrame, cache: DataFrame, profile_hash: str, engine_version: str) -> DataFrame:
    """sources: (key, size, mtime, sha, output_sha, pending) with what is there
    now. Adds is_fresh: the cache has the key with the same profile, engine,
    size, time and both hashes, a passed check, and no publication is pending."""
    cached = cache.select(F.lower("key").alias("key"), *[F.col(c).alias(f"c_{c}") for c in ("profile_hash", "engine_version", "size", "mtime", "sha", "output_sha", "qa_passed")])
    joined = sources.withColumn("_key", F.lower("key")).join(cached.withColumnRenamed("key", "_key"), "_key", "left")
    same = (F.col("c_profile_hash") == profile_hash) & (F.col("c_engine_version") == engine_version)
    for c in ("size", "mtime", "sha", "output_sha"):
        same &= F.col(f"c_{c}") == F.col(c)
    ok = F.coalesce(same & F.col("c_qa_passed") & ~F.col("pending"), F.lit(False))
    return joined.withColumn("is_fresh", ok).drop("_key", *[c for c in joined.columns if c.startswith("c_")])


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row of each key of both; equal versions go to the changes."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    whole = F.struct(*[F.col(c) for c in table.columns])
    return both.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(version, "_new")).alias("r")).select("r.*")


def current_state(events: DataFrame, key: str, sequence: Sequence[str], merged: Sequence[str], attempt: Column) -> DataFrame:
    """Job state from an append-only log: the last non-null value of each merged
    column, and how often attempt held. Combines before the shuffle."""
    order = F.struct(*sequence)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in merged]
    return events.groupBy(key).agg(*latest, F.count_if(attempt).alias("attempts"), F.max(order).alias("last"))


def kept_state(events: DataFrame, key: str, sequence: Sequence[str], merged: Sequence[str], attempt: Column) -> DataFrame:
    """current_state with what a later fold needs: beside each merged column,
    as _at_<column>, where in the log its value was."""
    order = F.struct(*sequence)
    where = [F.max(F.when(F.col(c).isNotNull(), order)).alias(f"_at_{c}") for c in merged]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in merged]
    return events.groupBy(key).agg(*latest, *where, F.count_if(attempt).alias("attempts"), F.max(order).alias("last"))


def folded(state: DataFrame, more: DataFrame, key: str, merged: Sequence[str]) -> DataFrame:
    """Two kept states of separate parts of a log as one, whatever their order."""
    both = state.unionByName(more)
    latest = [F.max_by(c, f"_at_{c}").alias(c) for c in merged]
    return both.groupBy(key).agg(*latest, *[F.max(f"_at_{c}").alias(f"_at_{c}") for c in merged], F.sum("attempts").alias("attempts"), F.max("last").alias("last"))


def recovered(jobs: DataFrame) -> DataFrame:
    """After a crash, whatever was running is interrupted."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def to_retry(sources: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    return sources.join(jobs.filter(F.col("status").isin(*RETRIED)).select(key), key, "left_semi")


def wrong_steps(events: DataFrame, key: str, sequence: Sequence[str]) -> DataFrame:
    """Events whose status is unknown or cannot follow the one before. A window
    over one job's events, which are as many as its attempts."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*sequence))
    ended = ("pending", "running", "discovered", "cached", "excluded", "unclassified")
    allowed = lambda was: F.array(*[F.lit(x) for x in was])
    steps = F.when(F.col("before").isNull(), allowed(STEPS[None]))
    for was, then in STEPS.items():
        if was:
            steps = steps.when(F.col("before") == was, allowed(then))
    fine = F.array_contains(steps.otherwise(allowed(ended)), F.col("status"))
    return events.withColumn("before", before).filter(~F.coalesce(fine, F.lit(False)))


def after_retries(attempts: DataFrame, key: str, retries: int) -> DataFrame:
    """attempts: (key, attempt from 0, status) -> (key, attempts, status, again).
    Only `failed` is tried again, `retries` times at most; a failed audit never
    is. What was logged beyond the attempt that ended a job does not count."""
    inside = attempts.filter(F.col("attempt") <= retries)
    ends = F.when(F.col("status") != "failed", F.col("attempt"))
    told = inside.groupBy(key).agg(F.min(ends).alias("_end"), F.min_by("status", ends).alias("_status"), F.max("attempt").alias("_last"))
    made = F.coalesce("_end", "_last") + 1
    again = F.col("_end").isNull() & (F.col("_last") < retries)
    return told.select(key, made.cast("long").alias("attempts"), F.coalesce("_status", F.lit("failed")).alias("status"), again.alias("again"))


def matrix_status(fixtures: DataFrame, before: DataFrame, after: DataFrame, results: DataFrame) -> DataFrame:
    """fixtures, before and after: (source_id, sha256); results: (source_id,
    status). (source_id, status, preserved): source_changed if the bytes are not
    the fixture's, source_modified if the run changed them."""
    hashed = lambda df, name: df.select("source_id", F.col("sha256").alias(name))
    rows = hashed(fixtures, "_want").join(hashed(before, "_before"), "source_id", "left").join(hashed(after, "_after"), "source_id", "left").join(results.select("source_id", F.col("status").alias("_status")), "source_id", "left")
    same = F.col("_before").eqNullSafe(F.col("_want"))
    kept = F.col("_after").eqNullSafe(F.col("_before"))
    status = F.when(~same, "source_changed").when(~kept, "source_modified").otherwise(F.col("_status"))
    return rows.select("source_id", status.alias("status"), F.when(same, kept).alias("preserved"))


def matrix_passed(records: DataFrame) -> DataFrame:
    done = F.coalesce(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))), F.lit(False))
    return records.agg(done.alias("passed"), F.count(F.lit(1)).alias("n"))


def snapshot(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def exit_code(jobs: DataFrame, cancelled: bool = False) -> DataFrame:
    failed = F.coalesce(F.bool_or(F.col("status").isin(*FAILED)), F.lit(False))
    return jobs.agg(F.when(F.lit(cancelled), 130).when(failed, 2).otherwise(0).alias("exit_code"))


def same_root(runs: DataFrame, root: str) -> DataFrame:
    """The journal's last run, or an error if that was over another input."""
    last = runs.agg(F.max_by("input_root", "started_at").alias("input_root"))
    other = F.col("input_root").isNotNull() & (F.col("input_root") != root)
    return last.select(F.when(other, F.raise_error(F.lit("journal belongs to another input")).cast("string")).otherwise(F.col("input_root")).alias("input_root"))


def inventory_reuse(files: DataFrame, previous: DataFrame, root: str, schema_version: int, signature: str) -> DataFrame:
    """files: (path, size, mtime_ns). Adds reused and the earlier row's columns
    where root, schema and classifier are the same and size and time have not
    changed; the other rows are to be computed."""
    kept = previous.filter((F.col("root") == root) & (F.col("schema_version") == schema_version) & (F.col("signature") == signature)).drop("root", "schema_version", "signature")
    renamed = kept.withColumnsRenamed({"size": "_size", "mtime_ns": "_mtime"})
    joined = files.join(renamed, "path", "left")
    same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")), F.lit(False))
    values = [c for c in renamed.columns if c not in ("path", "_size", "_mtime")]
    return joined.withColumn("reused", same).withColumns({c: F.when(same, F.col(c)) for c in values}).drop("_size", "_mtime")


def compare_runs(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison: same, changed, missing (in the candidate) or added."""
    a = baseline.select(*keys, F.col(value).alias("before"))
    b = candidate.select(*keys, F.col(value).alias("after"))
    joined = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), list(keys), "full_outer")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return joined.withColumn("state", state).drop("_a", "_b")


def recommend_workers(runs: DataFrame, available: Column) -> DataFrame:
    """runs: (workers, elapsed, peak, ok). Of the runs that were right and took
    at most half of the available memory, the fewest workers within a tenth of
    the fastest; 1 if there are none."""
    fits = runs.withColumn("_limit", available / 2).filter(F.col("ok") & (F.col("peak") <= F.col("_limit")))
    fastest = fits.agg(F.min("elapsed").alias("_fastest"))
    close = fits.join(F.broadcast(fastest), F.col("elapsed") <= F.col("_fastest") * 1.1)  # one row
    return close.agg(F.coalesce(F.min("workers"), F.lit(1)).alias("workers"))
