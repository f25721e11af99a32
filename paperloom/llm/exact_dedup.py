"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks
of the corpus are sorted, and a block's name is its place in that order. Then
adjacent names are paired, the distinct pairs are sorted, and so on, until one
name is left for each document: equal names mean equal texts, never merely
equal hashes.

Blocks are sorted by a 64-bit hash first and by their bytes within it, which is
as good an order as any. So text crosses the network once, to find the distinct
blocks (copies inside a task are combined first, and travel once). From then on
a block is its hash; only blocks that share their hash with a different one are
told apart by their bytes, in joins of their own.

Places come from a range-partitioned sort: each partition numbers its keys, and
starts after the number of keys in the partitions before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Table, text_or_empty, written

BLOCK_BYTES = 16_384


def places(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys, distinct by their columns `order`, with name: their place from 0 in
    that order. The list of partitions is all that one task sorts."""
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    numbered = written(ranged.select("*", F.shiftrightunsigned(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "places")
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), "_part").withColumn("name", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")  # one row a partition


def _block_names(blocks: DataFrame, bucket: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """blocks: (block). Names of all distinct blocks, as (bucket, name) of those
    that are alone in their bucket and (bucket, block, name) of the others, or
    None where there are no others."""
    found = blocks.select(bucket(F.col("block")).alias("bucket"), "block").distinct()
    counted = Table(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "buckets").df
    crowded = counted.filter("n > 1").select("bucket")
    if crowded.isEmpty():
        return written(places(counted.select("bucket"), ["bucket"]), "names"), None
    several = found.join(crowded, "bucket", "left_semi").select("bucket", "block")
    keys = counted.filter("n = 1").select("bucket", F.lit(None).cast("binary").alias("block")).unionByName(several)
    named = written(places(keys, ["bucket", "block"]), "names")
    return named.filter("block IS NULL").select("bucket", "name"), named.filter("block IS NOT NULL")


def _gathered(at: DataFrame, single: Column) -> DataFrame:
    """at: (rid, pos, name). (rid, names), the names of a row in their order;
    rows that have a single one need no gathering."""
    alone = at.filter(single).select("rid", F.array("name").alias("names"))
    several = at.filter(~single).groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return alone.unionByName(several)


def _pairs() -> Column:
    """Adjacent names; a last one without a partner is paired with -1."""
    last = (F.size("names") - 1).cast("int")
    pair = lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1).cast("bigint")).alias("b"))
    return F.transform(F.sequence(F.lit(0), F.floor(last / 2).cast("int")), pair)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    bucket: Callable[[Column], Column] = F.xxhash64,
    row_col: str | None = None,
) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept,
    text_sha256.

    Null text counts as empty; empty texts form a group of their own. Of equal
    texts the row with the largest id stays (null ids lose). Repeated rows of
    the same id and text: exactly one is kept. An empty table gives an empty
    result; other columns of docs are ignored, whatever their names. Texts of
    any length are named block by block. bucket: the hash that blocks are sorted
    by first; any function gives the same groups, a poor one only costs joins.
    row_col names a unique, written number of each row, which is then returned
    as well.
    """
    raw = text_or_empty(text_col).cast("binary")
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).alias("doc_id"), raw.alias("raw"))
    last = F.greatest(F.lit(0), F.floor((F.octet_length("raw") - 1) / block_bytes)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    cut = rows.withColumn("blocks", blocks)
    alone, others = _block_names(cut.select(F.explode("blocks").alias("block")), bucket)
    if others is not None:
        cut = Table(cut, "cut").df  # read twice below, with the same row numbers
    listed = Table(cut.select("rid", "doc_id", F.sha2("raw", 256).alias("text_sha256"), F.transform("blocks", lambda b: bucket(b)).alias("buckets")), "rows").df
    at = listed.select("rid", F.size("buckets").alias("n"), F.posexplode("buckets").alias("pos", "bucket"))
    found = at.join(alone, "bucket").select("rid", "pos", "n", "name")
    if others is not None:
        whole = cut.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")).withColumn("bucket", bucket(F.col("block")))
        found = found.unionByName(whole.join(others, ["bucket", "block"]).select("rid", "pos", "n", "name"))
    named = Table(_gathered(found, F.col("n") == 1), "named").df
    # a row's names halve in every round; rows of one name are done
    sizes = listed.agg(F.max(F.size("buckets"))).first()[0] or 1
    rounds = F.lit(0)
    done = named.filter(F.size("names") == 1).select("rid", rounds.alias("round"), F.col("names")[0].alias("name"))
    more, k = named.filter(F.size("names") > 1), 0
    while sizes > 1:
        sizes, k = -(-sizes // 2), k + 1
        paired = Table(more.select("rid", F.size("names").alias("n"), F.posexplode(_pairs()).alias("pos", "pair")).select("rid", "n", "pos", "pair.a", "pair.b"), "pairs").df
        names = written(places(paired.select("a", "b").distinct(), ["a", "b"]), "names")
        at = paired.join(names, ["a", "b"]).select("rid", "pos", "n", "name")
        named = Table(_gathered(at, F.col("n") <= 2), "named").df
        done = done.unionByName(named.filter(F.size("names") == 1).select("rid", F.lit(k).alias("round"), F.col("names")[0].alias("name")))
        more = named.filter(F.size("names") > 1)
    # names compare within a round: equal texts have equally many blocks
    rows = Table(listed.select("rid", "doc_id", "text_sha256").join(done, "rid"), "identities").df
    groups = rows.groupBy("round", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # written first, so that the join stands on two exchanges and a large group may be split
    return rows.join(written(groups, "groups"), ["round", "name"]).select(
        *([F.col("rid").alias(row_col)] if row_col else []),
        F.col("doc_id").alias(id_col),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
    )
