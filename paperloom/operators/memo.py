"""Work that is kept as long as what it depends on stays the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _together(*tables: DataFrame) -> DataFrame:
    """Rows of several tables, each null where it has no such column, dealt by
    document once: what belongs to an object or a page then meets where it lies."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.repartition("doc")


def _named(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows that an object finds by its name; a null is no name."""
    return rows.filter(F.col("doc").isNotNull() & F.col("object").isNotNull()).select("doc", "object", *columns)


def _signature() -> Column:
    """A digest of the set of (object, state) of a group's rows that are used."""
    part = F.sha2(F.concat_ws("\x1f", F.col("object").cast("string"), F.coalesce("state", F.lit("\x1e"))), 256)
    return F.sha2(F.array_join(F.array_sort(F.collect_set(F.when(F.col("used"), part))), ""), 256)


def _bytes(signature: Column) -> Column:
    """The bytes of a digest, half of what its digits are; null of what is none."""
    return F.when(signature.rlike("^[0-9a-f]{64}$"), F.unhex(signature))


def page_signatures(uses: DataFrame, states: DataFrame) -> DataFrame:
    """uses: (doc, page, object); states: (doc, object, state), one a name.
    (doc, page, signature): a digest of the set of (object, state) that a page
    depends on, whatever their order, and however often one is used. An object
    without a state is part of it, too. A page holds few objects, and each is
    one digest."""
    rows = _together(uses.select("doc", "page", "object", F.lit(True).alias("used")), _named(states, "state"))
    known = rows.withColumn("state", F.max("state").over(Window.partitionBy("doc", "object"))).filter("used")
    return known.groupBy("doc", "page").agg(_signature().alias("signature"))


def refreshed_digests(images: DataFrame, states: DataFrame, memo: DataFrame, decode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """images: (doc, object); states: see page_signatures; memo: (doc, object,
    state, digest); decode adds digest to (doc, object, state). (doc, object,
    state, digest, decoded): every image once, decoded only if its state is not
    the one remembered."""
    old = _named(memo.filter("state IS NOT NULL"), F.struct("state", "digest").alias("old"))
    rows = _together(_named(images, F.lit(True).alias("shown")), _named(states, "state", F.lit(True).alias("told")), old)
    now = rows.groupBy("doc", "object").agg(F.max("shown").alias("shown"), F.max("told").alias("told"), F.max("state").alias("state"), F.collect_set("old").alias("old")).filter("shown AND told")
    found = now.withColumn("same", F.filter("old", lambda o: o["state"] == F.col("state")))
    at = ["doc", "object", "state"]
    kept = found.filter("size(same) > 0").select(*at, F.col("same")[0]["digest"].alias("digest"), F.lit(False).alias("decoded"))
    return kept.unionByName(decode(found.filter("size(same) = 0").select(*at)).select(*at, "digest").withColumn("decoded", F.lit(True)))


def refreshed_pages(uses: DataFrame, states: DataFrame, memo: DataFrame, digests: DataFrame) -> DataFrame:
    """memo: (doc, page, signature, digests). (doc, page, signature, digests,
    reused): pages whose signature is the one remembered keep their result; all
    others, those that use a changed object among them, get the digests of
    their images anew. uses, states: see page_signatures.

    All four tables are dealt by document once; nothing is shuffled after that."""
    c, object = F.col, Window.partitionBy("doc", "object")
    old = memo.filter("doc IS NOT NULL AND page IS NOT NULL").select("doc", "page", F.struct(_bytes(F.col("signature")).alias("signature"), "digests").alias("old"))
    rows = _together(uses.select("doc", "page", "object", F.lit(True).alias("used")), _named(states, "state"), _named(digests, "digest"), old)
    told = rows.withColumns({"state": F.max("state").over(object), "digest": F.max("digest").over(object)}).filter("used OR old IS NOT NULL")
    pages = told.groupBy("doc", "page").agg(
        F.max("used").alias("used"), F.collect_set("old").alias("old"), F.array_sort(F.collect_set(F.when(c("used"), c("digest")))).alias("anew"),
        _signature().alias("signature"),
    ).filter("used")
    same = F.filter("old", lambda o: o["signature"] == _bytes(c("signature")))
    found = pages.withColumn("same", same)
    reused = F.size("same") > 0
    return found.select("doc", "page", "signature", F.when(reused, c("same")[0]["digests"]).otherwise(c("anew")).alias("digests"), reused.alias("reused"))
