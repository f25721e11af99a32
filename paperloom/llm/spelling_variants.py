"""Spelling variant grouping by pairless wildcard groups.

Two words that differ by one replaced letter share exactly one wildcard group:
the position of the letter, what is before it and what is after it. A group
keeps its size and its two most frequent words; each member then knows how many
others there are and which of them is the most frequent, without meeting them.
Words that differ by one letter more or less are found by joining the words
with one letter deleted to the vocabulary.

A group has one member for each letter that stands at its position, so none is
larger than the alphabet; no pair of two members is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Table, ascii_lower

LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5
EVERY = 199  # of the runs that lose a letter


def _without(word: Column, at: Column) -> Column:
    """A word without its code point `at`, counted from 0."""
    return F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the words of at least least_chars code points with at least
    least_count occurrences in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower
    case. Where the crc32 of '<id>:<run>' is divisible by `every`, the run loses
    the code point that the crc32 points at. Null texts have no words; a null id
    counts as an empty one. Counts combine before their shuffle.
    """
    # shorter runs cannot give a word, so they are not taken out of the text
    runs = F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{max(1, least_chars)},}}"), F.lit(0))
    of_doc = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lower = of_doc.select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    words = hashed.select(F.when(F.col("h") % every == 0, _without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _replaced(words: DataFrame) -> DataFrame:
    """(word, count, best) for each wildcard group that a word shares with
    others: how many, and (-n, word) of the most frequent of them."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")).select(
        "word", "n", "at", F.col("word").substr(F.lit(1), F.col("at") - 1).alias("prefix"), F.col("word").substr(F.col("at") + 1, F.length("word")).alias("suffix")
    )
    group = Window.partitionBy("at", "prefix", "suffix")
    ranked = group.orderBy(F.desc("n"), "word")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine = F.struct((-F.col("n")).alias("neg"), F.col("word").alias("other"))
    kept = at.select("word", F.row_number().over(ranked).alias("place"), F.count(F.lit(1)).over(whole).alias("size"), F.first(mine).over(whole).alias("first"), F.nth_value(mine, 2).over(whole).alias("second"))
    return kept.filter("size > 1").select("word", (F.col("size") - 1).alias("count"), F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("first")).alias("best"))


def _shorter(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): `other` is in the vocabulary and is `word`
    without one of its letters."""
    cut = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: _without(F.col("word"), i)))
    cuts = words.filter(F.length("word") > 0).select("word", "n", F.explode(cut).alias("other"))
    return cuts.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(links: DataFrame) -> DataFrame:
    """links: (word, root), the next word of each, without cycles. The same with
    the last word of each; ways double in every round."""
    now = Table(links, "links")
    while True:
        after = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = Table(now.df.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        now.drop()
        now = moved
        if now.df.filter("moved").isEmpty():
            return now.df.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row for each row of words (word, n): word, n, n_near, form, form_n, root.

    Words are near if they differ by exactly one inserted, deleted or replaced
    code point; n_near counts them. form is the near word of the largest n (ties
    to the smallest in code-point order), if that n is at least ratio times the
    word's, ratio being 2 or more; else null. root is the last word of the forms,
    the word itself if it has none.

    Words have to be distinct; null words are left out. Words of any length and
    any letters are compared whole; the empty word is near to those of one
    letter. An empty table gives an empty result; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("forms lead to a last word only if each is more frequent than the one before")
    kept = Table(words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL"), "words").df
    cuts = Table(_shorter(kept), "cuts").df
    one = F.lit(1).cast("long").alias("count")
    down = cuts.select("word", one, F.struct((-F.col("other_n")).alias("neg"), "other").alias("best"))
    up = cuts.select(F.col("other").alias("word"), one, F.struct((-F.col("n")).alias("neg"), F.col("word").alias("other")).alias("best"))
    found = _replaced(kept.filter(F.length("word") > 0)).unionByName(down).unionByName(up)
    near = found.groupBy("word").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))
    best_n = -F.col("best.neg")
    enough = best_n >= F.col("n") * ratio
    formed = kept.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, best_n).alias("form_n"))
    formed = Table(formed, "forms").df
    last = roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
