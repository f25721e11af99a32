"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most 4 of 64 bits are linked. Cut into 3
segments (fewer than the 5 that would force an equal one), such a pair has a
segment that differs in at most one bit. Each distinct fingerprint is indexed
under every segment as it is and with each of its bits as a wildcard.

A segment alone has few values, so buckets of unrelated fingerprints would grow
with the square of the corpus. The other bits tell them apart: if the segment is
equal, they hold at most 4 differences, and one of 5 pieces is equal; if it
differs in one bit, they hold at most 3, and one of 4 pieces is. A signature is
a segment variant with one such piece, over 30 bits. An equality join finds
every linked pair, and the bits verify it.

Groups of near copies make full buckets. Chains come first: within a bucket
each fingerprint is compared with its neighbour and with the first. Pairs are
joined only between different components of those chains, and one link is kept
for two of them, so a large group does not emit its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import Table, bounded_memory, text_or_empty

SHINGLE_WORDS = 4
MOST_BITS = 4
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (lowest bit, bits)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \\x20\\x09-\\x0D only
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED) if found else 0
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    hashes = np.array([h(joined[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # very long texts in bounded memory
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "long")


def signature_masks(most_bits: int = MOST_BITS) -> list[int]:
    """The bits that each signature keeps of a fingerprint."""

    def pieces(bits: list[int], n: int) -> Iterator[int]:
        for i in range(n):
            yield sum(1 << b for b in bits[i * len(bits) // n : (i + 1) * len(bits) // n])

    out = []
    for low, n in SEGMENTS:
        segment = ((1 << n) - 1) << low
        rest = [b for b in range(64) if not segment >> b & 1]
        out += [segment | p for p in pieces(rest, most_bits + 1)]
        out += [segment & ~(1 << b) | p for b in range(low, low + n) for p in pieces(rest, max(1, most_bits))]
    return out


def signatures(fp: Column, most_bits: int = MOST_BITS) -> Column:
    """One long for each signature: a hash of its number and the bits it keeps.
    (Hashes that meet by chance only add pairs to verify.)"""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in signature_masks(most_bits)])
    return F.transform(masks, lambda m, i: F.xxhash64(i, fp.bitwiseAND(m)))


def near_links(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """prints: (fp), distinct. Returns links (u, v) whose components are those
    of all pairs that differ in at most most_bits (5 at most) bits."""
    if not 0 <= most_bits <= 5:
        raise ValueError("three segments find pairs of up to 5 differing bits")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= most_bits
    # 271 signatures each: their fingerprints, few and small, are dealt to all cores first
    cores = prints.sparkSession.sparkContext.defaultParallelism
    dealt = prints.repartition(max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * cores), "fp")
    sigs = dealt.select(F.explode(signatures(F.col("fp"), most_bits)).alias("sig"), "fp")
    bucket = Window.partitionBy("sig").orderBy("fp")
    chained = sigs.select("sig", "fp", F.lag("fp").over(bucket).alias("prev"), F.lead("fp").over(bucket).alias("next"), F.first("fp").over(bucket).alias("head"))
    full = Table(chained.filter(F.col("prev").isNotNull() | F.col("next").isNotNull()).drop("next"), "buckets").df
    chains = [full.filter(near(F.col("fp"), F.col(c)) & (F.col("fp") != F.col(c))).select(F.col("fp").alias("u"), F.col(c).alias("v")) for c in ("prev", "head")]
    links = Table(chains[0].unionByName(chains[1]).distinct(), "chains").df
    labels = components(links)
    labelled = full.select("sig", "fp").join(labels, F.col("fp") == F.col("node"), "left").select("sig", "fp", F.coalesce("component", "fp").alias("label"))
    labelled = Table(labelled, "labelled").df
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("sig")
    sides = Table(labelled.join(mixed, "sig", "left_semi"), "mixed").df
    a, b = sides.alias("a"), sides.alias("b")
    cross = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.label") < F.col("b.label")) & near(F.col("a.fp"), F.col("b.fp")))
    # one link joins two components, however many pairs of theirs are near; the least combines before the shuffle
    joined = cross.groupBy("a.label", "b.label").agg(F.min(F.struct(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))).alias("link"))
    return links.unionByName(joined.select("link.u", "link.v"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits),
    component_id (the least id of all documents reachable by links).

    Null text counts as empty; texts without words have fingerprint zero, which
    links like any other. Equal fingerprints are linked. Repeated rows get equal
    rows; null ids take part but are the component's id only if it has no other.
    An empty table gives an empty result; other columns are ignored, whatever
    their names. Texts of any length are hashed in bounded pieces.
    """
    bounded_memory(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), _fingerprints(words)(text_or_empty(text_col)).alias("fp"))
    rows = Table(rows, "fingerprints").df
    prints = Table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints").df
    labels = components(near_links(prints.select("fp"), most_bits))
    labelled = prints.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    labelled = Table(labelled, "labels").df
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(least, "label").select("fp", "component_id")
    return rows.join(of_print, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
