"""Exact top-k inner products on a bit-sliced index.

Rows are dealt to blocks. A block keeps, for each dimension and each bit of its
quantised values, a bitmap over its rows. A query's score is a sum of slices
shifted by the set bits of its weights; carry-save adders on whole bitmaps turn
them into the slices of the score. The top rows are taken from the most
significant slice downwards: those that must be in, and those still tied. Once
all slices are used, rows still tied have equal scores, so the boundary is
resolved exactly by the smaller id.

Every query block meets every index block (that is the stated query set against
all rows), in an equality join on block numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Table, bounded_memory

SCALE = 64
K = 20
BLOCK_ROWS = 16_384
QUERY_ROWS = 128
LARGEST = 2.0**62  # quantised components from here on are an error: they are no whole numbers of 64 bits
WORD = 64


def build_block(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Rows in id order -> (ids, least value by dimension, bits, slices), slices
    of shape (dimensions * bits, words)."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    least = values.min(axis=0) if values.shape[1] else np.zeros(0, np.int64)
    above = values.astype(np.uint64) - least.astype(np.uint64)  # modulo 2**64, so it is right at any range
    bits = max(1, int(above.max()).bit_length()) if above.size else 1
    words = -(-len(ids) // WORD)
    out = np.zeros((values.shape[1] * bits, words * 8), np.uint8)
    for d in range(values.shape[1]):
        for b in range(bits):
            packed = np.packbits(((above[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            out[d * bits + b, : len(packed)] = packed
    return ids, least, bits, out.view(np.uint64)


def score_slices(query: np.ndarray, least: np.ndarray, bits: int, slices: np.ndarray, flipped: np.ndarray) -> tuple[np.ndarray, int]:
    """(slices of the score above an offset, offset). Negative weights count
    flipped slices, so every addend is positive."""
    at: dict[int, list[int]] = {}
    offset, full, n = 0, (1 << bits) - 1, len(slices)
    for d, q in enumerate(query.tolist()):
        weight = abs(q)
        offset += q * int(least[d]) - (weight * full if q < 0 else 0)
        base = d * bits + (n if q < 0 else 0)
        shift = 0
        while weight:
            if weight & 1:
                for b in range(bits):
                    at.setdefault(shift + b, []).append(base + b)
            weight >>= 1
            shift += 1
    both = (slices, flipped)
    out, carried, p = [], np.zeros((0, slices.shape[1]), np.uint64), 0
    while p <= max(at, default=-1) or len(carried):
        own = at.get(p, [])
        plain, other = [i for i in own if i < n], [i - n for i in own if i >= n]
        rows = np.concatenate([both[0][plain], both[1][other], carried])
        carries = []
        while len(rows) > 2:  # full adders, all at once
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            rows = np.concatenate([ab ^ c, rows[3 * m :]])
        if len(rows) == 2:
            carries.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        out.append(rows[0] if len(rows) else np.zeros(slices.shape[1], np.uint64))
        carried = np.concatenate(carries) if carries else carried[:0]
        p += 1
    return (np.stack(out) if out else np.zeros((0, slices.shape[1]), np.uint64)), offset


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores among allowed rows, ties to the lowest."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    count = lambda x: int(np.bitwise_count(x).sum())
    n_sure = 0
    for s in score[::-1]:
        ones = tied & s
        n = n_sure + count(ones)
        if n > k:
            tied = ones
        else:
            sure, tied, n_sure = sure | ones, tied & ~s, n
            if n == k:
                return _positions(sure)
    return np.concatenate([_positions(sure), _positions(tied)[: k - n_sure]])


def _values(score: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """The scores of rows; an error if one is beyond 64 bits."""
    whole = np.int64 if len(score) < 62 and abs(offset) < 2**62 else object
    got = np.full(len(at), offset, whole)
    for p, s in enumerate(score):
        got += ((s[at // WORD] >> (at % WORD).astype(np.uint64)) & np.uint64(1)).astype(whole) * (1 << p)
    if whole is object and any(not -(2**63) <= int(x) < 2**63 for x in got):
        raise OverflowError("a score does not fit 64 bits")
    return got.astype(np.int64)


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    values = np.array(pdf["q"].tolist(), np.int64).reshape(len(pdf), -1)
    ids, least, bits, slices = build_block(pdf["vec_id"].to_numpy(np.int64), values)
    head = pdf.iloc[0]
    return pd.DataFrame({"dim": [head["dim"]], "block": [head["block"]], "n": [len(ids)], "bits": [bits], "ids": [ids.tobytes()], "least": [least.astype(np.int64).tobytes()], "slices": [slices.tobytes()]})


def _queries(pdf: pd.DataFrame) -> pd.DataFrame:
    head = pdf.iloc[0]
    values = np.array(pdf["q"].tolist(), np.int64).reshape(len(pdf), -1)
    return pd.DataFrame({"dim": [head["dim"]], "qb": [head["qb"]], "rids": [pdf["rid"].to_numpy(np.int64).tobytes()], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "values": [values.tobytes()]})


def _search(k: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, least = np.frombuffer(row.ids, np.int64), np.frombuffer(row.least, np.int64)
                words = -(-row.n // WORD)
                slices = np.frombuffer(row.slices, np.uint64).reshape(row.dim * row.bits, words)
                flipped = ~slices
                valid = np.packbits(np.arange(words * WORD) < row.n, bitorder="little").view(np.uint64)
                rids, qids = np.frombuffer(row.rids, np.int64), np.frombuffer(row.qids, np.int64)
                queries = np.frombuffer(row.values, np.int64).reshape(len(qids), row.dim)
                out = []
                for rid, qid, q in zip(rids.tolist(), qids.tolist(), queries):
                    score, offset = score_slices(q, least, row.bits, slices, flipped)
                    allowed = valid.copy()
                    for own in range(*np.searchsorted(ids, [qid, qid + 1]).tolist()):
                        allowed[own // WORD] &= ~(np.uint64(1) << np.uint64(own % WORD))
                    at = top_rows(score, allowed, k)
                    out.append(pd.DataFrame({"rid": rid, "query_id": qid, "vec_id": ids[at], "score": _values(score, at, offset)}))
                if out:
                    yield pd.concat(out)

    return of


def topk_search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 20, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row whose id is divisible by `every`, its k best other rows by
    integer inner product of floor(scale * x): query_id, rank, vec_id, score.

    Rows take no part if the id or the vector is null or the vector holds a
    null, infinite or NaN component; vectors are compared within one length
    (empty ones score 0). Rows that share the query's id are its own. Fewer
    than k others give all of them; ties go to the smaller id. Repeated query
    rows give one list each. An empty table gives an empty result; other columns
    are ignored, whatever their names. Scores are exact whole numbers; a
    quantised component of 2**62 or more, or a score among the best that does
    not fit 64 bits, is an error.
    """
    bounded_memory(vectors.sparkSession)
    x = F.col("v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    large = F.raise_error(F.lit("a component is too large for exact scores")).cast("long")
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < LARGEST, F.floor(c.cast("double") * scale).cast("long")).otherwise(large))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("v").alias("dim"), whole.alias("q"))
    rows = Table(rows, "vectors").df
    total = rows.count()
    asked = rows.filter(F.col("vec_id") % every == 0)
    n_blocks, n_query_blocks = max(1, -(-total // block_rows)), max(1, -(-asked.count() // query_rows))
    cores = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    # few index blocks are copied to several tasks; many need no copies
    groups = min(n_query_blocks, -(-2 * cores // n_blocks))
    dealt = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    index = rows.withColumn("block", dealt(n_blocks)).groupBy("dim", "block").applyInPandas(_index, "dim int, block int, n int, bits int, ids binary, least binary, slices binary")
    index = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = asked.withColumn("qb", dealt(n_query_blocks)).groupBy("dim", "qb").applyInPandas(_queries, "dim int, qb int, rids binary, qids binary, values binary")
    queries = queries.withColumn("g", F.col("qb") % groups).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = queries.join(index.hint("shuffle_hash"), ["dim", "block", "g"]).mapInPandas(_search(k), "rid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
