"""Byte-level BPE encoding and decoding: merges in Spark's higher-order functions.

A word (a match of the splitting pattern) is an array of bytes; a fold merges
the adjacent pair of the lowest rank, leftmost first, until no pair has a rank.
Ranks are a scalar subquery: an array of buckets by crc32, so a look-up costs
the same at any vocabulary size.

Each distinct word of 64 partitions of the corpus is folded once, whatever its
frequency:

1. An Arrow function splits texts once and packs documents into chunks of a
   bounded number of bytes: a chunk is its distinct words, and its documents as
   numbers of words, compressed. Chunks are all that is kept of the texts.
2. (chunk, number, word) rows meet by word and group of partitions - a word has
   one row a chunk, however often it occurs - and the first of each folds it for
   the others.
3. The codes go back to their chunks, where documents become ids by array
   look-ups, and ids become the pieces of bytes that they stand for.

Words of more than LONG bytes, whose fold would take the square of their
length, are merged by the same rule with a heap, inside their chunk.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .shared import bounded_memory, release, text_or_empty

BUCKETS = 1 << 16
CHUNK_BYTES = 1 << 24  # text of a chunk, unless one document has more
ROWS = 1 << 15  # rows of an Arrow batch of words
HELD_ROWS = 1 << 20  # codes that a worker sorts by chunk at a time
LONG = 256  # bytes of the longest word that is folded
NO_RANK = 2**31 - 1
_RANKS = "struct<k:array<array<binary>>,r:array<array<int>>>"  # keys and ranks by bucket


def _buckets(ranks: dict[bytes, int], n: int) -> dict[str, list[list]]:
    out: dict[str, list[list]] = {"k": [[] for _ in range(n)], "r": [[] for _ in range(n)]}
    for key, rank in ranks.items():
        at = zlib.crc32(key) % n
        out["k"][at].append(base64.b64encode(key).decode())
        out["r"][at].append(rank)
    return out


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def _find(ranks: Column, key: Column) -> Column:
    """The rank of a key, or null."""
    bucket = F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")
    return F.get(F.get(ranks["r"], bucket), (F.array_position(F.get(ranks["k"], bucket), key) - 1).cast("int"))


class Codec:
    """Expressions over the rank file at a path. Plans are printed whole, again
    and again, so literals hold no more than they need; and the rank map, which
    every query of the corpus has, is no literal but the value of a subquery."""

    def __init__(self, path: str):
        self.path, self.ranks = path, read_ranks(path)
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for k, r in self.ranks.items():
            self.pieces[r] = k

    def rank_map(self) -> Column:
        """A column of its own for encode: higher-order functions take no subquery, until projections are collapsed."""
        listed = json.dumps(_buckets(self.ranks, BUCKETS), separators=(",", ":"))
        # from an RDD: what is known of a local row would be folded back into a literal
        row = SparkSession.active().createDataFrame(SparkSession.active().sparkContext.parallelize([(listed,)], 1), "listed string")
        return row.select(F.from_json("listed", _RANKS).alias("ranks")).scalar()

    @staticmethod
    def _merged(word: Column, ranks: Column) -> Column:
        """The parts of a word after all merges, array<binary>."""

        def rank(part: Column) -> Column:
            return F.coalesce(_find(ranks, part), F.lit(NO_RANK))

        def start(raw: Column) -> Column:
            n = F.octet_length(raw)
            parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(raw, i, F.lit(1)))
            # sequence(1, 0) would count down, so one-byte words have no pairs by name
            pairs = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: rank(F.substring(raw, i, F.lit(2)))))
            return F.struct(parts.alias("p"), pairs.alias("r"))

        def merge(acc: Column, at: Column) -> Column:
            p, r, i = acc["p"], acc["r"], at["i"].cast("int")
            none = F.array().cast("array<int>")

            def joined(both: Column) -> Column:
                left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), both)))).otherwise(none)
                right = F.when(i + 1 < F.size(p), F.array(rank(F.concat(both, F.get(p, i + 1))))).otherwise(none)
                parts = F.concat(F.slice(p, F.lit(1), i - 1), F.array(both), F.slice(p, i + 2, F.size(p)))
                pairs = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(p)))
                return F.struct(parts.alias("p"), pairs.alias("r"))

            return _let(F.concat(F.get(p, i - 1), F.get(p, i)), joined)

        def step(acc: Column, _: Column) -> Column:
            least = F.array_min(acc["r"])
            # no pair with a rank is left: the rest of the fold passes through
            return F.when(F.coalesce(least, F.lit(NO_RANK)) == NO_RANK, acc).otherwise(_let(F.struct(F.array_position(acc["r"], least).alias("i")), lambda at: merge(acc, at)))

        def fold(raw: Column) -> Column:
            rounds = F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - 1, F.lit(1)))
            return F.aggregate(rounds, start(raw), step)["p"]

        return _let(word.cast("binary"), fold)

    def encode(self, word: Column, ranks: Column) -> Column:
        """Ids of a word, array<int>; ranks: a column of rank_map."""
        raw = word.cast("binary")
        of = lambda parts, ranks: F.transform(parts, lambda p: _find(ranks, p))
        # tokens that are words need no merges
        whole = lambda ranks: _let(_find(ranks, raw), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(of(self._merged(raw, ranks), ranks)))
        return _let(ranks, whole)

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids; ids outside the vocabulary add none."""
        pieces = F.from_json(F.lit(json.dumps([k.hex() for k in self.pieces])), "array<string>")
        return _let(pieces, lambda lit: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(lit, i)), "")))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> bytes:
    """Ids of a word by the rule of the fold, in n log n: pairs wait in a heap
    by (rank, place); parts are linked to their neighbours."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != to:  # one of the parts is another by now
            continue
        end[i], after[i], end[j] = to, after[j], 0
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = array("I"), 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return np.array(out, "<u4").tobytes()


def _pack(*parts) -> bytes:
    """Bytes, each compressed by itself, and arrays of 32-bit numbers, whose
    bytes are laid out by place so that they compress."""
    squeeze, out = zstandard.ZstdCompressor(level=3).compress, []
    for part in parts:
        if isinstance(part, bytes):
            out.append(squeeze(part))
        else:
            out += [squeeze(((part >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8)) for k in range(4)]
    return b"".join([np.array([len(out), *map(len, out)], "<u8").tobytes(), *out])


class _Unpacked:
    """What _pack made, part by part: a part of numbers has four places."""

    def __init__(self, packed):
        self.data = memoryview(packed)
        n = int.from_bytes(self.data[:8], "little")
        self.ends = (np.cumsum(np.frombuffer(self.data, "<u8", n + 1)[1:].astype(np.int64)) + 8 * (n + 1)).tolist()
        self.at = 8 * (n + 1)

    def skip(self, places: int = 1) -> None:
        for _ in range(places):
            self.at = self.ends.pop(0)

    def bytes(self) -> bytes:
        begin = self.at
        self.skip()
        return zstandard.ZstdDecompressor().decompress(self.data[begin : self.at])

    def numbers(self) -> np.ndarray:
        out = None
        for k in range(4):
            place = np.frombuffer(self.bytes(), np.uint8)
            out = place.astype(np.uint32) if out is None else np.bitwise_or(out, np.left_shift(place, 8 * k, dtype=np.uint32), out=out)
        return out


class Chunk:
    """Documents as numbers of the chunk's distinct words."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[int] = []
        self.symbols = array("I")
        self.bytes = 0
        self.index = _Numbers()

    def add(self, doc_id, text: str, words: list[str]) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.symbols.extend(map(self.index.__getitem__, words))
        self.bytes += len(text) if text.isascii() else len(text.encode())

    def packed(self, kind: pa.DataType, ranks: dict[bytes, int]) -> bytes:
        """ids, number of words by document, letters and lengths of the distinct
        words, codes of long words and their lengths, documents as numbers.
        Frequent words get small numbers. Words that are too long to be folded
        are merged here and have length 0. The chunk is used up."""
        symbols = np.frombuffer(self.symbols, np.uint32)
        order = np.argsort(-np.bincount(symbols, minlength=len(self.index)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.index)
        self.index.clear()
        words = [words[i].encode() for i in order.tolist()]
        lengths = np.fromiter(map(len, words), np.uint32, len(words))
        long = np.flatnonzero(lengths > LONG).tolist()
        codes = [merge_long(words[i], ranks) for i in long]
        for i in long:
            words[i], lengths[i] = b"", 0
        letters = b"".join(words)
        del words
        ids = pa.record_batch({"id": pa.array(self.ids, kind)}).serialize().to_pybytes()
        return _pack(lengths, letters, ids, np.array(self.sizes, np.int64).tobytes(), np.array(list(map(len, codes)), np.int64).tobytes(), b"".join(codes), place[symbols])


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


#: Partitions of the texts, as a power of two, within which a word is folded once.
SPAN_BITS = 6

_CHUNKS = "chunk long, payload binary"


#: Code points below this have letters, digits and white space listed for the built-in engine.
NARROW = 0x250


def _listed(of: Callable[[str], bool]) -> str:
    """The code points below NARROW of a class, as ranges of a set."""
    inside = [of(chr(c)) for c in range(NARROW)]
    starts = [c for c in range(NARROW) if inside[c] and not (c and inside[c - 1])]
    ends = [c for c in range(NARROW) if inside[c] and not (c + 1 < NARROW and inside[c + 1])]
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in zip(starts, ends))


def narrowed(pattern: str) -> str | None:
    """A pattern that does the same to texts below NARROW in Python's built-in
    engine, which is over twice as fast; None where it has more than letters,
    digits and white space by class."""
    category = lambda k: _listed(lambda c: unicodedata.category(c)[0] == k)
    space = _listed(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
    known, inside, out = {r"\p{L}": category("L"), r"\p{N}": category("N"), r"\s": space}, False, []
    for token in re.split(r"(\\p\{\w+\}|\\.|\[|\]|\(\?[^!])", pattern):
        if token in ("[", "]"):
            inside = token == "["
        if token in known:
            out.append(known[token] if inside else f"[{known[token]}]")
        elif token == r"\S" and not inside:
            out.append(f"[^{space}]")
        elif token.startswith("\\") or token.startswith("(?"):
            return None
        else:
            out.append(token)
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    whole, narrow = regex.compile(pattern).findall, narrowed(pattern)
    if narrow is None:
        return whole
    fast, wide = re.compile(narrow).findall, re.compile(rf"[^\x00-\u{NARROW - 1:04x}]").search
    return lambda text: whole(text) if wide(text) else fast(text)


def _split(pattern: str, kind: pa.DataType, ranks: dict[bytes, int], most: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n, chunk = splitter(pattern), 0, Chunk()
        first = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            return pa.record_batch({"chunk": pa.array([first + n], pa.int64()), "payload": pa.array([chunk.packed(kind, ranks)], pa.binary())})

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                text = text.as_py()
                chunk.add(doc_id.as_py(), text, find(text))
                if chunk.bytes >= most:
                    yield row()
                    n, chunk = n + 1, Chunk()
        if chunk.ids:
            yield row()
        del chunk
        release()

    return of


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks -> (chunk, number, word) of the words that are to be folded."""
    for b in batches:
        for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload")):
            got = _Unpacked(payload.as_buffer())
            lengths, letters = got.numbers(), got.bytes()
            numbers = np.flatnonzero(lengths).astype(np.int32)
            ends = np.cumsum(lengths[numbers], dtype=np.int64)
            for at in range(0, len(numbers), ROWS):
                some = ends[at : at + ROWS]
                begin = int(ends[at - 1]) if at else 0
                offsets = np.concatenate([[0], some - begin]).astype(np.int32)
                word = pa.StringArray.from_buffers(len(some), pa.py_buffer(offsets), pa.py_buffer(letters[begin : int(some[-1])]))
                yield pa.record_batch({"chunk": pa.array(np.full(len(some), chunk)), "number": pa.array(numbers[at : at + ROWS]), "word": word})
    release()


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, number, code) -> (chunk, packed numbers, lengths and ids), a bounded number of rows at a time."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        chunk, number = rows.column("chunk").to_numpy(), rows.column("number").to_numpy()
        order = np.lexsort((number, chunk))
        rows, chunk, number = rows.take(pa.array(order)), chunk[order], number[order].astype(np.uint32)
        code = rows.column("code").combine_chunks()
        offsets, ids = code.offsets.to_numpy(), code.values.to_numpy().view(np.uint32)
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
            steps = np.diff(number[a:b], prepend=np.uint32(0))
            out.append((int(chunk[a]), _pack(steps, np.diff(offsets[a : b + 1]).astype(np.uint32), ids[offsets[a] : offsets[b]])))
        return pa.record_batch({"chunk": pa.array([x[0] for x in out], pa.int64()), "codes": pa.array([x[1] for x in out], pa.binary())})

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= HELD_ROWS:
            yield packed()
            held = []
    if sum(x.num_rows for x in held):
        yield packed()
    held.clear()
    release()


def _coded(lengths: np.ndarray, long_sizes: bytes, long_codes: bytes, packs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first id, number of ids) of each of a chunk's words, and the ids."""
    sizes = np.zeros(len(lengths), np.int64)
    long = np.flatnonzero(lengths == 0)
    sizes[long] = np.frombuffer(long_sizes, np.int64) // 4
    parts = [(long, np.frombuffer(long_codes, "<u4"))]
    for pack in packs:
        got = _Unpacked(pack)
        number = np.cumsum(got.numbers(), dtype=np.int64)
        sizes[number] = got.numbers()
        parts.append((number, got.numbers()))
    starts, at = np.zeros(len(lengths), np.int64), 0
    for number, ids in parts:
        starts[number] = at + np.cumsum(sizes[number]) - sizes[number]
        at += len(ids)
    return starts, sizes, np.concatenate([ids for _, ids in parts])


def _joined(kind: pa.DataType, pieces: list[bytes], per_batch: int):
    def of(chunks: pa.Table, codes: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", kind), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
        out = []
        for payload in chunks.column("payload"):
            got = _Unpacked(payload.as_buffer())
            word_lengths = got.numbers()
            got.skip()
            doc_ids = pa.ipc.read_record_batch(pa.py_buffer(got.bytes()), pa.schema([("id", kind)])).column(0)
            sizes = np.frombuffer(got.bytes(), np.int64)
            starts, lengths, flat = _coded(word_lengths, got.bytes(), got.bytes(), [c.as_buffer() for c in codes.column("codes")])
            symbols = got.numbers()
            rows, held, end = [], 0, 0
            for i, size in enumerate(sizes.tolist()):
                s = symbols[end : end + size]
                end += size
                n = lengths[s]
                upto = np.cumsum(n)
                ids = flat[np.repeat(starts[s] - upto + n, n) + np.arange(upto[-1] if size else 0)]
                rows.append((len(ids), ids.tobytes(), b"".join([pieces[k] for k in ids.tolist()])))
                held += 4 * len(ids)
                if held >= per_batch or i + 1 == len(sizes):
                    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types[1:])]
                    out.append(pa.RecordBatch.from_arrays([doc_ids.slice(i + 1 - len(rows), len(rows)), *columns], schema=schema))
                    rows, held = [], 0
        return pa.Table.from_batches(out, schema)

    return of


def bpe(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, ids (little-endian
    unsigned 32-bit integers), decoded (the bytes that the ids stand for).

    Null and empty texts have no tokens. Special tokens are not treated as
    such. Repeated rows get equal rows; an empty table gives an empty result;
    other columns are ignored, whatever their names. Texts may be as long as a
    row of Spark holds; a word of any length is merged in n log n. The rank
    file is read on the driver. chunk_bytes changes time and memory only.
    """
    codec = Codec(rank_path)
    spark = docs.sparkSession
    bounded_memory(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    ranks, pieces = spark.sparkContext.broadcast(codec.ranks), spark.sparkContext.broadcast(codec.pieces)
    # both uses below read the same exchange, so texts are split once
    chunks = rows.mapInArrow(lambda batches: _split(pattern, kind, ranks.value, chunk_bytes)(batches), _CHUNKS).repartition("chunk")
    words = chunks.mapInArrow(_words, "chunk long, number int, word string").withColumn("span", F.shiftright("chunk", 32 + SPAN_BITS))
    # chunks are numbered by partition: a word meets itself within SPAN of them, so no window grows with the corpus
    first = Window.partitionBy("word", "span").orderBy("chunk")
    numbered = words.withColumn("nth", F.row_number().over(first)).withColumn("ranks", codec.rank_map())
    folded = numbered.withColumn("folded", F.when(F.col("nth") == 1, codec.encode(F.col("word"), F.col("ranks"))))
    codes = folded.select("chunk", "number", F.first("folded").over(first).alias("code")).mapInArrow(_by_chunk, "chunk long, codes binary")
    join = lambda left, right: _joined(kind, pieces.value, 1 << 22)(left, right)
    schema = rows.select("doc_id").schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")
    found = chunks.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(join, schema)
    return found.withColumnRenamed("doc_id", id_col)
