"""Suffix-array dedup: removal of byte strings that occur twice in a corpus.

A string of W bytes that starts at two places is found in three steps.

1. Anchors. Of the G-byte grams of a W-byte window, the one with the least hash
   (the rightmost of equals) is its anchor. Equal windows have the same anchor
   at the same offset. Consecutive windows with one anchor form its context.
   Every window of the corpus is in exactly one context.
2. Anchors that occur once are done with. If all contexts of an anchor are
   equal, all of their windows repeat. Otherwise the windows
   are cut into classes by their distance to the anchor, and the bytes that all
   windows of a class share (most of W) become a finer key. A gram that is
   frequent because it sits in a short common line falls apart here. Equal
   contexts of a key count once from here on.
3. What is left - edges of passages and edits - goes to shards by its key. Each
   shard sorts the suffixes of its contexts by Larsson and Sadakane's
   refinement, gets common prefixes by Kasai's rule, and shards that hold
   contexts of one key look their suffixes up in each other by binary search.
   Keys with very many different contexts are cut into smaller classes first,
   down to single windows if need be.

Whole contexts are equal if 128 bits of a cryptographic hash (BLAKE2b) are;
partly equal ones are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, bounded_memory, written

W = 200
GRAM = 64
CLASSES = (38, 10, 3, 1)  # windows of one class start within so many bytes
MOST_CONTEXTS = 1024  # different contexts of a key that are compared as they are
PIECE = 1 << 18  # bytes worked on at a time
SHARD_BYTES = 1 << 17  # text of one suffix array
SEARCHED = 1 << 12  # windows looked up at a time
_B = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _C
    return h ^ (h >> np.uint64(29))


def powers(n: int, base: np.uint64 = _B) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(data: np.ndarray, base: np.uint64) -> np.ndarray:
    """p[i] = hash of data[:i], in a form that gives any span's hash as a
    difference times a power (all modulo 2**64)."""
    inverse = np.uint64(pow(int(base), -1, 2**64))
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), inverse)[: len(data)], out=p[1:])
    return p


def span_hashes(p: np.ndarray, power: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (p[end] - p[start]) * power[start]


def _windowed(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every width consecutive values."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, w: int = W, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the anchor's gram, first window, last window), by window."""
    n = len(data) - w + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    p, power = prefix_hashes(data, _B), powers(len(data))
    at = np.arange(len(data) - gram + 1)
    h = _mix(span_hashes(p, power, at, at + gram))
    # rightmost of the least: order by hash, then by position from the right, in one number
    span = w - gram + 1
    low = _windowed(h, span, np.minimum)
    chosen = _rightmost(h, low, span)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:], n) - 1
    return chosen[first], first, last


def _rightmost(h: np.ndarray, low: np.ndarray, span: int) -> np.ndarray:
    """For each window i the last position q <= i + span - 1 with h[q] = low[i]."""
    n = len(low)
    # a position is the last least of some window only if it is a least of one: few are
    cover = _windowed(np.concatenate([np.zeros(span - 1, low.dtype), low, np.zeros(span - 1, low.dtype)]), span, np.maximum)
    least = np.flatnonzero(cover[: len(h)] == h)
    # candidates of the window are sorted by position; take the last in it whose hash is the least
    end = np.searchsorted(least, np.arange(n) + span, side="left") - 1
    out = least[end]
    wrong = np.flatnonzero(h[out] != low)
    while len(wrong):
        end[wrong] -= 1
        out[wrong] = least[end[wrong]]
        wrong = wrong[h[out[wrong]] != low[wrong]]
    return out


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces whose windows together are all windows. Windows cut
    from their context by a border make a context of their own, which is no
    loss: contexts are compared by what they contain."""
    for at in range(0, max(1, len(data) - W + 1), PIECE):
        yield at, data[at : at + PIECE + W - 1]


_ANCHORS = "id1 long, id2 long, key long, code long, code2 long, first int, last int, at int"
_CONTEXTS = _ANCHORS + ", context binary"
_NAMES = ["id1", "id2", "key", "code", "code2", "first", "last", "at"]


def _digest(context: bytes, at: int) -> bytes:
    """128 bits of a cryptographic hash of a context and where its anchor is."""
    return hashlib.blake2b(context, digest_size=16, salt=at.to_bytes(2, "little")).digest()


def _batch(columns: list, contexts: list[bytes] | None = None) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()] * 3
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    if contexts is None:
        return pa.RecordBatch.from_arrays(arrays, _NAMES)
    return pa.RecordBatch.from_arrays([*arrays, pa.array(contexts, pa.binary())], [*_NAMES, "context"])


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for id1, id2, raw in zip(batch["id1"].to_pylist(), batch["id2"].to_pylist(), batch["raw"]):
            for at, data in _pieces(np.frombuffer(raw.as_buffer(), np.uint8)):
                pos, first, last = anchors(data)
                if not len(pos):
                    continue
                key = _mix(span_hashes(prefix_hashes(data, _B), powers(len(data)), pos, pos + GRAM))
                piece, ends, offsets = data.tobytes(), (last + W).tolist(), (pos - first).tolist()
                code = np.frombuffer(b"".join([_digest(piece[a:b], o) for a, b, o in zip(first.tolist(), ends, offsets)]), np.int64).reshape(-1, 2)
                parts.append((np.full(len(pos), id1), np.full(len(pos), id2), key.view(np.int64), code[:, 0], code[:, 1], first + at, last + at, pos + at))
        if parts:
            yield _batch([np.concatenate(c) for c in zip(*parts)])


def classes(first: int, last: int, at: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(class, first, last) of the windows first..last of an anchor at `at`."""
    for j in range((at - last) // size, (at - first) // size + 1):
        yield j, max(first, at - size * j - size + 1), min(last, at - size * j)


def shared_bytes(size: int) -> int:
    """How many bytes all windows of a class of this size have."""
    return W - size + 1


class _Classes:
    """Contexts cut into classes, as columns."""

    def __init__(self, size: int):
        self.size, self.own, self.keys, self.codes = size, [], [], []
        self.first, self.last, self.at, self.contexts = [], [], [], []

    def add(self, row: int, first: int, last: int, at: int, context: bytes) -> None:
        """context: the bytes of the windows first..last."""
        shared = shared_bytes(self.size)
        for j, a, b in classes(first, last, at, self.size):
            begin = at - self.size * j - first
            part = context[a - first : b - first + W]
            self.own.append(row)
            self.keys.append(hashlib.blake2b(context[begin : begin + shared], digest_size=8, salt=j.to_bytes(2, "little")).digest())
            self.codes.append(_digest(part, at - a))
            self.first.append(a)
            self.last.append(b)
            self.at.append(at)
            self.contexts.append(part)

    def batch(self, id1: np.ndarray, id2: np.ndarray) -> pa.RecordBatch:
        code = np.frombuffer(b"".join(self.codes), np.int64).reshape(-1, 2)
        own = np.array(self.own, np.int64)
        return _batch([id1[own], id2[own], np.frombuffer(b"".join(self.keys), np.int64), code[:, 0], code[:, 1], self.first, self.last, self.at], self.contexts)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch["id1"].to_numpy(False), batch["id2"].to_numpy(False)


def _lists(column: pa.ListArray, *names: str) -> Iterator[list[tuple]]:
    """Each row's list of structs as tuples; empty for null."""
    flat = list(zip(*(column.values.field(n).to_pylist() for n in names)))
    for begin, end, fine in zip(column.offsets.to_pylist(), column.offsets.to_pylist()[1:], column.is_valid().to_pylist()):
        yield flat[begin:end] if fine else []


def _cut_classes(size: int):
    """Rows of a document with its unresolved contexts -> contexts by class."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Classes(size)
            for i, (raw, spans) in enumerate(zip(batch["raw"], _lists(batch["spans"], "first", "last", "at"))):
                raw = raw.as_py()
                for first, last, at in spans:
                    out.add(i, first, last, at, raw[first : last + W])
            yield out.batch(*_ids(batch))

    return of


def _split_classes(size: int):
    """Contexts -> contexts by smaller classes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Classes(size)
            for i, row in enumerate(zip(*(batch[c].to_pylist() for c in ("first", "last", "at", "context")))):
                out.add(i, *row)
            yield out.batch(*_ids(batch))

    return of


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of whole numbers from 0 in order, by Larsson and Sadakane's
    refinement: ranks start from as many symbols as fit 62 bits and double the
    sorted prefix until all differ; only groups not yet told apart are sorted
    again."""
    n = len(data)
    bits = int(data.max(initial=1)).bit_length()
    h = 62 // bits
    padded = np.concatenate([data.astype(np.int64), np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    slots = np.arange(n)
    while True:
        # places of groups with several suffixes, among those still looked at
        group = rank[order[slots]]
        alone = np.concatenate([[True], group[1:] != group[:-1]]) & np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)
        slots, group = slots[~alone], group[~alone]
        if not len(slots):
            break
        suffix = order[slots]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        both = group * (n + 1) + follow
        by = np.argsort(both, kind="stable")
        order[slots], both = suffix[by], both[by]
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        rank[order[slots]] = np.repeat(slots[new], np.diff(np.append(new, len(slots))))
        h *= 2
    return order


STRIDE = 64


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """lcp[k] of suffixes order[k - 1] and order[k], up to `most`, by Kasai's
    rule: in text order a suffix's value is at least its predecessor's less
    one. n / 64 such chains run side by side."""
    n = len(data)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data.astype(np.int32), np.full(most + 1, -1, np.int32)])
    value = np.zeros(n, np.int64)
    for phase in range(min(STRIDE, n)):
        at = np.arange(phase, n, STRIDE)
        if phase:
            value[at] = np.maximum(value[at - 1] - 1, 0)
        live = at[before[at] >= 0]
        value[at[before[at] < 0]] = 0
        while len(live):
            i, j = live + value[live], before[live] + value[live]
            same = (padded[i] == padded[j]) & (padded[i] >= 0) & (value[live] < most)
            live = live[same]
            value[live] += 1
    lcp[1:] = value[order[1:]]
    return lcp


class Shard:
    """Contexts joined by separators (symbol 0; bytes are 1 to 256), with their
    suffixes in order. Suffixes that run over a separator match no window.

    All contexts may have `shared` bytes, from middles on, that every window
    contains. They become one symbol, the same for the same bytes, so windows
    are as much shorter, and equal as before."""

    def __init__(self, contexts: list[bytes], middles: list[int] | None = None, shared: int = 1, symbols: dict[bytes, int] | None = None):
        self.w = W - shared + 1
        self.lengths = np.array([len(c) for c in contexts])
        self.begin = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int32) + 1
        data[self.begin + self.lengths] = 0
        if middles is not None and shared > 1:
            at = self.begin + np.array(middles)
            data[at] = [symbols.setdefault(c[m : m + shared], 257 + len(symbols)) for c, m in zip(contexts, middles)]
            edges = np.zeros(len(data) + 1, np.int8)
            edges[at + 1], edges[at + shared] = 1, -1
            data = data[np.cumsum(edges[:-1]) == 0]
            self.lengths = self.lengths - shared + 1
            self.begin = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        self.data = data
        self.order = suffix_array(data)
        self.lcp = common_prefixes(data, self.order, self.w)

    def context(self, k: int) -> np.ndarray:
        return self.data[self.begin[k] : self.begin[k] + self.lengths[k]]

    def masks(self) -> list[np.ndarray]:
        """For each context a mask of its windows that occur elsewhere in the shard."""
        long = self.lcp >= self.w
        hit = np.zeros(len(self.data), bool)
        hit[self.order] = long | np.append(long[1:], False)
        return [hit[s : s + max(0, n - self.w + 1)].copy() for s, n in zip(self.begin.tolist(), self.lengths.tolist())]

    def holds(self, windows: np.ndarray) -> np.ndarray:
        """Which of the windows (rows of w symbols) start a suffix: binary search
        among the sorted suffixes, for all windows side by side."""
        padded = np.concatenate([self.data, np.zeros(self.w, self.data.dtype)])
        along, lo, hi = np.arange(self.w), np.zeros(len(windows), np.int64), np.full(len(windows), len(self.order))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            got = padded[self.order[np.minimum(mid, len(self.order) - 1)][:, None] + along]
            at = (got != windows).argmax(axis=1)[:, None]
            less = (np.take_along_axis(got, at, 1) < np.take_along_axis(windows, at, 1)).ravel() & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(hi, mid))
        inside = lo < len(self.order)
        got = padded[self.order[np.where(inside, lo, 0)][:, None] + along]
        return inside & (got == windows).all(axis=1)

    def search(self, context: np.ndarray, mask: np.ndarray) -> None:
        """Marks the windows of a context, not marked yet, that this shard holds."""
        if not len(mask):
            return
        windows, open_at = np.lib.stride_tricks.sliding_window_view(context, self.w), np.flatnonzero(~mask)
        for at in range(0, len(open_at), SEARCHED):
            some = open_at[at : at + SEARCHED]
            mask[some] = self.holds(windows[some])


def shard_windows(keys: list[int], contexts: list[bytes], middles: list[int] | None = None, shared: int = 1, most: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each context a mask of its windows that occur elsewhere: in another
    context (of the same key, for equal windows have equal keys) or again in
    itself. Contexts come sorted by key and fill shards of bounded size."""
    cuts, filled = [0], 0
    for i, c in enumerate(contexts):
        own = len(c) - shared + 2
        if filled and filled + own > most:
            cuts.append(i)
            filled = 0
        filled += own
    cuts.append(len(contexts))
    out: list[np.ndarray] = []
    symbols: dict[bytes, int] = {}
    previous: list[tuple[range, Shard]] = []
    for a, b in zip(cuts, cuts[1:]):
        shard = Shard(contexts[a:b], middles and middles[a:b], shared, symbols)
        masks = shard.masks()
        # shards before this one matter only where they hold contexts of its first key
        previous = [(r, s) for r, s in previous if keys[r[-1]] == keys[a]]
        for k in range(a, b):
            if not previous or keys[k] != keys[a]:
                break
            for _, s in previous:
                s.search(shard.context(k - a), masks[k - a])
        out += masks
        for r, s in previous:  # and the other way round
            for k in reversed(r):
                if keys[k] != keys[a]:
                    break
                shard.search(s.context(k - r[0]), out[k])
        previous.append((range(a, b), shard))
    return out


_SPANS = "id1 long, id2 long, first int, last int"
_SPAN_COLUMNS = ("id1", "id2", "first", "last")


def _emit_spans(size: int):
    """Sorted rows of a partition -> runs of repeated windows. Rows of one key
    may continue in the next batch, so the last key waits."""
    shared = shared_bytes(size)

    def spans(rows: pa.Table) -> pa.RecordBatch:
        first, at = rows["first"].to_numpy(), rows["at"].to_numpy()
        middles = at - size * ((at - first) // size) - first
        masks = shard_windows(rows["key"].to_pylist(), rows["context"].to_pylist(), middles.tolist(), shared)
        sizes = np.array([len(m) for m in masks])
        ends = np.cumsum(sizes + 1) - 1  # a gap after each context
        hit = np.zeros(int(ends[-1]) + 2, np.int8)
        for end, mask in zip(ends.tolist(), masks):
            hit[1 + end - len(mask) : 1 + end] = mask
        edges = np.diff(hit)
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        row = np.searchsorted(ends, starts)
        shift = first[row] - (ends[row] - sizes[row])
        id1, id2 = rows["id1"].to_numpy()[row], rows["id2"].to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(id1), pa.array(id2), pa.array((starts + shift).astype(np.int32)), pa.array((stops + shift).astype(np.int32))], list(_SPAN_COLUMNS))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch["key"].to_numpy(False)
            rest = len(key) - int((key == key[-1]).sum())  # rows of one key are together
            if rest or (waiting and waiting[-1]["key"][-1].as_py() != int(key[0])):
                done = pa.Table.from_batches([*waiting, batch.slice(0, rest)])
                waiting = []
                yield spans(done)
            waiting.append(batch.slice(rest))
        if waiting:
            yield spans(pa.Table.from_batches(waiting))

    return of


def _repeated_keys(rows: DataFrame) -> DataFrame:
    """(rows' columns, equal) of keys that occur twice; equal: all contexts of
    the key are equal. Counts combine before the shuffle, and are written, so
    that the join stands on two exchanges and may split a frequent key. rows is
    read twice and comes from a table."""
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("code", "code2") for f in (F.min, F.max)]).filter("n > 1")
    keys = written(keys.select("key", ((F.col("min_code") == F.col("max_code")) & (F.col("min_code2") == F.col("max_code2"))).alias("equal")), "keys")
    return rows.join(keys, "key")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, spans in zip(batch["raw"], _lists(batch["spans"], "first", "last")):
            raw, kept, at, n = memoryview(raw.as_buffer()), hashlib.sha256(), 0, 0
            runs: list[list[int]] = []
            for first, last in sorted(spans):
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], last + W)
                else:
                    runs.append([first, last + W])
            for s, e in runs:
                kept.update(raw[at:s])
                at, n = e, n + e - s
            kept.update(raw[at:])
            out.append((len(raw), n, len(runs), kept.hexdigest()))
        columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_removed, n_spans,
    kept_sha256.

    Removed is every byte covered by a 200-byte string that also starts
    somewhere else in the corpus, the same document included; all copies go.
    Null text counts as empty; texts under 200 bytes lose nothing; repeated
    rows are copies of each other, whatever their ids. Texts of any length are
    looked at in bounded pieces. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    bounded_memory(docs.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # rows equal in id and text have equal results, so these two name a row well enough
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("id1"), F.xxhash64("raw", F.col("doc_id").isNull()).alias("id2"), "raw")
    long = rows.filter(F.octet_length("raw") >= W).select("id1", "id2", "raw")
    every = Table(long.mapInArrow(_emit_anchors, _ANCHORS), "every")
    anchored = Table(_repeated_keys(every.df), "anchors")
    every.drop()
    found = [written(anchored.df.filter("equal").select(*_SPAN_COLUMNS), "spans")]
    listed = anchored.df.filter("NOT equal").groupBy("id1", "id2").agg(F.collect_set(F.struct("first", "last", "at")).alias("spans"))
    # a row that is repeated whole meets its list as often as it is repeated
    contexts = long.join(listed, ["id1", "id2"]).mapInArrow(_cut_classes(CLASSES[0]), _CONTEXTS)
    done_with = [anchored]
    for size, finer in zip(CLASSES, (*CLASSES[1:], None)):
        level = Table(contexts, "contexts")
        for table in done_with:
            table.drop()
        each = level.df.groupBy("key", "code", "code2").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("id1", "id2", "first", "last", "at", "context")])
        distinct = Table(each, "distinct")
        each, done_with = distinct.df, [level, distinct]
        # equal contexts repeat each other's windows
        twice = each.filter("n > 1").select("key", "code", "code2")
        found.append(written(level.df.drop("context").join(twice, ["key", "code", "code2"]).select(*_SPAN_COLUMNS), "spans"))
        if finer is None:  # one window a class: equal keys are equal contexts
            break
        keys = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter("d > 1"), "keys")
        few = each.join(keys.filter(F.col("d") <= MOST_CONTEXTS).select("key"), "key", "left_semi").select("id1", "id2", "key", "first", "at", "context")
        sharded = few.repartition("key").sortWithinPartitions("key")
        found.append(written(sharded.mapInArrow(_emit_spans(size), _SPANS), "spans"))
        many = keys.filter(F.col("d") > MOST_CONTEXTS)
        if many.isEmpty():
            break
        contexts = each.join(many.select("key"), "key", "left_semi").mapInArrow(_split_classes(finer), _CONTEXTS)
    for table in done_with:
        table.drop()
    spans = reduce(DataFrame.unionByName, found)
    listed = spans.groupBy("id1", "id2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    result = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = rows.join(listed, ["id1", "id2"], "left").select("doc_id", "raw", "spans").mapInArrow(_cut, result)
    return done.withColumnRenamed("doc_id", id_col)
