import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import suffix_dedup as sd
from paperloom.llm.components import components
from paperloom.llm.exact_dedup import exact_dedup
from paperloom.llm.simhash_dedup import fingerprint, signature_masks, simhash_dedup

SCHEMA = "doc_id long, text string, bucket string, key string, n long"


def docs(spark, rows, parts=3):
    """Rows with columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], SCHEMA).repartition(parts)


TEXTS = [(1, "a" * 50), (2, "a" * 50), (3, "a" * 49 + "b"), (4, None), (5, ""), (6, "é" * 30), (7, "é" * 30), (8, "a" * 50 + "a"), (9, "xy" * 40), (None, "xy" * 40), (10, "q"), (10, "q"), (11, "A" * 50)]


@pytest.mark.parametrize(("block", "bucket"), [(16_384, F.xxhash64), (7, F.xxhash64), (7, lambda c: F.pmod(F.xxhash64(c), F.lit(2)))])
def test_exact_dedup_equals_grouping_by_text(spark, block, bucket):
    got = exact_dedup(docs(spark, TEXTS), block_bytes=block, bucket=bucket).collect()
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(-1 if i is None else i)
    assert len(got) == len(TEXTS)
    for r in got:
        t = next(t or "" for i, t in TEXTS if i == r["doc_id"])
        assert r["keep_id"] == max(groups[t]) and r["group_size"] == len(groups[t])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(docs(spark, []).limit(0)).count() == 0


def _print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "a b c", "a b c d", "A B c d e f g", "É é x y z w v", "w " * 300])
def test_fingerprint(text):
    assert fingerprint(text) == _print(text)


def test_spark_hashes_like_the_contract(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()["h"] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_any_four_bits_leave_a_common_signature():
    masks = signature_masks()
    r = random.Random(3)
    for _ in range(3000):
        flipped = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(m & flipped == 0 for m in masks)


def test_simhash_components_equal_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base = [[word() for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append((100 + i, " ".join(w)))
    rows += [(1, None), (2, ""), (3, " "), (4, "alone here"), (4, "alone here"), (None, rows[0][1])]
    prints = [fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:  # spread the least id until nothing changes
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
    want = collections.Counter()
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if label[b] == label[a] and rows[b][0] is not None]
        want[(i, f"{prints[a]:016x}", min(ids))] += 1
    got = simhash_dedup(docs(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert len({k[2] for k in want}) < len(want)


def test_components_of_a_long_chain(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _brute(rows):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + sd.W] for k in range(len(b) - sd.W + 1))
    out = []
    for i, t in rows:
        b, runs = (t or "").encode(), []
        for k in range(len(b) - sd.W + 1):
            if count[b[k : k + sd.W]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + sd.W
                else:
                    runs.append([k, k + sd.W])
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + b[at:s], e
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _passages():
    r = random.Random(5)
    w = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))
    p = w(60)
    rows = [(k, w(r.randint(5, 60)) + " " + p[: r.choice((150, 180, 210, len(p)))] + w(r.randint(0, 40))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 700), (103, "x" * 199), (104, rows[3][1]), (104, rows[3][1]), (106, "ab" * 150), (107, "é" * 120), (None, rows[5][1]), (None, None)]
    return rows + [(105, w(30) + " " + p[20:240] + " " + p[20:240] + w(20))]


@pytest.mark.parametrize("few", [256, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(sd, "MOST_CONTEXTS", few)
    rows = _passages()
    assert sorted(map(tuple, sd.suffix_dedup(docs(spark, rows)).collect()), key=str) == _brute(rows)


def test_suffix_arrays_and_prefixes():
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 300, 900):
        d = r.integers(1, (4, 3000)[n % 2], n).astype(np.int32)
        order = sd.suffix_array(d)
        assert [d[i:].tolist() for i in order] == sorted(d[i:].tolist() for i in range(n))
        lcp = sd.common_prefixes(d, order, 50)
        for k in range(1, n):
            a, b = d[order[k - 1] :][:50].tolist(), d[order[k] :][:50].tolist()
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == same


def test_shards_find_each_others_windows():
    r = random.Random(1)
    text = bytes(r.choice(b"abcd") for _ in range(210))
    contexts = [text + bytes(r.choice(b"abcd") for _ in range(10)) for _ in range(9)] + [bytes(r.choice(b"abcd") for _ in range(220))]
    whole = sd.shard_windows([7] * 10, contexts)
    parts = sd.shard_windows([7] * 10, contexts, most=300)
    assert all((a == b).all() for a, b in zip(whole, parts)) and sum(map(sum, whole)) >= 99


def test_shards_of_near_copies_equal_brute_force():
    for seed in range(24):
        r = random.Random(seed)
        base = bytes(r.choice((b"ab", b"abcdefgh", b"a")[seed % 3]) for _ in range(r.randint(200, 420)))
        contexts = []
        for _ in range(r.randint(2, 30)):
            c = bytearray(base[r.randint(0, 60) : len(base) - r.randint(0, 40)])
            for _ in range(r.randint(0, 2)):
                if c:
                    c[r.randrange(len(c))] = r.choice(b"abz")
            contexts.append(bytes(c + c[: r.choice((0, 0, 300))]))
        count = collections.Counter(c[i : i + sd.W] for c in contexts for i in range(len(c) - sd.W + 1))
        for most in (1 << 17, 900):
            for c, mask in zip(contexts, sd.shard_windows([5] * len(contexts), contexts, most=most)):
                assert mask.tolist() == [count[c[i : i + sd.W]] > 1 for i in range(len(c) - sd.W + 1)]


@pytest.mark.parametrize("size", sd.CLASSES)
def test_shared_bytes_as_one_symbol_change_nothing(size):
    r, shared = random.Random(size), sd.shared_bytes(size)
    for seed in range(6):
        middle = [bytes(r.choice(b"ab") for _ in range(shared)) for _ in range(2)]
        keys, contexts, middles = [], [], []
        for k in range(40):
            left, right = r.randint(0, size - 1), r.randint(0, size - 1)
            if left + right < size - 1:
                left = size - 1 - right
            keys.append(k // 20)
            contexts.append(bytes(r.choice(b"ab") for _ in range(left)) + middle[k // 20] + bytes(r.choice(b"ab") for _ in range(right)))
            middles.append(left)
        plain = sd.shard_windows(keys, contexts)
        for most in (1 << 17, 60):
            assert all((a == b).all() for a, b in zip(plain, sd.shard_windows(keys, contexts, middles, shared, most)))


def test_every_window_has_one_anchor():
    r = np.random.default_rng(2)
    for data in (r.integers(97, 100, 1500).astype(np.uint8), np.full(500, 97, np.uint8), r.integers(0, 256, 199).astype(np.uint8)):
        pos, first, last = sd.anchors(data)
        n = max(0, len(data) - sd.W + 1)
        assert [w for a, b in zip(first, last) for w in range(a, b + 1)] == list(range(n))
        assert all(first >= pos - (sd.W - sd.GRAM)) and all(pos + sd.GRAM <= first + sd.W) and all(pos >= last)
