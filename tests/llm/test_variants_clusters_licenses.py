"""Spelling variants, centroid clusters and license scans against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import centroid_clusters as cc
from paperloom.llm import license_scan as ls
from paperloom.llm import spelling_variants as sv

# ---- spelling variants


def words_of(rows, least_chars=6, least_count=5, every=199):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_of(words, ratio=5):
    form = {}
    n_near = {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        n_near[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, n_near[w], form[w], words[form[w]] if form[w] else None, root))
    return out


def test_words_are_counted_after_the_deletions(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["Colour", "naïveté", "ÉTUDES", "harbour!", "short", "x" * 9, "kettle7kettles"]) for _ in range(40))) for i in range(60)]
    rows += [(None, "Colour " * 7), (3, None), (4, ""), (5, "abcdefg" * 40_000)] + [rows[0]] * 3
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, word string, run string").repartition(3)
    for every in (199, 3):
        assert {r["word"]: r["n"] for r in sv.corpus_words(df, every=every).collect()} == words_of(rows, every=every)
    assert sv.corpus_words(df.limit(0)).count() == 0


def test_variants_equal_brute_force(spark):
    r = random.Random(2)
    words = {}
    for _ in range(60):
        word = "".join(r.choice("abé") for _ in range(r.randint(1, 7)))
        words[word] = r.choice([5, 5, 6, 25, 30, 130, 700])
        for _ in range(r.randint(0, 6)):
            i = r.randrange(len(word) + 1)
            other = r.choice([word[:i] + r.choice("abé") + word[i:], word[:i] + word[i + 1 :], word[:i] + "z" + word[i + 1 :]])
            words.setdefault(other, r.choice([5, 7, 25, 26, 125, 650]))
    words |= {"": 3, "𝒳yz": 9, "𝒴yz": 90, "yz": 900}
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()] + [(None, 4, "x", 1)], "word string, n long, other string, at int").repartition(3)
    got = [tuple(x) for x in sv.spelling_variants(df).collect()]
    assert len(got) == len(words) and set(got) == variants_of(words)
    assert sv.spelling_variants(df.limit(0)).count() == 0


def test_a_long_chain_of_forms_ends_at_its_last_word(spark):
    chain = ["abcdef"[:5] + "x" * i for i in range(1, 12)]
    df = spark.createDataFrame([(w, 6**i) for i, w in enumerate(chain)], "word string, n long")
    assert {r["root"] for r in sv.spelling_variants(df).collect()} == {chain[-1]}
    with pytest.raises(ValueError):
        sv.spelling_variants(df, ratio=1)


def test_a_full_group_makes_no_pairs(spark):
    """All letters at one position: one row a member, whatever the group's size."""
    df = spark.createDataFrame([("stem" + chr(0x4E00 + i), i + 1) for i in range(3000)], "word string, n long")
    assert sv._replaced(df).count() == 3000
    got = sv.spelling_variants(df).collect()
    most = "stem" + chr(0x4E00 + 2999)
    assert {r["n_near"] for r in got} == {2999} and all(r["form"] == (most if 5 * r["n"] <= 3000 else None) for r in got)


# ---- centroid clusters


def clusters_of(rows, k, rounds, dimensions):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        told = [min((distance(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, own) in zip(kept, told) if own == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    sums = collections.Counter()
    for d, j in told:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for (i, _), (d, j) in zip(kept, told)), key=repr)


@pytest.mark.parametrize(("scale", "offset"), [(1.0, 0.0), (1.0, 3e6), (40.0, 2.0**45)])
def test_clusters_equal_brute_force(spark, scale, offset):
    r = random.Random(5)
    centre = [[r.uniform(-1, 1) * scale for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.2) * scale for x in r.choice(centre)]) for i in range(400)]
    rows += [(i, [round(r.uniform(-1, 1)) * scale] * 8) for i in range(400, 480)]  # many ties
    rows = [(i, [x + offset for x in v]) for i, v in rows]
    bad = [(500, None), (501, []), (502, [1.0] * 7), (503, [1.0] * 7 + [None]), (504, [float("nan")] * 8), (505, [float("inf")] + [0.0] * 7)]
    rows += [rows[3]] * 5 + [(None, rows[9][1])] + bad
    df = spark.createDataFrame([(i, v, "x", 3, 1.5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int, upper double").repartition(3)
    got = cc.centroid_clusters(df, k=5, dimensions=8).collect()
    assert sorted(map(tuple, got), key=repr) == clusters_of(rows, 5, 3, 8)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "vec_id long, embedding array<float>")
    got = cc.centroid_clusters(df, dimensions=2).collect()
    assert len({r["cluster"] for r in got}) == 3 and {r["inertia"] for r in got} == {0}
    none = cc.centroid_clusters(df)
    assert none.count() == 0 and none.columns == cc.centroid_clusters(df, dimensions=2).columns


def test_bounds_skip_distances_and_change_nothing():
    r = np.random.default_rng(7)
    centres = r.integers(-400, 400, (8, 16))
    x = centres[r.integers(0, 8, 3000)] + r.integers(-20, 20, (3000, 16))
    old = x[:8].astype(np.int64)
    state = cc.assign(x, old, None, None)
    for _ in range(6):
        new = np.stack([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else old[j] for j in range(8)])
        state = cc.assign(x, new, state[:3], cc.shifts(old, new))
        plain = cc.assign(x, new, None, None)
        assert (state[0] == plain[0]).all() and (state[1] >= plain[1] / cc._UP).all() and (state[2] <= plain[2]).all()
        old = new
    assert state[3] < plain[3] / 4


# ---- license scans


def licenses_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts = [(i, label) for label, phrase in ls.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base, best = {label for _, label in starts}, 0.0
    labels = set(base)
    for i in range(0, max(1, len(words)), ls.BLOCK_WORDS // 2):
        block = set(words[i : i + ls.BLOCK_WORDS])
        for label, template in ls.TEMPLATES:
            tokens = set(template.split())
            share = len(tokens & block) / len(tokens)
            if share >= ls.LEAST_SHARE - 1e-12:
                labels.add(label)
                best = max(best, share)
    at = [i for i, _ in starts]
    return len(words), len(starts), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


def test_licenses_equal_brute_force(spark):
    r = random.Random(11)
    common = [t for _, text in ls.TEMPLATES for t in text.split()] + ["wort", "été", "7", "MIT", "x_y"]
    texts = [None, "", "Under the MIT License", "under the mit license under the mit license", "CC-BY-NC cc by nc. CC BY NC", "Apache License, Version 2.0 and (cc-by-nc)", "underthe mit license", "\x00\x7f~", "éunder the mit license"]
    for _, text in ls.TEMPLATES:
        words = text.split()
        for drop in (0, 1, 2, 3):
            left = [w for i, w in enumerate(words) if i not in r.sample(range(len(words)), min(drop, len(words) - 1))]
            r.shuffle(left)
            texts.append(" ".join(["lorem"] * r.randint(0, 70) + left + ["ipsum"] * r.randint(0, 90)))
    texts += [" ".join(r.choice(common) for _ in range(n)) for n in (1, 31, 32, 33, 63, 64, 65, 95, 96, 97, 400, 3000)]
    texts += ["word " * 200_000 + "released under the MIT license, under the MIT license " + "word " * 50, texts[2], texts[2]]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, "under the mit license", "x", 1, "y")], "doc_id long, text string, words string, rid int, labels string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in ls.license_scan(df).collect()}
    assert len(got) == len(texts) + 1 and got[None] == licenses_of("under the mit license")
    for i, t in enumerate(texts):
        want = licenses_of(t)
        assert got[i][:-1] == want[:-1] and abs(got[i][-1] - want[-1]) < 1e-12, (i, t and t[:80])
    assert ls.license_scan(df.limit(0)).count() == 0


def test_templates_and_phrases_are_checked(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        ls.license_scan(df, templates=[("long", "w " * 40)])
    with pytest.raises(ValueError):
        ls.license_scan(df, phrases=[("own", "a b a")])
    got = ls.license_scan(df, templates=[], phrases=[]).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, None, None, "", "", 0.0)]


def test_the_license_scan_runs_no_python(spark):
    plan = ls.license_scan(spark.createDataFrame([(1, "a b")], "doc_id long, text string").filter(F.col("doc_id") > 0))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
