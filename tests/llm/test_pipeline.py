import collections
import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from paperloom.llm.bpe import read_ranks
from paperloom.llm.simhash_dedup import fingerprint


def _documents():
    r = random.Random(9)
    letters = {"aa": "abcdef", "bb": "klmnop"}
    rows = []
    for i in range(120):
        lang = r.choice(list(letters))
        words = ["".join(r.choice(letters[lang]) for _ in range(r.randint(2, 7))) for _ in range(r.randint(8, 60))]
        rows.append([i, " ".join(words), lang, f"s{i % 3}"])
    rows[10][1] = rows[11][1] = rows[12][1]
    near = rows[20][1].split() * 4
    rows[20][1] = " ".join(near)
    near[5] = "aaaa"
    rows[21][1] = " ".join(near)
    rows += [[200, None, "aa", "s0"], [201, "123", None, None], [202, "", "bb", "s1"], [203, "abc fed cab", None, None]]
    return [(*x, len(x[1] or "")) for x in rows]


def test_stages_do_what_they_say(spark, tmp_path):
    rows = _documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    text = {r[0]: r[1] for r in rows}
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == list(cp.COLUMNS)
        kept.append(collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    lang, exact, near, mix, coded = kept
    assert set(text) - set(lang) == {200, 201, 202}
    want = {}
    for i in sorted(lang):
        want[text[i]] = i
    assert set(exact) == set(want.values()) and max(exact.values()) == 1
    groups = []
    for i in sorted(exact):
        close = [g for g in groups if any((fingerprint(text[i]) ^ fingerprint(text[j])).bit_count() <= 4 for j in g)]
        groups = [g for g in groups if g not in close] + [sum(close, []) + [i]]
    assert set(near) == {min(g) for g in groups} and (20 in near) and 21 not in near
    assert set(mix) <= set(near) and max(mix.values()) <= 2 and coded == mix
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in docs.collect():
        assert r["n_tokens"] == len(encoding.encode_ordinary(text[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert cp.run(spark, str(tmp_path)).count() == sum(mix.values())


def _jaccard(a, b, words=5):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}

    a, b = of(a), of(b)
    return len(a & b) / len(a | b)


def test_near_dedup_stage_equals_brute_force_jaccard(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    rows = []
    for i in range(0, 90, 3):
        w = [word() for _ in range(r.choice((3, 40, 90, 200)))]
        for k in range(3):
            copy = list(w)
            for _ in range(r.randint(0, 1 + len(w) // 45) if k else 0):
                copy[r.randrange(len(w))] = word()
            rows.append((i + k, " ".join(copy) + (" " + line if i % 2 else ""), "aa", "s", 1))
    rows += [(90, None, "aa", "s", 0), (91, " ", "aa", "s", 0), (92, rows[5][1].upper(), "aa", "s", 1)]
    r.shuffle(rows)
    label, far = {x[0]: x[0] for x in rows}, 0
    for a in rows:
        for b in rows:
            if a[0] < b[0] and _jaccard(a[1], b[1]) >= 0.8:
                far += (fingerprint(a[1] or "") ^ fingerprint(b[1] or "")).bit_count() > 4
                least, most = sorted((label[a[0]], label[b[0]]))
                label = {i: least if x == most else x for i, x in label.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = cp.near_dedup_stage(spark, docs, "").collect()
    assert sorted(x["doc_id"] for x in got) == sorted(set(label.values()))
    assert far > 10 and len(set(label.values())) < 80


def test_stages_decide_by_row_where_ids_repeat_or_are_null(spark, tmp_path):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    a, b, c, d = (text(60) for _ in range(4))
    rows = [(None, a), (None, a + " more"), (5, b), (5, c), (1, c + " more"), (None, d), (7, d + " more")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows, source: spark.createDataFrame([(i, t, "aa", source, len(t)) for i, t in rows], schema).repartition(3)
    got = sorted((x["text"] for x in cp.near_dedup_stage(spark, frame(rows, "s"), "").collect()))
    assert got in (sorted([x, b, c + " more", d + " more"]) for x in (a, a + " more"))
    rows = [(r.choice([1, 2, 3, None]), text(n)) for n in range(1, 60)]
    docs = frame(rows, "s0").unionByName(frame([(i, t + " z") for i, t in rows], "s1")).unionByName(frame([(9, text(900))], "s2"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = collections.Counter()
    for x in cp.pareto_mix(docs).collect():
        want[x["doc_id"], x["source"], x["size"]] += x["copies"]
    got = collections.Counter((x["doc_id"], x["source"], len(x["text"].split())) for x in cp.mixing_stage(spark, docs, "").collect())
    assert got == +want
    assert len({n for (i, s, _), n in want.items() if i == 1 and s == "s0"}) > 1 or len({n for (i, s, _), n in want.items() if i == 1 and s == "s1"}) > 1
