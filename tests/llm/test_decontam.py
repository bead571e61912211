import hashlib
import re

import numpy as np

from lexiweave.llm import common, decontam


def cut(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=13):
    out = []
    for i, t in docs:
        w, hit, ids = cut(t), set(), set()
        for item, text in items:
            b = cut(text)
            n = min(size, len(b))
            for s in range(len(b) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == b[s : s + n]:
                        hit.update(range(k, k + n))
                        if item is not None:
                            ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item long, words string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, len int")
    return sorted((tuple(r) for r in decontam.contamination(d, b).collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "été", "the", "The"] * 6
    word = lambda n: rng.choice(vocabulary, n).tolist()
    items = [(k, " ".join(word(int(n)))) for k, n in enumerate(rng.integers(10, 40, 12))] + [(20, "The, the"), (21, ""), (22, None), (23, "..!"), (None, "w1 w2"), (25, "w3 w4 w5")]
    items += [(30, items[0][1]), (30, items[0][1])]
    docs = []
    for k in range(60):
        parts = [word(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            b = items[int(rng.integers(12))][1].split()
            a = int(rng.integers(0, len(b)))
            parts += [b[a : a + int(rng.integers(5, 40))], word(int(rng.integers(0, 20)))]
        docs.append((k, "; ".join(" ".join(p) for p in parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (None, items[1][1]), (103, items[1][1]), (103, items[1][1]), (104, "the " * 500), (105, items[2][1][4:])]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs, items = [(1, "one two three four"), (2, "x two three y")], [(5, "two three")]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert run(spark, docs, items) == brute(docs, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red a b blue c"), (2, "blue x y z q red"), (3, "red red")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Red blue")], "item_id long, text string")
    assert [tuple(r) for r in decontam.proximity(docs, items, within=4).collect()] == [(1, 7, 0)]


def test_clean(spark):
    filler = [f"f{k}" for k in range(1200)]
    item = " ".join(f"b{k}" for k in range(30))
    passage = item.split()[9:22]  # 13 words of the item
    long_ = [" ".join(filler[:700] + passage + filler[700:]), " ".join(filler[:700] + passage[:12] + filler[700:])]
    docs = [(1, long_[0]), (2, long_[1]), (3, "one two three"), (4, "one two " + " ".join(filler[:60])), (5, "other"), (6, None), (7, "")]
    docs += [(None, long_[0]), (None, "other"), (5, long_[0]), (5, "other"), (8, "x " * 30_000), (9, "x " * 30_000 + item)]
    names = "doc_id long, text string, _id int, _t string, _d string, item string, words string, full string"
    df = spark.createDataFrame([(*r, 1, "t", "d", "i", "w", "f") for r in docs], names).repartition(3)
    items = spark.createDataFrame([(7, item), (8, "one two")], "item_id long, text string")
    kept = decontam.clean(df, items)
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    windows = {tuple(cut(item)[s : s + 13]) for s in range(18)}
    full = {(i, t) for i, t in docs if windows & {tuple(w[k : k + 13]) for w in [cut(t)] for k in range(len(w) - 12)}}
    bad = {r[0] for r in brute([(k, t) for k, (_, t) in enumerate(docs)], [(7, item), (8, "one two")]) if r[5]}
    assert kept.columns == df.columns
    assert got == sorted((str(i), t or "") for k, (i, t) in enumerate(docs) if k not in bad and (i, t) not in full)
    assert {("1", long_[0]), ("None", long_[0]), ("9", docs[-1][1]), ("3", "one two three")} & set(got) == set() and ("2", long_[1]) in got and got.count(("5", "other")) == 2
    assert decontam.clean(df.limit(0), items).collect() == [] and decontam.clean(df, items.limit(0)).count() == len(docs)
