from itertools import combinations

import numpy as np
from xxhash import xxh64_intdigest

from lexiweave.llm import simhash
from lexiweave.llm.components import components


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(x) for x in range(len(prints))]


def test_fingerprint():
    for t in ["", None, "one", "A b C", "a b c d", "a b c d e É", "x  y\tz\n\x0bw " * 9, " non\xa0break space a b c d", "w " * 5000]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_code_finds_all_words_within_one_and_two_bits():
    code = simhash.Golay()
    patterns = [{p for p in row if p >= 0} for row in code.patterns.tolist()]
    assert sorted({len(p) for p in patterns}) == [1, 6]
    syndrome = lambda e: int(code.low[e & 0xFFF] ^ code.high[e >> 12])
    for weight in (1, 2):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            s = syndrome(e)
            for k in range(1 << 11):
                if weight == 1:
                    assert int(code.patterns[k, 0]) ^ e in patterns[k ^ s]
                assert any(p ^ e in patterns[k ^ s] for p in patterns[k])


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    other = base.copy()
    for k in range(400):
        for b in rng.choice(64, k % 5, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)

    def by_print(values):
        out = {}
        for at, key, own in zip(*(x.tolist() for x in simhash.keys(values))):
            out.setdefault(at, {})[key] = own
        return out

    for x, y in zip(by_print(base).values(), by_print(other).values()):
        assert any(x[k] or y[k] for k in x.keys() & y.keys())


def test_components(spark):
    rng = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 101 + i) for i in range(200)]
    some = [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (60, 2))]
    links = path + star + some + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for link in links if link[0] != link[1] for n in link}
    for _ in range(200):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(25)]
    for t in texts[:12]:
        for _ in range(6):
            w = t.split()
            w[int(rng.integers(len(w)))] = "changed"
            texts.append(" ".join(w))
    texts += ["", None, texts[0], texts[0], "one two", "ONE two"]
    got = {r.doc_id: r for r in simhash.groups(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp long")).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints)


def test_many_near_copies_make_few_rows(spark):
    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 1 << 62))
    prints = {base}
    while len(prints) < 600:
        prints.add(base ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(1, 4)), replace=False)))
    found = simhash.linked(spark.createDataFrame([(p, 0) for p in prints], "fp long, first long"), 4).collect()
    assert {r.root for r in found} == {min(prints)} and len(found) == len(prints)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "other words here now")], "doc_id long, text string")
    assert sorted((r.component_id for r in simhash.groups(docs).collect())) == [5, 5, 5, 9]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["5", "9", "None"]
    assert simhash.groups(docs.limit(0)).collect() == [] == simhash.keep_one(docs.limit(0)).collect()
