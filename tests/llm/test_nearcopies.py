from itertools import combinations

import numpy as np

from lexiweave.llm import nearcopies


def brute_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(texts):
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))
    for _ in range(6):
        for a, b in combinations(range(len(texts)), 2):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i for i, r in enumerate(root) if i == r}


def changed(text, places):
    w = text.split()
    for k in places:
        w[k] = f"new{k}"
    return " ".join(w)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)


def test_two_changed_words_make_a_near_copy(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (2, changed(text, [30, 70])), (3, changed(text, [5, 25, 45, 65, 85]))]
    assert {r.doc_id for r in nearcopies.keep_one(frame(spark, rows)).collect()} == {1, 3}


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 900, int(rng.integers(20, 200)))) for _ in range(25)]
    for t in texts[:18]:
        n = len(t.split())
        texts += [changed(t, rng.choice(n, k, replace=False)) for k in (1, 2, 3, 4, 6)]
        texts += [" ".join(t.split()[: int(n * share)]) for share in (0.95, 0.85, 0.75)]
    # most shingles the same, and so most bits of a fingerprint, but less than 0.8 of all
    texts += ["one two three four five " * 40 + texts[0][:60], "one two three four five " * 40 + texts[1][:60], "", None, "a b", "A  b", "a c"]
    docs = frame(spark, list(enumerate(texts)))
    got = nearcopies.keep_one(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == brute_kept(texts)


def test_rows_count_by_id_and_text(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "quite other words stand in here"), (None, "a b c d e f"), (None, "no id at all"), (None, "no id at all")]
    got = nearcopies.keep_one(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("5", "a b c d e f"), ("5", "quite other words stand in here"), ("None", "no id at all")]
    assert nearcopies.keep_one(frame(spark, rows).limit(0)).collect() == []


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(9)
    for n in (1, 20, 400, 9000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for k in (0, 1, n // 10, n):
            other = np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
            a = np.unique(base)
            bits = sum(int(x).bit_count() for x in (nearcopies.odd_sketch(a) ^ nearcopies.odd_sketch(other)).view(np.uint64).tolist())
            assert bits <= len(np.setxor1d(a, other)) and (k or bits == 0)


def test_large_group_of_texts_that_are_hardly_similar(spark):
    """Copies of one text that each change other words: some pairs are at 0.8, most just below."""
    rng = np.random.default_rng(10)
    base = " ".join(f"b{k}" for k in range(150))
    texts = [changed(base, rng.choice(150, int(rng.integers(1, 6)), replace=False)).replace("new", f"n{i}x") for i in range(90)]
    assert {r.doc_id for r in nearcopies.keep_one(frame(spark, list(enumerate(texts)))).collect()} == brute_kept(texts)


def random_pair(rng, n, share):
    """Two sets of n elements with a Jaccard similarity of `share` or a little more."""
    own = int(n * (1 - share) / (1 + share))
    common = rng.integers(0, 1 << 63, n - own, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(2)]


def test_majorities_count_every_hash():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 254, 255, 256, 511, 300_000, 7)]
    more = nearcopies.majorities(sets)
    for s, row in zip(sets, more):
        for k in (0, 6, len(row) // 64 - 1):
            x = nearcopies.mixed(s ^ nearcopies._MASKS[k])
            assert row[64 * k : 64 * k + 64].tolist() == [2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) - len(s) for b in range(64)]


def test_codewords_are_near_and_the_cheapest():
    from lexiweave.llm.simhash import Golay

    code, rng = Golay(), np.random.default_rng(6)
    more = nearcopies.majorities([np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 30, 31, 2000)])
    for row, found in zip(more, nearcopies.codewords(more)):
        for p in range(nearcopies.PARTS):
            votes = row[23 * p : 23 * p + 23]
            word = sum(1 << b for b in range(23) if votes[b] > 0)
            near, there = code.near(np.asarray([word]))
            against = {}
            for number in near[0][there[0]].tolist():
                whole = number << 11
                whole ^= int(code.low[whole & 0xFFF] ^ code.high[whole >> 12])
                assert (whole ^ word).bit_count() <= 4
                against[number] = sum(abs(int(votes[b])) for b in range(23) if (whole ^ word) >> b & 1)
            kept = [x for x in found[p].tolist() if x >= 0]
            assert len(set(kept)) == len(kept) == min(nearcopies.NEAR, len(against))
            assert sorted(against[x] for x in kept) == sorted(against.values())[: len(kept)]


def test_similar_sets_share_a_key_of_their_fingerprints():
    """Within 4 of 64 bits, op1's reach, are few pairs at 0.8."""
    rng = np.random.default_rng(8)
    for n, share, least in ((400, 0.8, 0.99), (60, 0.8, 0.99), (200, 0.9, 1), (200, 0.95, 1)):
        pairs = [random_pair(rng, n, share) for _ in range(400)]
        one, two = (nearcopies.majorities([p[k] for p in pairs]) for k in (0, 1))
        a, b = (set(zip(*(x.tolist() for x in nearcopies.keys(nearcopies.codewords(m))))) for m in (one, two))
        assert len({at for at, _ in a & b}) >= least * len(pairs)
        assert (((one > 0) != (two > 0))[:, :64].sum(1) <= nearcopies.CLOSE).all()
    parts = nearcopies.PARTS // 2
    halves = [nearcopies.keys(nearcopies.codewords(one), r) for r in (range(parts), range(parts, nearcopies.PARTS))]
    assert sorted(zip(*nearcopies.keys(nearcopies.codewords(one)))) == sorted(x for h in halves for x in zip(*h))


def test_large_group_of_near_copies_compares_few_pairs(spark, monkeypatch):
    """The pairs whose whole sets are compared grow with the texts, not with the pairs that share a key."""
    rng = np.random.default_rng(13)
    base = " ".join(f"b{k}" for k in range(150))
    texts = [changed(base, rng.choice(150, int(rng.integers(2, 6)), replace=False)).replace("new", f"n{i}x") for i in range(400)]
    compared, verified = [], nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, *rest: (compared.append(pairs.count()), verified(pairs, *rest))[1])
    assert {r.doc_id for r in nearcopies.keep_one(frame(spark, list(enumerate(texts)))).collect()} == brute_kept(texts)
    assert sum(compared) <= 3 * len(texts)


def test_keys_that_are_shared_by_chance_are_dropped_however_many_share_them():
    """Between the runs over 0.1 and 0.5 GB most of what was stored came from keys of three texts and more without any likeness."""
    import pyarrow as pa

    rng = np.random.default_rng(21)
    key = np.sort(np.concatenate([rng.integers(0, 400, 1500), np.full(300, 77), np.full(90, 12)]))
    bits = rng.integers(-(1 << 63), 1 << 63, len(key))
    for _ in range(150):  # some with likeness
        a = int(rng.integers(0, len(key) - 3))
        bits[a + int(rng.integers(1, 3))] = bits[a] ^ int(rng.integers(0, 1 << 20))
    want = []
    for k in np.unique(key):
        own = np.flatnonzero(key == k)
        most = nearcopies.CLOSE if len(own) == 2 else nearcopies.CLOSE_OF_MANY
        want += [int(a) for a in own if len(own) > nearcopies.MANY or any(a != b and ((int(bits[a]) ^ int(bits[b])) & (1 << 64) - 1).bit_count() <= most for b in own)]
    for size in (1, 7, 64, 5000):
        whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(key))), pa.array(bits)], names=["key", "node", "bits"])
        got = [x for b in nearcopies._close(whole.slice(k, size) for k in range(0, len(key), size)) for x in b.column(1).to_pylist()]
        assert got == want
    assert len(want) < 0.6 * len(key) and list(nearcopies._close([]))[0].num_rows == 0
