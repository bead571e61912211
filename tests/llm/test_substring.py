import hashlib
import re

import numpy as np
import pytest

from lexiweave.llm import substring


def brute(rows, window):
    first = {}
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in cut:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_hashes():
    for t in ["", None, "a", "a b", " été  ÉTÉ a\tb\n", "x" * 3000 + " y"]:
        assert len(substring.word_hashes(t)) == len((t or "").encode().split())
    a, b = substring.word_hashes("one two three two one"), substring.word_hashes("two  three")
    assert a[1] == a[3] == b[0] and a[0] == a[4] and a[2] == b[1] and len(set(a.tolist())) == 3
    r = substring.rolling(substring.word_hashes("a b c a b d b c a b"), 2).tolist()
    assert r[0] == r[3] == r[8] and r[1] == r[6] and len(set(r)) == 5
    assert len(substring.rolling(a, 9)) == 0


@pytest.mark.parametrize("window", [4, 7, 50])
def test_against_brute_force(spark, window):
    rng = np.random.default_rng(window)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ü"]
    word = lambda n: " ".join(rng.choice(vocabulary, n))
    passages = [word(window + int(k)) for k in rng.integers(-1, 40, 8)]
    texts = []
    for k in range(90):
        parts = [word(int(n)) for n in rng.integers(0, 80, 3)]
        for _ in range(int(rng.integers(0, 3))):
            parts.insert(int(rng.integers(0, len(parts))), passages[int(rng.integers(8))])
        texts.append((" " if k % 2 else "\n").join(parts))
    texts += [texts[3], texts[4] + " more", "", None, "x " * 300, "x " * 200, (passages[0] + " ") * 5]
    rows = list(enumerate(texts))
    order = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(rows[k][0], rows[k][1], 0, "u") for k in order], "doc_id long, text string, row long, places string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, window=window).collect()}
    assert got == brute(rows, window)


def test_small_flushes(spark, monkeypatch):
    rows = [(i, " ".join(f"v{(i * 7 + k) % 40}" for k in range(60))) for i in range(30)]
    expected = brute(rows, 50)
    monkeypatch.setattr(substring, "FLUSH_WORDS", 100)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_edges(spark):
    text = " ".join(f"t{k}" for k in range(70))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text + " end"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substring.remove_repeats(docs).collect()) == [("4", 0), ("4", 0), ("9", 70), ("None", 0), ("None", 0)]
    assert substring.remove_repeats(docs.limit(0)).collect() == []
    left = substring.without_repeats(docs.withColumn("n_chars", docs.doc_id))
    assert [(r.text, r.n_chars) for r in left.where("doc_id = 9").collect()] == [("end", 3)] and left.columns == ["doc_id", "text", "n_chars"]


def brute_rows(rows, window):
    """As brute, for rows that may share a doc_id: each by its own text; a list in the order of rows."""
    first, cut = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in cut:
        gone = {p for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out.append(" ".join(x for k, x in enumerate(w) if k not in gone) if gone else None)
    return out


def test_rows_that_share_an_id_are_cut_by_their_own_texts(spark):
    t = [f"t{k}" for k in range(60)]
    other = " ".join(f"u{k}" for k in range(80))
    rows = [(1, " ".join(t)), (4, " ".join([*t, "alpha"])), (4, "four other words here"), (4, other), (4, other + " " + " ".join(t)), (4, ""), (4, None)]
    rows += [(7, other), (7, " ".join([*t[5:], *other.split()[3:70]])), (None, other), (2, "v " * 200), (2, "v " * 120), (5, "v " * 90 + "w"), (5, "z " * 30 + "v " * 51)]
    rows += [(9, " ".join(t[:55]) + " " + f"x{k}") for k in range(3)]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, "k") for r in rows], "doc_id long, text string, n_chars long, _id int, _kept string").repartition(5)
    want = brute_rows(rows, 50)
    got = substring.without_repeats(df)
    left = [(str(i), t if k is None else k) for (i, t), k in zip(rows, want) if k != ""]
    assert got.columns == df.columns
    assert sorted(((str(r.doc_id), r.text) for r in got.collect()), key=str) == sorted(left, key=str)
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


class Frame:
    """Stands for a DataFrame; gives the function that mapInArrow gets."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def peak(run, batches):
    """Bytes that a task's function holds at most, besides its input and what it has sent."""
    import tracemalloc

    tracemalloc.start()
    try:
        for _ in run(iter(batches)):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_task_that_packs_probes(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(words, 1000)) for _ in range(300)]
    monkeypatch.setattr(substring, "FLUSH_WORDS", 300_000)
    docs = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([k + 1000]), pa.array([t])], names=["doc_id", "row", "text"]) for k, t in enumerate(texts)]
    run = substring._blocks(Frame(), 25, 50)
    list(run(iter(docs)))  # imports and powers stay
    assert peak(run, docs) < 70 * 300_000
    # every window of every text
    met = [[(k, k + 1000, t, np.arange(976, dtype=np.uint32))] for k, t in enumerate(texts)]
    monkeypatch.setattr(substring, "_meet", lambda *a: Frame())
    monkeypatch.setattr(substring, "_met", lambda batches: batches)
    run = substring._candidates(Frame(), None, 25, 50, 50)
    list(run(iter(met)))
    assert peak(run, met) < 95 * 300_000


def test_very_long_texts(spark):
    rng = np.random.default_rng(5)
    long_ = [f"w{k}" for k in rng.integers(0, 9000, 25_000)]
    rows = [(1, " ".join(long_)), (2, " ".join(long_[12_000:13_000])), (3, " ".join([*long_[20_000:20_060], "x", *long_[:49]])), (4, " ".join(reversed(long_)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 50)
