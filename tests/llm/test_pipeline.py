import numpy as np
import pytest

from . import test_decontam, test_simhash, test_substring, test_tokens

pipeline = pytest.importorskip("corpus_pipeline")


def corpus(tmp_path, spark):
    rng = np.random.default_rng(12)
    words = {"en": "the of and with that thing shall be it".split(), "fr": "le et être déjà où ça sont une".split()}
    make = lambda k, n: " ".join(w + str(int(rng.integers(30))) * int(rng.integers(2)) for w in rng.choice(words[k], n))
    rows = []
    for i in range(70):
        k = "en" if i % 3 else "fr"
        rows.append([i, make(k, int(rng.integers(20, 160))), k])
    passage = make("en", 60)
    items = [(1, make("en", 30)), (2, make("fr", 20)), (3, "short item")]
    for i in (11, 20, 31):
        rows[i][1] += "\n" + passage
    filler, other = make("en", 1200).split(), make("en", 1200).split()
    probe = items[0][1].split()
    rows += [[107, " ".join(filler[:600] + probe[5:18] + filler[600:]), "en"], [108, " ".join(other[:600] + ["zz"] + probe[5:17] + ["zz"] + other[600:]), "en"]]
    rows += [[100, rows[3][1], "fr"], [101, rows[4][1], "en"], [102, "12345 67890", "en"], [103, None, None], [104, rows[5][1][:80] + " " + items[0][1], "en"], [105, passage, "en"], [106, items[1][1], "fr"]]
    spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_against_brute_force(spark, tmp_path):
    rows, items = corpus(tmp_path, spark)
    docs = {r.doc_id: r.text for r in pipeline.language_id(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert set(docs) == {r[0] for r in rows} - {102, 103}
    ids = sorted(docs)
    root = test_simhash.brute_components([test_simhash.brute_fingerprint(docs[i]) for i in ids])
    docs = {i: docs[i] for k, i in enumerate(ids) if root[k] == k}
    assert 100 not in docs and 101 not in docs
    gone = test_substring.brute(list(docs.items()), 50)
    cut = {r.doc_id: r.text for r in pipeline.substring_dedup(spark, spark.createDataFrame([(i, t, "x", "y", 0) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).collect()}
    assert set(cut) == {i for i, (n, k, _) in gone.items() if n != k or not n} and 105 not in cut
    assert all(len(cut[i].split()) == gone[i][0] - gone[i][1] for i in cut)
    bad = {r[0] for r in test_decontam.brute(list(cut.items()), items) if r[5]}
    assert bad and {104, 106} & set(cut) <= bad
    words = {i: test_decontam.cut(t) for i, t in cut.items()}
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [test_decontam.cut(t)] for k in range(len(w) - 12)}
    bad |= {i for i, w in words.items() if windows & {tuple(w[k : k + 13]) for k in range(len(w) - 12)}}
    assert 107 in bad and 108 not in bad
    from lexiweave.llm import tokens

    library = __import__("tokenizers").Tokenizer.from_file(tokens.default_tokenizer())
    want = sum(len(test_tokens.ids_of(library, cut[i])) + 1 for i in cut if i not in bad)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(cut) - bad and sum(r.length for r in got) == want


def test_stages_keep_columns(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
