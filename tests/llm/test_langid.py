import zlib

import numpy as np

from lexiweave.llm import langid

WORDS = {"en": "the of and with that thing shall", "de": "der und schon nicht über größer mit", "fr": "le et être déjà où ça sont", "es": "el y niño más señor qué son", "qq": "zxq qzx xqz zzq"}


def documents(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[k].split(), int(rng.integers(3, 40)))), k) for i, k in enumerate(rng.choice(list(WORDS), n))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string").repartition(4)


def test_held_out_accuracy_and_flags(spark):
    rows = documents(400)
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i, _, _ in rows)
    out = [(got[i].lang_pred, k) for i, _, k in rows if got[i].held_out]
    assert np.mean([a == b for a, b in out]) > 0.98 and len(out) > 50


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark):
    rows = documents(200)
    changed = [(i, t, "en" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows]
    pick = lambda x: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(frame(spark, x)).collect())
    assert pick(rows) == pick(changed)


def test_edges(spark):
    rows = documents(80) + [(900, None, "en"), (901, "", "en"), (902, "123 ... !?", "fr"), (None, "the of and", None), (903, "le et " * 30_000, None), (904, "É", None)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows)).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "fr" and got[None].lang_pred == "en" and got[None].held_out is False and got[904].lang_pred in WORDS
    kept = langid.only_known(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score", "lang_pred"] and {r.doc_id for r in kept.collect()} & {900, 901, 902} == set()
    assert langid.identify(frame(spark, []).limit(0)).collect() == []
    unlabelled = [(1, "some words", None), (2, "others", None)]
    assert {r.lang_pred for r in langid.identify(frame(spark, unlabelled)).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "the", "en"), (5, "of the", "en")])).collect()} == {"en"}


def test_sample_is_bounded_and_even(spark):
    rows = documents(300)
    assert [r.lang_pred for r in langid.identify(frame(spark, rows), per_language=5).collect()] and langid.train(frame(spark, rows), per_language=3) is not None


def test_copies_do_not_shrink_the_sample(spark):
    others = [(i, t, k) for i, (t, k) in enumerate([(f"{t} a{i}", k) for i, t, k in documents(60) if k in ("en", "fr")])]
    rows = others + [(1000 + i, "le et être déjà où ça sont toujours la même chose", "fr") for i in range(8000)]
    model = langid.train(frame(spark, rows), per_language=20)
    assert sorted({k for own in model.members.values() for k in own}) == ["en", "fr"]
    few = langid.sample(frame(spark, rows), per_language=20)
    want = min(20, len({t for _, t, k in rows if k == "fr"}))
    assert sum(r.lang == "fr" for r in few) == want


def test_junk_with_letters_goes_and_short_clean_text_stays(spark):
    rows = documents(400, seed=2)
    rng = np.random.default_rng(8)
    codes = ["ru", "lt", "fi", "cy", "tr", "hi", "he", "zh", "id"]  # a family each: shares get small
    made = {k: ["".join(chr(int(c)) for c in rng.integers(0x400 + 40 * i, 0x400 + 40 * i + 12, 5)) for _ in range(8)] for i, k in enumerate(codes)}
    rows += [(1000 + 40 * i + j, " ".join(rng.choice(made[k], 12)), k) for i, k in enumerate(codes) for j in range(40)]
    trash = ["".join(chr(int(c)) for c in rng.integers(97, 123, 60)) for _ in range(20)] + ["kjxw vqpz bbfg wqkj zxcv mnbq pfgh tplk wvxz gkqp"]
    short = ["the of and", "der und schon", "le et être", "el y niño", "with that", "the", "De.", *[" ".join(w[:3]) for w in made.values()]]
    extra = [(5000 + i, t, None) for i, t in enumerate(trash)] + [(6000 + i, t, None) for i, t in enumerate(short)]
    kept = {r.doc_id for r in langid.only_known(frame(spark, rows + extra)).collect()}
    assert not kept & set(range(5000, 5000 + len(trash))) and kept >= set(range(6000, 6000 + len(short)))
    assert len(kept & {r[0] for r in rows}) >= 0.99 * len(rows)


def test_no_language_is_left_out_however_many_or_repeated(spark):
    rng = np.random.default_rng(3)
    made = {f"x{k:03d}": [chr(0x4E00 + 30 * k + j) for j in range(25)] for k in range(250)}
    rows = [(10 * n + j, " ".join("".join(rng.choice(w, 3)) for _ in range(12)), k) for n, (k, w) in enumerate(made.items()) for j in range(4)]
    # thirty thousand rows of ten texts, next to a language of few rows
    some = [" ".join(rng.choice(WORDS["fr"].split(), 15)) for _ in range(10)]
    rows += [(10_000 + i, some[i % 10], "fr") for i in range(30_000)] + [(60_000 + i, t, k) for i, (_, t, k) in enumerate(documents(120)) if k == "en"]
    few = langid.sample(frame(spark, rows), per_language=5)
    assert {r.lang for r in few} == {k for _, _, k in rows} and sum(r.lang == "fr" for r in few) == 5
    model = langid.train(frame(spark, [r for r in rows if r[2] in ("fr", "en", "x000", "x001")]), per_language=20)
    assert sorted(k for own in model.members.values() for k in own) == ["en", "fr", "x000", "x001"]


def test_a_machine_minimises_its_loss():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(60, 6)))
    y = np.where(x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=60) > 0.2, 1.0, -1.0)
    w = langid.machine(x, y, c=10.0, rounds=2000)
    share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    xb, v = np.hstack([x, np.ones((60, 1))]), np.zeros(7)
    for _ in range(200):  # Newton's method on the primal: |v|^2 / 2 + sum of c * share * max(0, 1 - margin)^2
        gap = np.maximum(0, 1 - y * (xb @ v))
        active = xb[gap > 0]
        hessian = np.eye(7) + 2 * 10 * (active.T * share[gap > 0]) @ active
        v = v - np.linalg.solve(hessian, v - 2 * 10 * xb.T @ (share * y * gap))
    assert np.allclose(w, v, atol=1e-3)


def test_clashing_names(spark):
    rows = [(i, t, k, "a", "b", 1.0) for i, t, k in documents(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, _lang string, _SCORE double")
    kept = langid.only_known(docs)
    assert kept.columns == docs.columns and {r._text for r in kept.collect()} == {"a"}
