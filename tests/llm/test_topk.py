import math

import numpy as np

from lexiweave.llm import common, topk


def brute(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        v = min(u for i, u in good if i == q)
        best = [(i, sum(a * b for a, b in zip(u, v))) for i, u in good if i != q and len(u) == len(v)]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best, key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, k=k).collect())


def f32(x):
    return [float(np.float32(v)) for v in x]


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, f32(rng.normal(0, 0.2, 8))) for i in range(700)]
    same = rows[13][1]
    rows += [(1000 + i, same) for i in range(300)]
    rows += [(2000, None), (2050, []), (2100, [1.0, None] * 4), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8), (2250, [0.5] * 3), (2251, [0.25] * 3), (None, same), (50, rows[50][1]), (3000, [0.0] * 8)]
    assert run(spark, rows) == brute(rows, 5)


def test_small_shards(spark, monkeypatch):
    import lexiweave.llm.topk as m

    rng = np.random.default_rng(9)
    rows = [(i, f32(np.round(rng.normal(0, 0.02, 4), 2))) for i in range(900)]
    rows += [(5000 + i % 7, f32(np.round(rng.normal(0, 0.1, 4), 2))) for i in range(60)] + [(6000 + i, [0.02] * 4) for i in range(400)]
    monkeypatch.setattr(m, "SHARD", 90)
    assert run(spark, rows, k=7) == brute(rows, 7)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert run(spark, rows, k=3) == brute(rows, 3)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 200, (20, 6))
    v = np.floor(np.concatenate([c + rng.normal(0, 3, (100, 6)) for c in centres]))
    tree = topk.Tree(np.arange(2000), v)
    asked = np.arange(0, 2000, 97)
    for known in (-np.inf, 1.0):
        got = tree.best(asked, v[asked], 5, np.full(len(asked), known))
        for q, (scores, ids) in zip(asked.tolist(), got):
            s = (v @ v[q]).astype(int)
            order = sorted((i for i in range(2000) if i != q and s[i] >= known), key=lambda i: (-s[i], i))[:5]
            assert list(zip(scores.tolist(), ids.tolist())) == [(int(s[i]), i) for i in order]


def test_bounds_and_cells():
    rng = np.random.default_rng(2)
    v, q = rng.normal(0, 1, (500, 5)), rng.normal(0, 1, (40, 5))
    assert (topk.bounds(q, v.min(axis=0)[None], v.max(axis=0)[None])[:, 0] >= (q @ v.T).max(axis=1)).all()
    cells = topk.cell_of(v, topk.planes(v, 8))
    assert len(set(cells.tolist())) == 8 and np.bincount(cells).max() < 100
    assert topk.planes(np.ones((9, 3)), 4) is None and (topk.cell_of(np.ones((9, 3)), None) == 1).all()


def test_large_components():
    v = np.floor(np.array([[2.0**40, 1], [2.0**20, 3], [-(2.0**30), 5]]))
    ((scores, ids),) = topk.Tree(np.arange(3), v).best(np.array([9]), np.array([[3.0, 2.0**35]]), 2, np.array([-np.inf]))
    assert list(zip(scores.tolist(), ids.tolist())) == [(3 * 2**40 + 2**35, 0), (5 * 2**35 - 3 * 2**30, 2)]
