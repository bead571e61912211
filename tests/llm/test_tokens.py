import zlib

import numpy as np
import pytest

from lexiweave.llm import packing, tokens, tokenstore

TEXTS = ["The cat's whiskers  twitched.\n\n It was 12:30!", "", None, "x", "été à Zürich ½ 三十 日本語   　z", "emoji 😀😀 family", "a " * 3000, "same text", "same text", "<|endoftext|> within", "\x1c\x1d odd", "tab\tnew\r\nline   "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_a_worker_lets_go_of_the_tokenizer_in_tasks_of_others():
    import gc
    import weakref

    from lexiweave.llm.common import trimmed

    path = tokens.default_tokenizer()
    held = weakref.ref(tokens.packed(path))
    assert list(trimmed([1, 2], path)) == [1, 2] and held() is tokens.packed(path)
    assert list(trimmed([3])) == [3]
    gc.collect()
    assert held() is None


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string").repartition(3)


def test_packed_ids_are_the_library_s(library):
    got = tokens.PackedTokenizer(tokens.default_tokenizer()).encode(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(library, t) for t in TEXTS]


def test_store_round_trip(spark, library, tmp_path):
    rows = {r.doc_id: r for r in tokenstore.store_documents(frame(spark, TEXTS), path=f"file://{tmp_path}/s").collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = ids_of(library, t) + [2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(TEXTS)


def test_store_keeps_a_chunk_once(spark, tmp_path):
    tokenstore.write(frame(spark, ["word and more " * 400] * 40), f"file://{tmp_path}/s")
    chunks = tokenstore._kind(spark, f"file://{tmp_path}/s", "chunk")
    assert chunks.count() == chunks.select("digest").distinct().count() < 40


def test_documents_are_put_together_again(spark, library, tmp_path):
    path = f"file://{tmp_path}/s"
    tokenstore.write(frame(spark, TEXTS), path)
    rows = {r.doc_id: r for r in tokenstore.documents(spark, path).collect()}
    said = {r.doc_id: r for r in tokenstore.read(spark, path).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].ids == ids_of(library, t) + [2] and rows[i].start == said[i].start and crc(rows[i].ids) == said[i].ids_crc32
    recipes = spark.read.parquet(f"{path}/recipes").orderBy("part", "start").collect()
    assert [r.doc_id for r in recipes] == list(range(len(TEXTS)))


@pytest.fixture(scope="module")
def whole_store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    tokenstore.write(frame(spark, [f"text number {k} " * (30 * k + 1) for k in range(12)]).repartition(6), f"file://{folder}/s")
    return folder / "s"


def _edit(folder, change, name=""):
    """Rewrites the Parquet file whose rows `change` takes, as pandas rows."""
    import pyarrow.parquet as pq

    files = [f for f in sorted((folder / name).rglob("*.parquet")) if pq.read_metadata(f).num_rows]
    table = pq.ParquetFile(files[0]).read()
    pq.write_table(type(table).from_pylist(change(table.to_pylist()), schema=table.schema), files[0])
    for f in files[0].parent.glob(".*.crc"):
        f.unlink()


def _lose(folder, name):
    import pyarrow.parquet as pq

    next(f for f in sorted((folder / name).rglob("*.parquet")) if pq.read_metadata(f).num_rows).unlink()


DAMAGE = {
    "manifest lost": lambda s: __import__("shutil").rmtree(s / "manifest"),
    "manifest edited": lambda s: _edit(s, lambda rows: [r | {"n_ids": r["n_ids"] + 1} if r["part"] == 0 else r for r in rows], "manifest"),
    "recipe file lost": lambda s: _lose(s, "recipes"),
    "recipe moved": lambda s: _edit(s, lambda rows: [r | {"start": r["start"] + 1} for r in rows], "recipes"),
    "recipe edited": lambda s: _edit(s, lambda rows: [r | {"digests": [*r["digests"][:-1], b"x" * 20]} for r in rows], "recipes"),
    "recipes swapped": lambda s: _edit(s, lambda rows: [r | {"doc_id": -r["doc_id"] - 1} for r in rows], "recipes"),
    "chunk file lost": lambda s: _lose(s, "data"),
    "chunk edited": lambda s: _edit(s, lambda rows: [r | {"ids": r["ids"][::-1]} for r in rows], "data"),
}


@pytest.mark.parametrize("damage", DAMAGE)
def test_store_notices_damage(spark, whole_store, tmp_path, damage):
    import shutil

    shutil.copytree(whole_store, tmp_path / "s")
    assert damage != "manifest lost" or len(tokenstore.read(spark, f"file://{tmp_path}/s").collect()) == 12
    DAMAGE[damage](tmp_path / "s")
    with pytest.raises(Exception, match="DamagedStore|does not match|do not match|missing|PATH_NOT_FOUND|another id"):
        tokenstore.read(spark, f"file://{tmp_path}/s").collect()


def test_empty_tables(spark):
    assert tokenstore.store_documents(frame(spark, ["a"]).limit(0)).collect() == []
    assert packing.pack_documents(frame(spark, ["a"]).limit(0)).collect() == []


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted(r.start for r in tokenstore.store_documents(docs).collect()) == [0, 3, 6]
    assert len(packing.pack_documents(docs).collect()) == 3


@pytest.mark.parametrize("capacity", [8, 1024])
def test_packing(spark, library, capacity):
    rows = packing.pack_documents(frame(spark, TEXTS), capacity=capacity).collect()
    whole = {i: ids_of(library, t) + [2] for i, t in enumerate(TEXTS)}
    sequences = {}
    for r in rows:
        ids = whole[r.doc_id]
        part = ids[r.start : r.start + r.length]
        assert crc(part) == r.ids_crc32 and len(part) == r.length <= capacity
        assert len(ids) > capacity or (r.piece, r.length) == (0, len(ids))
        assert r.piece == 0 or r.length == capacity
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, whole.values()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def sequential_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return len(gaps)


def check_places(rows, capacity):
    """rows: (length, sequence, offset). Sequences are gapless from 0 and no longer than the capacity; how many there are."""
    ends = {}
    for length, sequence, offset in sorted(rows, key=lambda r: (r[1], r[2])):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert max(ends.values(), default=0) <= capacity
    return len(ends)


@pytest.mark.parametrize("capacity, ranges", [(10, 300), (100, 200_000), (1024, 150)])
def test_packing_is_as_good_as_sequential_best_fit(spark, monkeypatch, capacity, ranges):
    monkeypatch.setattr(packing, "RANGE_ROWS", ranges)
    rng = np.random.default_rng(capacity)
    lengths = rng.integers(1, capacity + 1, 500).tolist() + [capacity // 3] * 200 + rng.integers(1, capacity // 5 + 1, 150).tolist()
    df = spark.createDataFrame([(n, k, "x") for k, n in enumerate(lengths)], "length long, id int, _id string").repartition(4)
    rows = packing.pack(df, capacity=capacity).collect()
    assert sorted((r.id, r.length, r._id) for r in rows) == [(k, n, "x") for k, n in enumerate(lengths)]
    made = check_places([(r.length, r.sequence_id, r.offset) for r in rows], capacity)
    assert made <= 1.01 * sequential_best_fit(lengths, capacity) + 1


def test_sweep_is_best_fit():
    rng = np.random.default_rng(2)
    for k in range(200):
        gaps, docs = (rng.integers(1, 21, int(rng.integers(0, 15))).tolist() for _ in range(2))
        docs.sort(reverse=True)
        where, after = packing.swept(docs, gaps, 20, k % 2 == 0)
        rest = sorted(gaps)
        for d, (gap, room) in zip(docs, where):
            fit = next((g for g in rest if g >= d), None)
            if fit is not None:
                rest.remove(fit)
            elif k % 2 == 0:
                fit = 20
            assert room == (fit or 0) and (gap >= 0) == (fit is not None)
            if fit is not None:
                rest.append(fit - d)
                rest.sort()
        assert sorted(after) == sorted(rest) and len(after) >= len(gaps)


def test_what_ranges_leave_meets_by_rank():
    rng = np.random.default_rng(3)
    for _ in range(200):
        left = [(p, int(rng.integers(0, 5)), int(rng.integers(0, 5))) for p in range(6)]
        stack, want = [], []
        for p, slots, docs in left:
            want += [((p, d), stack.pop()) for d in range(docs) if stack]
            stack += [(p, s) for s in range(slots)]
        pairs = {1: {}, 0: {}}
        for kind, part, a, b, first in packing.carried(left):
            for nth in range(a, b):
                pairs[kind][first + (nth - a if kind else b - 1 - nth)] = (part, nth)
        assert sorted((pairs[1][k], pairs[0][k]) for k in pairs[1]) == sorted(want)


def test_lengths_out_of_bounds_and_names(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,), (3,)], "length long"), capacity=4)
    named = spark.createDataFrame([(3, 7, 8, "a"), (2, 7, 8, "b")], "length long, sequence_id long, offset long, seq string")
    got = packing.pack(named, capacity=5)
    assert got.columns == ["length", "seq", "sequence_id", "offset"] and check_places([(r.length, r.sequence_id, r.offset) for r in got.collect()], 5) == 1


def test_many_new_pieces_at_once(library):
    import random

    rng = random.Random(5)
    tok = tokens.PackedTokenizer(tokens.default_tokenizer())
    for _ in range(3):
        texts = ["".join(rng.choices("aBéß日½7'  \n\t.!-s\0́", k=rng.randrange(60))) for _ in range(1500)]
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [ids_of(library, t) for t in texts]


def test_passages_of_some_hundred_ids_are_shared():
    rng = np.random.default_rng(6)
    seen, stored_ids, shared = set(), 0, 0
    for _ in range(20):
        passage = rng.integers(0, 30000, 700, dtype=np.uint32)
        shared += 19 * len(passage)
        for _ in range(20):
            ids = np.concatenate([rng.integers(0, 30000, 300, dtype=np.uint32), passage, rng.integers(0, 30000, 300, dtype=np.uint32)])
            at = 0
            for to in tokenstore.cut_points(len(ids), tokenstore.marks(ids).tolist()):
                name = ids[at:to].tobytes()
                stored_ids += (to - at) * (name not in seen)
                seen.add(name)
                at = to
    saved = (20 * 20 * 1300 - stored_ids) / shared
    assert saved > 0.3, saved
