"""Exact top-k by integer inner product with a KD-tree for each shard of vectors.

Vectors are dealt into shards by the medians of a bounded sample (a KD-tree over SAMPLE vectors, which only says where a vector
goes), so that a shard lies together in space; a cell of more than SHARD vectors makes several. A shard's tree splits at the median of
the widest dimension and keeps a tight bounding box and the least id of each node; leaves hold their vectors side by side.

A box bounds a product from above by taking in each dimension the corner that suits the query's sign. Queries travel in packed
blocks. Each first goes to the shard with the highest bound; the k-th score found there goes along when the bounds of all shards are
looked at again, and only shards that may still count get the query. Within a shard a block's queries go through nodes level by
level, those whose bound is too low drop out, and leaves are taken best first, by matrix products for all queries at the same leaf; a
query ends once its next leaf's bound is below its k-th score, or equals it while all ids of the leaf are larger.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small, stored, trimmed

#: Vectors of a shard (about), of a leaf, queries of a block, boxes of a pack, and vectors of the sample that shards are cut by, at most.
SHARD, LEAF, BLOCK, PACK, SAMPLE = 8192, 64, 256, 1024, 20_000
#: Tasks that blocks meet boxes in, where these are too many to broadcast.
SALTS = 256
#: Up to here products of components are exact in a float's 53 bits, whatever their sign, for 2**13 dimensions.
EXACT = 1 << 20


def _exact(vectors: np.ndarray) -> np.ndarray:
    """Vectors of whole numbers as floats, or beyond floats' exact range as Python's own integers; a score out of a long's range fails on output."""
    if np.abs(vectors).max(initial=0) > EXACT:
        return np.array([[int(x) for x in v] for v in vectors], dtype=object).reshape(vectors.shape)
    return vectors.astype(np.float64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A row for each query, a column for each box: what no product with a vector in the box exceeds."""
    zero = queries * 0
    return np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T


class Tree:
    """Vectors as rows of whole numbers, with ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows = ids, _exact(vectors)
        self.low, self.high, self.least, self.kids, self.leaves = [], [], [], [], {}
        waiting = [(np.arange(len(ids)), None, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            at, part = len(self.low), self.rows[rows]
            self.low.append(part.min(axis=0))
            self.high.append(part.max(axis=0))
            self.least.append(int(ids[rows].min()))
            self.kids.append([-1, -1])
            if parent is not None:
                self.kids[parent][side] = at
            width = self.high[at] - self.low[at]
            dim = int(np.argmax(width))
            if len(rows) <= LEAF or not width[dim]:
                self.leaves[at] = rows
                continue
            mid = len(rows) // 2
            halves = np.argpartition(part[:, dim].astype(np.float64), mid)
            waiting += [(rows[halves[:mid]], at, 0), (rows[halves[mid:]], at, 1)]
        self.low, self.high, self.least = np.array(self.low), np.array(self.high), np.array(self.least, np.int64)

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (with its own id and the k-th score found elsewhere) scores and ids of up to k rows that may be among its best."""
        n = len(own)
        queries = _exact(queries)
        if queries.dtype == object or self.rows.dtype == object:
            queries = np.array([[int(x) for x in v] for v in queries], dtype=object).reshape(queries.shape)
        # level by level, (query, node) pairs whose bound may still count
        asked, node = np.arange(n), np.zeros(n, np.int64)
        found_q, found_leaf, found_bound = [], [], []
        while len(node):
            top = np.empty(len(node), queries.dtype)
            order = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                at, who = int(node[order[a]]), order[a:b]
                top[who] = bounds(queries[asked[who]], self.low[at : at + 1], self.high[at : at + 1])[:, 0]
            fine = (top >= known[asked]).astype(bool)
            asked, node, top = asked[fine], node[fine], top[fine]
            leaf = np.array([x in self.leaves for x in node.tolist()], bool)
            found_q.append(asked[leaf])
            found_leaf.append(node[leaf])
            found_bound.append(top[leaf])
            kids = np.array([self.kids[x] for x in node[~leaf].tolist()], np.int64).reshape(-1, 2)
            asked, node = np.repeat(asked[~leaf], 2), kids.reshape(-1)
        q, leaf, top = np.concatenate(found_q), np.concatenate(found_leaf), np.concatenate(found_bound)
        order = np.lexsort((-top.astype(np.float64), q))
        if top.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -top[i])), np.int64)
        q, leaf, top = q[order], leaf[order], top[order]
        begin, end = np.searchsorted(q, np.arange(n)), np.searchsorted(q, np.arange(n), side="right")
        scores, names = [np.zeros(0, queries.dtype) for _ in range(n)], [np.zeros(0, np.int64) for _ in range(n)]
        active = np.flatnonzero(begin < end)
        step = 0
        while len(active):
            at = begin[active] + step
            go = []
            for i, x in zip(active.tolist(), at.tolist()):
                full = len(scores[i]) == k
                if full and (top[x] < scores[i][-1] or top[x] == scores[i][-1] and self.least[leaf[x]] > names[i][-1] and (x + 1 == end[i] or top[x + 1] < top[x])):
                    continue
                go.append((i, x))
            order = sorted(go, key=lambda p: leaf[p[1]])
            a = 0
            while a < len(order):
                b = a
                while b < len(order) and leaf[order[b][1]] == leaf[order[a][1]]:
                    b += 1
                who = [p[0] for p in order[a:b]]
                rows = self.leaves[int(leaf[order[a][1]])]
                made = queries[who] @ self.rows[rows].T
                for i, s in zip(who, made):
                    names_ = self.ids[rows]
                    ok = (s >= known[i]).astype(bool) & (names_ != own[i])
                    if ok.any():
                        s, names_ = np.concatenate([scores[i], s[ok]]), np.concatenate([names[i], names_[ok]])
                        if s.dtype == object:
                            first = np.array(sorted(range(len(s)), key=lambda j: (-s[j], names_[j]))[:k], np.int64)
                        else:
                            first = np.lexsort((names_, -s))[:k]
                        scores[i], names[i] = s[first], names_[first]
                a = b
            step += 1
            active = np.array([i for i, x in go if x + 1 < end[i]], np.int64)
        return list(zip(scores, names))


def _valid(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """Rows with an id whose vectors are there, not empty, and have only finite components; these as whole numbers floor(scale * x)."""
    x = F.col(vector)
    good = F.col(id_).isNotNull() & x.isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return df.where(good & F.coalesce(finite, F.lit(False)))


def planes(vectors: np.ndarray, cells: int) -> list:
    """Median splits of the widest dimension until there are so many cells: nested (dimension, value, below, from there on), or None."""
    if cells <= 1 or len(vectors) < 2:
        return None
    width = vectors.max(axis=0) - vectors.min(axis=0)
    dim = int(np.argmax(width))
    if not width[dim]:
        return None
    cut = float(np.median(vectors[:, dim]))
    below = vectors[:, dim] < cut
    if not below.any():  # more than half share the least value
        cut = float(vectors[vectors[:, dim] > vectors[:, dim].min(), dim].min())
        below = vectors[:, dim] < cut
    return [dim, cut, planes(vectors[below], cells // 2), planes(vectors[~below], cells - cells // 2)]


def cell_of(vectors: np.ndarray, tree) -> np.ndarray:
    """A number for the cell of each vector."""
    out = np.zeros(len(vectors), np.int64)
    waiting = [(np.arange(len(vectors)), tree, 1)]
    while waiting:
        rows, at, name = waiting.pop()
        if at is None:
            out[rows] = name
            continue
        below = vectors[rows, at[0]] < at[1]
        waiting += [(rows[below], at[2], 2 * name), (rows[~below], at[3], 2 * name + 1)]
    return out


def _celled(rows: DataFrame) -> DataFrame:
    """id, v, dim and the cell of each row, by medians of a sample of each length's vectors: the SAMPLE with the least hashes."""
    spark = rows.sparkSession
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    trees = {}
    for dim, n in counts.items():
        if n > SHARD:
            few = rows.where(F.col("dim") == dim).select("v", F.xxhash64("id", F.hash("v")).alias("h"))
            few = few.where(F.col("h").cast("double") <= min(1.0, 2 * SAMPLE / n) * 2.0**64 - 2.0**63).orderBy("h").limit(SAMPLE)
            trees[dim] = planes(np.asarray([r["v"] for r in few.collect()], np.float64).reshape(-1, dim), -(-n // SHARD))
    shared = spark.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            dims, cells = batch.column(2).to_numpy(), np.ones(batch.num_rows, np.int64)
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                if shared.value.get(dim) is not None:
                    flat = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                    cells[at] = cell_of(flat.reshape(len(at), dim), shared.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["id", "v", "dim", "cell"])

    return stored(rows.mapInArrow(run, "id long, v array<double>, dim int, cell long"), "cells", compact=True)


SHARDS = "shard long, dim int, kind int, low array<double>, high array<double>, blob binary"


def _shards(rows: DataFrame, n: int) -> DataFrame:
    """Trees of the vectors of a cell each, of several trees where a cell has more than SHARD, with the trees' boxes."""
    celled = _celled(rows)
    # at most as many rows as there are cells, and those are as many as shards are needed
    parts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    named = celled.join(F.broadcast(stored(parts, "parts")), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", F.hash("v")), "parts"))

    def build(batches):
        held: list = []
        key = None

        def out():
            ids, vectors = np.asarray([h[0] for h in held], np.int64), np.asarray([h[1] for h in held], np.float64)
            for a in range(0, len(ids), 2 * SHARD):
                tree = Tree(ids[a : a + 2 * SHARD], vectors[a : a + 2 * SHARD])
                cols = [[0], [vectors.shape[1]], [0], [tree.low[0].astype(np.float64)], [tree.high[0].astype(np.float64)], [pickle.dumps(tree)]]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for dim, cell, part, id_, v in zip(*(c.to_pylist() for c in batch.columns)):
                # rows of one cell and part stand together; equal vectors may be many, so a tree ends at twice a shard
                if (dim, cell, part) != key or len(held) >= 2 * SHARD:
                    if held:
                        yield from out()
                    key, held = (dim, cell, part), []
                held.append((id_, v))
        if held:
            yield from out()

    dealt = named.select("dim", "cell", "part", "id", "v").repartition(n, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part")
    return stored(dealt.mapInArrow(lambda b: trimmed(build(b)), SHARDS).withColumn("shard", F.monotonically_increasing_id()), "shards")


BLOCKS = "dim int, blob binary"


def _blocks(queries: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Queries (keys, id, v, known) packed in blocks of one length and key each: ids, vectors, thresholds."""

    def pack(batches):
        held: dict = {}
        n = len(keys)

        def out(key):
            ids, vectors, known = zip(*held.pop(key))
            blob = pickle.dumps((np.asarray(ids, np.int64), np.asarray(vectors, np.float64), np.asarray(known, np.float64)))
            cols = [*([x] for x in key[:n]), [key[n]], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * n, pa.int32(), pa.binary()])], names=[*keys, "dim", "blob"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                v, t = row[n + 1], row[n + 2]
                key = (*row[:n], len(v))
                held.setdefault(key, []).append((row[n], v, -np.inf if t is None else t))
                if len(held[key]) == BLOCK:
                    yield out(key)
                elif len(held) > 4096:
                    yield out(next(iter(held)))
        for key in list(held):
            yield out(key)

    return queries.select(*keys, "id", "v", "known").mapInArrow(pack, "".join(f"{k} long, " for k in keys) + BLOCKS)


def _boxes(trees: DataFrame) -> DataFrame:
    """dim and packs of up to PACK shards with their boxes."""

    def pack(batches):
        held: dict = {}

        def out(dim):
            shards, low, high = zip(*held.pop(dim))
            blob = pickle.dumps((np.asarray(shards, np.int64), np.asarray(low), np.asarray(high)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([blob], pa.binary())], names=["dim", "boxes"])

        for batch in batches:
            for shard, dim, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(dim, []).append((shard, low, high))
                if len(held[dim]) == PACK:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return stored(trees.select("shard", "dim", "low", "high").mapInArrow(pack, "dim int, boxes binary"), "boxes")


def _aimed(queries: DataFrame, boxes: DataFrame, first: bool) -> DataFrame:
    """shard, id, v and known of each query for each shard that may count; first: for the one of each pack with the highest bound."""

    def run(batches):
        for batch in batches:
            for blob, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (ids, v, known), (shards, low, high) = pickle.loads(blob), pickle.loads(pack)
                top = bounds(v, low, high)
                # sums of floats may be off by a little, so that bounds get some room
                room = 1e-9 * (np.abs(v) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-9
                if first:
                    at = np.arange(len(ids)), top.argmax(axis=1)
                else:
                    at = np.nonzero(top + room >= known[:, None])
                cols = [pa.array(shards[at[1]]), pa.array(ids[at[0]]), pa.array(list(v[at[0]]), pa.list_(pa.float64())), pa.array(np.where(np.isinf(known[at[0]]), -np.inf, known[at[0]])), pa.array(top[at])]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "id", "v", "known", "top"])

    # blocks of a stated set of queries against all boxes, which are one for each SHARD vectors
    blocks, few = _blocks(queries), small(boxes)
    if few is boxes:
        blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("blob"), F.lit(SALTS)).cast("int"))
        met = blocks.join(boxes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["dim", "salt"])
    else:
        met = blocks.join(few, "dim")
    return met.select("blob", "boxes").mapInArrow(run, "shard long, id long, v array<double>, known double, top double")


FOUND = "query_id long, vec_id long, score long"


def _search(trees: DataFrame, aimed: DataFrame, k: int, n: int) -> DataFrame:
    """Queries, packed by the shard they go to, past the trees: each task holds one tree at a time."""

    def run(batches):
        tree, shard = None, None
        for batch in batches:
            out = [[], [], []]
            for s, kind, blob in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                if kind == 0:
                    tree, shard = pickle.loads(blob), s
                elif s == shard:
                    ids, v, known = pickle.loads(blob)
                    for name, (scores, found) in zip(ids.tolist(), tree.best(ids, v, k, known)):
                        out[0] += [name] * len(found)
                        out[1] += found.tolist()
                        out[2] += [int(x) for x in scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    blocks = _blocks(aimed.repartition(n, "shard"), ["shard"])
    both = trees.select("shard", F.lit(0).alias("kind"), "blob").unionAll(blocks.select("shard", F.lit(1).alias("kind"), "blob"))
    return both.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lambda b: trimmed(run(b)), FOUND)


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = 5, query_id: str = "vec_id", id_: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products of floor(scale * x), ties to smaller ids.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id or vectors of
    another length than the query's. Candidates are rows: an id that several rows have may come several times; a query's own id is
    left out with all rows that have it. Of queries that share an id the least vector is asked.
    """
    floors = lambda df, i: _valid(df, i, vector).select(F.col(i).cast("long").alias("id"), F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"))
    n = partitions(candidates)
    trees = _shards(floors(candidates, id_).withColumn("dim", F.size("v")), n)
    asked = stored(floors(queries, query_id).groupBy("id").agg(F.min("v").alias("v")), "queries")
    boxes = _boxes(trees)
    # of the best shards of each pack the best one; ties to the first
    aims = _aimed(asked.withColumn("known", F.lit(None).cast("double")), boxes, True)
    best = Window.partitionBy("id").orderBy(F.desc("top"), "shard")
    home = aims.withColumn("r", F.row_number().over(best)).where("r = 1").select("shard", "id", "v", F.lit(None).cast("double").alias("known"))
    kth = _search(trees, home, k, n).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("known")).where(F.col("n") >= k)
    kth = stored(kth.select(F.col("query_id").alias("id"), "known"), "home")
    found = _search(trees, _aimed(asked.join(kth, "id", "left"), boxes, False), k, n)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
