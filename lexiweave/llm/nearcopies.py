"""Near copies by SimHash of word shingles: Golay codes of long fingerprints find candidates, whole shingle sets decide.

At a Jaccard similarity of 0.8 about 15 % of the bits of two fingerprints differ (10 of 64), more than a search within 4 bits
finds. So a text has a fingerprint of PARTS words of 23 bits, each bit what over half of the shingles' hashes have. Each word is
decoded to the codewords of the Golay code within 4 bits of it (see `simhash`), and keeps the NEAR of them for which the bits that change
had the narrowest majorities, as those are the bits in which similar texts differ. Texts that share a codeword of a part and one of the
next part, in a ring, are candidates (README: what share of pairs do, by similarity). Each candidate pair is compared by its whole sets.

Texts of equal sets meet once. Each text is first compared with the closest, by 64 bits, of the least and the neighbour of all keys, then each
component with the closest such one of other components, a few times over, and at last all texts that share a key and are still in different
components, but for those whose sketches (odd sketches, which never differ more than sets do) rule the similarity out. So a large group of
copies makes rows in proportion to its size and its links, and no similar pair that shares a key is left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, forget, fresh, partitions, small, stored, trimmed
from .components import components
from .hashes import mixed, rolling, word_hashes
from .simhash import Golay

WORDS, SIMILARITY = 5, 0.8
#: Words of 23 bits of a fingerprint, and codewords that are kept of each.
PARTS, NEAR = 64, 2
#: In how many passes, each over some of the parts, keys are shuffled.
PASSES = 4
#: Differing bits of the first 64 up to which texts may be similar: at 0.8 a pair has more with a probability of 2e-6.
CLOSE = 24
#: The same where more than two texts share a key: at 0.8 a pair has more with a probability below 1e-6, texts by chance have no more with 0.08.
CLOSE_OF_MANY = 26
#: Texts that share a key up to which all are held against each other, by their first 64 bits; of more all are kept.
MANY = 64
#: How often components are compared by one pair each before all texts are.
ROUNDS = 2
#: Words of 64 bits of a set's sketch.
SKETCH = 32
#: Shingles of texts, and texts, that are taken together, for the speed of whole arrays.
TOGETHER, TEXTS = 100_000, 400
#: Runs of up to 255 shingles whose hashes are counted at once, however long a text is, and texts that are decoded at once.
RUNS, DECODED = 64, 32
_HASHES = -(-PARTS * 23 // 64)
_MASKS = np.random.default_rng(42).integers(0, 1 << 63, _HASHES, dtype=np.uint64)
#: The eight bits of a byte as a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a whole text (A-Z in lower case; fewer words: all of them) as sorted 64-bit hashes."""
    w = word_hashes((text or "").encode().lower())
    return np.unique(rolling(w, min(words, len(w)))) if len(w) else w


def majorities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set and each bit of a fingerprint, how many more hashes of its elements have the bit than have not; sets are not empty."""
    every, sizes = np.concatenate(sets), np.asarray([len(s) for s in sets])
    # runs of at most 255 elements of one set, whose counts fit a byte
    runs = -(-sizes // 255)
    starts = np.concatenate([np.arange(0, n, 255) + at for n, at in zip(sizes.tolist(), (np.cumsum(sizes) - sizes).tolist())])
    first = np.cumsum(runs) - runs
    out = np.empty((len(sets), _HASHES * 64), np.int64)
    ends = np.append(starts, len(every))
    blocks = [(starts[i : i + RUNS] - starts[i], every[starts[i] : ends[min(i + RUNS, len(starts))]]) for i in range(0, len(starts), RUNS)]
    for k, mask in enumerate(_MASKS):
        counts = np.concatenate([np.add.reduceat(_LANES[mixed(x ^ mask).view(np.uint8).reshape(-1, 8)], at, axis=0) for at, x in blocks]).view(np.uint8)
        out[:, 64 * k : 64 * k + 64] = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
    return 2 * out - sizes[:, None]


_code: list[tuple[Golay, np.ndarray]] = []


def codewords(more: np.ndarray) -> np.ndarray:
    """Of each set's majorities, for each part, 12-bit numbers of the NEAR codewords that the fewest votes are against; -1 where there is none."""
    if not _code:
        code = Golay()
        _code.append((code, ((np.maximum(code.patterns, 0)[..., None] >> np.arange(23)) & 1).astype(np.float64)))
    (code, changed), out = _code[0], np.empty((len(more), PARTS, NEAR), np.int16)
    for k in range(0, len(more), DECODED):
        votes = more[k : k + DECODED, : PARTS * 23].reshape(-1, PARTS, 23)
        words = (votes > 0) @ (1 << np.arange(23))
        syndromes = code.low[words & 0xFFF] ^ code.high[words >> 12]
        errors = code.patterns[syndromes]
        against = np.where(errors < 0, np.inf, (changed[syndromes] @ np.abs(votes)[..., None].astype(np.float64))[..., 0])
        errors = np.take_along_axis(errors, np.argsort(against, axis=-1, kind="stable")[..., :NEAR], -1)
        out[k : k + DECODED] = np.where(errors < 0, -1, (words[..., None] ^ np.maximum(errors, 0)) >> 11)
    return out


def keys(found: np.ndarray, parts: range = range(PARTS)) -> tuple[np.ndarray, np.ndarray]:
    """Parallel arrays of the position of a set in `found` and a key: a codeword of one of the parts with one of the next part."""
    one, two = found[:, list(parts), :, None].astype(np.int64), found[:, [(p + 1) % PARTS for p in parts], None, :].astype(np.int64)
    there = (one >= 0) & (two >= 0)
    every = np.asarray(parts, np.int64)[:, None, None] << 24 | one << 12 | two
    return np.nonzero(there)[0], every[there]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / max(1, len(both) - common)


def _described(docs: DataFrame) -> DataFrame:
    """_row, doc_id, node (names the shingle set), codewords and first 64 bits of each row; _row is the same for equal doc_id and text only."""
    from xxhash import xxh64_intdigest

    names = ["_row", "doc_id", "node", "code", "bits"]

    def flush(held):
        sets = [s for *_, s in held]
        node = np.asarray([xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        code, bits = [None] * len(sets), np.zeros(len(sets), np.int64)
        if full := [k for k, s in enumerate(sets) if len(s)]:
            more = majorities([sets[k] for k in full])
            bits[full] = np.packbits(more[:, :64] > 0, axis=1, bitorder="little").view(np.int64)[:, 0]
            for k, found in zip(full, codewords(more)):
                code[k] = found.tobytes()
        columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(node), pa.array(code, pa.binary()), pa.array(bits)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.append((row, doc, shingles(text)))
                n += len(held[-1][2])
                if n >= TOGETHER or len(held) >= TEXTS:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: trimmed(run(b)), "_row long, doc_id long, node long, code binary, bits long")


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Bits that an odd number of elements of the set fall on. Where two sets' sketches differ, the sets have an element that the
    other has not: there are never more differing bits than such elements."""
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(texts: DataFrame) -> DataFrame:
    """node, its set s, the set's size and odd sketch."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            odd = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([odd_sketch(s) for s in sets]) if sets else [], pa.int64()), SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), odd.cast(pa.list_(pa.int64()))], names=["node", "s", "size", "odd"])

    return texts.select("node", "text").mapInArrow(lambda b: trimmed(run(b)), "node long, s binary, size long, odd array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            near = np.asarray([similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= least for x, y in zip(batch.column(2), batch.column(3))], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # Sets whose sizes alone rule out the similarity need not be compared.
    sizes = F.octet_length("sa"), F.octet_length("sb")
    able = F.least(*sizes) >= least * F.greatest(*sizes)
    wanted = sets.join(small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    one, two = (wanted.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    near = pairs.join(one, "a").join(two, "b").where(able).select("a", "b", "sa", "sb").mapInArrow(lambda b: trimmed(run(b)), "a long, b long")
    near = stored(near, "near")
    forget(pairs)
    return near


def _first_pairs(met: DataFrame) -> DataFrame:
    """A pair (a, b) for each node of (node, bits, keys): with the closest of the least node and the next smaller bits of its keys."""
    whole, other = Window.partitionBy("key"), F.struct("node", "bits")
    rows = met.select("node", "bits", F.explode("keys").alias("key"))
    rows = rows.withColumns({"_first": F.min(other).over(whole), "_last": F.lag(other).over(whole.orderBy("bits", "node"))})
    apart = lambda c: F.bit_count(F.col("bits").bitwiseXOR(F.col(f"{c}.bits")))
    at = lambda c: F.when((F.col(f"{c}.node") != F.col("node")) & (apart(c) <= CLOSE), F.struct(apart(c).alias("apart"), F.col(f"{c}.node").alias("b")))
    best = rows.select("node", F.least(at("_first"), at("_last")).alias("best")).where("best is not null").groupBy(F.col("node").alias("a")).agg(F.min("best").alias("best"))
    return best.select("a", "best.b")


def _most(least: float) -> float:
    """The share of differing elements that sets of this similarity have."""
    return (1 - least) / (1 + least) + 1e-9


def _next_pairs(rest: DataFrame, least: float, seed: int) -> DataFrame:
    """Of (node, root, size, odd, keys) a pair (a, b) for each root, if its sketches allow the similarity: of its nodes and of the first and
    the previous node of their keys, in an order of chance, the pair whose sketches differ least."""
    order = Window.partitionBy("key").orderBy("_nth", "node")
    rows = rest.select("node", "root", "size", "odd", F.explode("keys").alias("key")).withColumn("_nth", F.xxhash64("key", "node", F.lit(seed)))
    other = F.struct("node", "root", "size", "odd")
    rows = rows.withColumns({"_first": F.first(other).over(order), "_last": F.lag(other).over(order)})

    def at(c):
        differ = F.aggregate(F.zip_with("odd", f"{c}.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        share = differ / (F.col("size") + F.col(f"{c}.size"))
        return F.when(F.col(f"{c}.root") != F.col("root"), F.struct(share.alias("share"), "node", F.col(f"{c}.node").alias("other")))

    best = rows.select("root", F.least(at("_first"), at("_last")).alias("best")).groupBy("root").agg(F.min("best").alias("best"))
    return best.where(F.col("best.share") <= _most(least)).select(F.col("best.node").alias("a"), F.col("best.other").alias("b"))


def _other_pairs(rest: DataFrame, least: float, n: int) -> DataFrame:
    """All pairs (a, b) that share a key, are in different components and whose sketches allow the similarity. One of two components is not the
    largest of the key: only nodes of others are held against all."""
    whole = Window.partitionBy("key")
    rows = rest.select("node", "root", "size", "odd", F.explode("keys").alias("key")).repartition(n, "key")
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("key", "root")))
    rows = rows.withColumn("_main", F.max(F.struct("_n", "root")).over(whole))
    names = ["key", "node", "root", "size", "odd"]
    one, two = rows.where("root <> _main.root").select(*[F.col(c).alias(f"{c}_a") for c in names]), rows.select(*[F.col(c).alias(f"{c}_b") for c in names])
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col("odd_a")[k].bitwiseXOR(F.col("odd_b")[k])) for k in range(SKETCH)))
    able = (F.col("root_a") != F.col("root_b")) & (differ <= _most(least) * (F.col("size_a") + F.col("size_b")))
    return one.join(two, (F.col("key_a") == F.col("key_b")) & able).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _with_company(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which rows, sorted by key, share their key with one whose bits are close, or with over MANY."""
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(key)))
    size = np.repeat(size, size)
    keep, most = size > MANY, np.where(size > 2, CLOSE_OF_MANY, CLOSE)
    some = np.flatnonzero((size > 1) & ~keep)
    for away in range(1, int(size[some].max()) if len(some) else 0):
        a = some[some + away < len(key)]
        a = a[key[a] == key[a + away]]
        a = a[np.bitwise_count((bits[a] ^ bits[a + away]).view(np.uint64)) <= most[a]]
        keep[a] = keep[a + away] = True
    return keep


def _close(batches):
    """Those of (key, node, bits), sorted by key, that _with_company() keeps: a key's rows are seen together, but for those of very many."""
    held, hot = [np.zeros(0, np.int64)] * 3, None

    def kept(rows, keep):
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], names=["key", "node", "bits"])

    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in range(3)]
        if hot is not None:
            n = int(np.searchsorted(rows[0], hot, side="right"))
            if n:
                yield kept([x[:n] for x in rows], slice(None))
            rows = [x[n:] for x in rows]
        if not len(rows[0]):
            continue
        rows, hot = [np.concatenate(x) for x in zip(held, rows)], None
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if len(rows[0]) - last > MANY:
            hot, last = rows[0][-1], len(rows[0])
        held = [x[last:] for x in rows]
        yield kept([x[:last] for x in rows], _with_company(rows[0][:last], rows[2][:last]))
    yield kept(held, _with_company(held[0], held[2]))


def _meeting(nodes: DataFrame, n: int) -> DataFrame:
    """node, bits and those of its keys that nodes with close bits have too, or very many nodes. Of (node, code, bits)."""
    passes: list[DataFrame] = []
    for k in range(PASSES):
        parts = range(k * PARTS // PASSES, (k + 1) * PARTS // PASSES)

        def spread(batches, parts=parts):
            for batch in batches:
                for from_ in range(0, batch.num_rows, 2_000):
                    node, code, bits = (batch.column(c).slice(from_, 2_000) for c in range(3))
                    at, key = keys(np.frombuffer(b"".join(code.to_pylist()), np.int16).reshape(-1, PARTS, NEAR), parts)
                    yield pa.RecordBatch.from_arrays([pa.array(key), node.take(pa.array(at)), bits.take(pa.array(at))], names=["key", "node", "bits"])

        entries = nodes.where("code is not null").select("node", "code", "bits").mapInArrow(lambda b, f=spread: trimmed(f(b)), "key long, node long, bits long").repartition(n, "key")
        met = entries.sortWithinPartitions("key").mapInArrow(lambda b: trimmed(_close(b)), "key long, node long, bits long")
        passes.append(stored(met, "met"))
    met = stored(reduce(DataFrame.union, passes).groupBy("node").agg(F.first("bits").alias("bits"), F.collect_list("key").alias("keys")), "met")
    forget(*passes)
    return met


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root and keys of members (node, keys), with those keys alone where several components meet."""
    whole = Window.partitionBy("key")
    placed = members.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key"))
    placed = placed.withColumns({"_min": F.min("root").over(whole), "_max": F.max("root").over(whole)}).where("_min <> _max")
    return stored(placed.groupBy("node").agg(F.first("root").alias("root"), F.collect_list("key").alias("keys")), "rest")


def linked(nodes: DataFrame, texts: DataFrame, n: int, least: float = SIMILARITY) -> DataFrame:
    """(node, root) of components of the nodes (node, code, bits, _row) that are linked at a similarity of `least` or more; texts: _row, text."""
    met = _meeting(nodes, n)
    named = stored(nodes.select("node", "_row").join(met.select("node"), "node", "left_semi"), "named")
    sets = stored(_sets(texts.select("_row", "text").join(small(named), "_row").dropDuplicates(["node"])), "sets", compact=True)
    sketches = sets.select("node", "size", "odd")
    links = _verified(_first_pairs(met), sets, least)
    rest = _rooted(met, components(links))
    forget(met, named)
    for seed in range(ROUNDS):
        found = _verified(_next_pairs(rest.join(sketches, "node"), least, seed), sets, least)
        if found.isEmpty():
            break
        links = links.union(found)
        before, rest = rest, _rooted(rest.drop("root"), components(links))
        forget(before)
    links = links.union(_verified(_other_pairs(rest.join(sketches, "node"), least, n), sets, least))
    forget(sets, rest)
    return components(links)


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of each group of near copies the row with the least doc_id; null is more than any. Columns as they are.

    Rows count by doc_id and text: different texts under one doc_id are documents of their own, and so are those without doc_id.
    Of rows that are the same in both, one stays. Texts without words are copies of each other.
    """
    bounded_batches(docs.sparkSession)
    n, key = partitions(docs), fresh("_row", docs)
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    plain = rows.select(F.col(key).alias("_row"), "doc_id", "text")
    found = stored(_described(plain), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    nodes = stored(found.groupBy("node").agg(first, F.first("code").alias("code"), F.first("bits").alias("bits")), "nodes")
    forget(found)
    roots = linked(nodes.select("node", "code", "bits", F.col("first._row").alias("_row")), plain, n, least)
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = stored(kept.select(F.col("first._row").alias(key)), "kept")
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
