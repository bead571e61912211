"""Exact repeats of 50 words and more across documents, found by fixed-block anchors.

A passage of `window` words that two documents share holds, wherever it lies, one whole block of `window // 2` words that starts
at a multiple of that length in the earlier document. So:

1. index: the non-overlapping blocks of every document, by a rolling hash over word hashes;
2. probe: every rolling window of a block's length of every document, against the index;
3. extend: around each hit, in the document that probed as in the one indexed, the windows of `window` words that hold it are
   compared by 96-bit digests of their words; neighbouring equal windows make up the maximal repeats;
4. remove: words of windows that also start in a document with a smaller doc_id, judged on the input.

Probes travel packed: a task collects the hashes of many documents, sorts them by part of the hash space and sends one
compressed array for each part, so a probe takes a few bytes. Before that an index entry is reduced to its hash's least and
largest doc_id, as is each digest in step 3: a passage in a third of all documents makes one entry for each task, and probes
are streamed past the index. What a task holds is its share of the distinct hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bounded_batches, forget, fresh, partitions, stored, trimmed
from .hashes import rolling, word_hashes

#: Words that a task collects before it sends arrays.
FLUSH_WORDS = 1_500_000
def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.asarray([len(arrays), *(len(a) for a in arrays)], "<u4").tobytes() + bytes(a.dtype.num for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


_KINDS = {np.dtype(t).num: np.dtype(t) for t in ("u1", "u2", "u4", "u8", "i8")}


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes, kinds, at, out = np.frombuffer(raw, "<u4", n, 4), raw[4 + 4 * n : 4 + 5 * n], 4 + 5 * n, []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, _KINDS[kind], size, at))
        at += size * _KINDS[kind].itemsize
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return at, np.diff(np.concatenate([at, [len(values)]])).astype(np.uint32)


def _reduced(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """By distinct hash, sorted: least doc, largest doc, a place and row of the least, whether one document has it more than once."""
    order = np.lexsort((docs, hashes))
    hashes, docs, places, rows = hashes[order], docs[order], places[order], rows[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    end = np.concatenate([at[1:], [len(hashes)]]).astype(np.int64)
    twice = np.concatenate([[False], ~first[1:] & (docs[1:] == docs[:-1])]) if len(hashes) else np.zeros(0, bool)
    many = np.add.reduceat(twice.astype(np.int64), at) > 0 if len(at) else np.zeros(0, bool)
    return [hashes[at], docs[at], docs[end - 1], places[at].astype(np.uint32), rows[at], many.astype(np.uint8)]


def _least(hashes: np.ndarray, who: np.ndarray, docs: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """By distinct hash, sorted: the least of the docs, of which who has the numbers, and its rest."""
    rank = np.unique(docs, return_inverse=True)[1].astype(np.uint32)
    order = np.lexsort((rank[who], hashes))
    order = order[_runs(hashes[order])[0]]
    return [hashes[order], docs[who[order]], rest[order]]


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """What _reduced gives over parts that it has given, or of (hash, least doc, rest) their least."""
    arrays = [np.concatenate([p[k] for p in parts]) for k in range(len(parts[0]))]
    order = np.lexsort((arrays[1], arrays[0]))
    arrays = [a[order] for a in arrays]
    h = arrays[0]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if len(arrays) == 3 or not len(at):
        return [a[at] for a in arrays]
    _, low, high, place, row, many = arrays
    n = np.diff(np.concatenate([at, [len(h)]]))
    low_, high_ = low[at], np.maximum.reduceat(high, at)
    many_ = np.maximum.reduceat(many, at) | ((n > 1) & (low_ == high_)).astype(np.uint8)
    # a document that two parts have has it more than once
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (low[1:] == low[:-1])])
    many_ |= np.maximum.reduceat(again.astype(np.uint8), at)
    return [h[at], low_, high_, place[at], row[at], many_]


BLOBS = "part int, kind int, blob binary"


def _by_part(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by part of the hash space, and where each part begins in it."""
    kind = np.min_scalar_type(parts)
    part = (h >> np.uint64(32)).astype(np.uint32)
    part %= np.uint32(parts)
    part = part.astype(kind)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=kind))


def _send(index: list[np.ndarray], h: np.ndarray, places: np.ndarray, other: np.ndarray | None, who: np.ndarray, docs: np.ndarray, rows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Arrays by part of the hash space: of the index (hash, doc, place, row), and of probes (the same, and a digest's other half).

    Of digests the index keeps the least document alone, and its place is the digest's other half. who has the number of each
    probe's document in docs and rows. Arrays are put in order part by part, so that no second copy of them all is held.
    """
    out, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["part", "kind", "blob"])

    for kind, hashes in enumerate((index[0], h)):
        order, ends = _by_part(hashes, parts)
        for k in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            here = order[ends[k] : ends[k + 1]]
            if kind == 0:
                blob = _pack(*[x[here] for x in index])
            else:
                low = (h[here] & np.uint64(0xFFFFFFFF)).astype(np.uint32) if other is None else h[here]
                own, at_place = who[here], places[here]
                at, times = _runs(rows[own])
                # places rise within a document: their steps are small numbers, which compress
                step = np.diff(at_place, prepend=0).astype(np.int64).astype(np.uint32)
                blob = _pack(low, docs[own[at]], rows[own[at]], times, step, *([] if other is None else [other[here]]))
            out.append((k, kind, blob))
            held += len(blob)
            if held >= BATCH_BYTES:
                yield batch()
                out, held = [], 0
    if out:
        yield batch()


def _put_together(held: list[tuple]) -> tuple:
    """Documents' numbers for each element, docs and rows, and their arrays joined, of (doc, row, array, ...) for each document; empties the list."""
    docs, rows = (np.asarray([x[k] for x in held], np.int64) for k in (0, 1))
    who = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[2]) for x in held])
    arrays = [np.concatenate([x[k] for x in held]) for k in range(2, len(held[0]))]
    held.clear()
    return who, docs, rows, *arrays


def _blocks(docs: DataFrame, size: int, parts: int) -> DataFrame:
    def run(batches):
        held, words_held = [], 0

        def flush():
            nonlocal words_held
            words_held = 0
            if not held:
                return
            who, doc, row, h = _put_together(held)
            starts = np.searchsorted(who, np.arange(len(doc), dtype=np.uint32)).astype(np.uint32)
            places = np.arange(len(h), dtype=np.uint32)
            places -= starts[who]
            fixed = np.flatnonzero(places % np.uint32(size) == 0)
            index = _reduced(h[fixed], doc[who[fixed]], places[fixed], row[who[fixed]])
            yield from _send(index, h, places, None, who, doc, row, parts)

        for batch in batches:
            for doc, row, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = word_hashes(text)
                if doc is not None and len(words) >= size:
                    held.append((doc, row, rolling(words, size)))
                    words_held += len(words)
                    if words_held >= FLUSH_WORDS:
                        yield from flush()
        yield from flush()

    return docs.select("doc_id", "row", "text").mapInArrow(lambda batches: trimmed(run(batches)), BLOBS)


HITS = "bucket int, blob binary"


def _hit_rows(rows: np.ndarray, places: np.ndarray, parts: int) -> pa.RecordBatch:
    """Places by row of documents, packed by bucket: the row's number modulo parts."""
    bucket = np.mod(rows, parts).astype(np.min_scalar_type(parts))
    order = np.lexsort((rows, bucket))
    cuts, sizes = _runs(bucket[order])
    out = []
    for a, n in zip(cuts.tolist(), sizes.tolist()):
        here = order[a : a + n]
        own = rows[here]
        at, times = _runs(own)
        out.append((int(bucket[here[0]]), _pack(own[at], times, np.asarray(places)[here].astype(np.uint32))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["bucket", "blob"])


#: Hits that a task holds before it sends them.
HOLD_HITS = 2_000_000


def _sent(hits: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Hits of a task put together, so that a bucket gets one row of many rather than one from each array of probes."""
    held, n = [], 0

    def flush():
        rows, places = (np.concatenate([h[k] for h in held]) for k in range(2))
        held.clear()
        return _hit_rows(rows, places, parts)

    for rows, places in hits:
        held.append((rows.astype(np.int64), np.asarray(places).astype(np.uint32)))
        n += len(rows)
        if n >= HOLD_HITS:
            yield flush()
            n = 0
    if held:
        yield flush()


MEET = "bucket int, kind int, doc_id long, row long, text string, blob binary"


def _meet(docs: DataFrame, hits: DataFrame, parts: int) -> DataFrame:
    """Documents and hits dealt by bucket, a bucket's hits before its documents."""
    where = F.pmod("row", F.lit(parts).cast("long")).cast("int")
    both = docs.select(where.alias("bucket"), F.lit(1).alias("kind"), "doc_id", "row", "text", F.lit(None).cast("binary").alias("blob")).union(
        hits.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("text"), "blob")
    )
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")


def _met(batches) -> Iterator[list[tuple]]:
    """Lists of (doc_id, row, text, places or None), one for each batch."""
    bucket, places = None, {}
    for batch in batches:
        out = []
        for b, kind, doc, row, text, blob in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if b != bucket:
                bucket, places = b, {}
            if kind == 0:
                who, times, at = _unpack(blob)
                ends = np.cumsum(times.astype(np.int64)).tolist()
                for r, e, t in zip(who.tolist(), ends, times.tolist()):
                    places.setdefault(r, []).append(at[e - t : e])
                continue
            out.append((doc, row, text, np.concatenate(places[row]) if row in places else None))
        yield out


def _groups(batches, narrow: bool):
    """For each part: its merged index, then its probes one array at a time; None at its end."""
    part, waiting, index = None, [], None
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if p != part:
                if part is not None and index is not None:
                    yield index, None
                part, waiting, index = p, [], None
            arrays = _unpack(blob)
            if kind == 0:
                waiting.append(arrays)
                if len(waiting) > 64:
                    waiting = [_merged(waiting)]
                continue
            if index is None:
                index = _merged(waiting) if waiting else None
                if index is not None and narrow:
                    order = np.argsort(index[0] & np.uint64(0xFFFFFFFF), kind="stable")
                    index = [a[order] for a in index]
                    index[0] = (index[0] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    index.append(np.zeros(len(index[0]), bool))
            if index is None or not len(index[0]):
                continue
            low, who, own, times, step = arrays[:5]
            places = np.cumsum(step, dtype=np.uint32)
            yield index, (low, np.repeat(who, times), places, np.repeat(own, times), arrays[5] if len(arrays) > 5 else None)
    if index is not None:
        yield index, None


def _anchors(blobs: DataFrame, parts: int) -> DataFrame:
    """Hits of probes on blocks of other documents, and the blocks they hit, as rows and places."""

    def run(batches):
        for index, probe in _groups(batches, True):
            h, least, largest, place, row, many, met = index
            if probe is None:
                if met.any():
                    yield row[met], place[met]
                continue
            low, docs, places, rows, _ = probe
            # entries that agree in the hash's lower half follow on one another; digests decide later which are the same
            at, end = np.searchsorted(h, low), np.searchsorted(h, low, side="right")
            hit = np.zeros(len(low), bool)
            while True:
                here = np.flatnonzero(at < end)
                if not len(here):
                    break
                e = at[here]
                other = (least[e] != docs[here]) | (largest[e] != docs[here])
                hit[here[other | (many[e] > 0)]] = True
                met[e[other]] = True
                at[here] += 1
            if hit.any():
                yield rows[hit], places[hit]

    return blobs.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(lambda batches: trimmed(_sent(run(batches), parts)), HITS)


def _starts(places: np.ndarray, size: int, window: int, n_words: int) -> np.ndarray:
    """Where windows begin that hold a block at one of the places."""
    mark = np.zeros(n_words + 2, np.int64)
    low = np.maximum(places.astype(np.int64) - (window - size), 0)
    np.add.at(mark, low, 1)
    np.add.at(mark, places.astype(np.int64) + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: max(0, n_words - window + 1)] > 0)


JOINED = "doc_id long, row long, n_words long, kept_sha256 string, text string, part int, kind int, blob binary"
_JOINED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _candidates(docs: DataFrame, hits: DataFrame, size: int, window: int, parts: int) -> DataFrame:
    """A row for each document, settled where it has no hit, else with its text; and rows with packed digests of its windows."""

    def run(batches):
        from xxhash import xxh3_128_digest

        held, windows = [], 0

        def flush():
            nonlocal windows
            windows = 0
            if not held:
                return
            who, docs, own, h, rest, starts = _put_together(held)
            for rb in _send(_least(h, who, docs, rest), h, starts, rest, who, docs, own, parts):
                none = [pa.nulls(rb.num_rows, f.type) for f in list(_JOINED)[:5]]
                yield pa.RecordBatch.from_arrays([*none, *rb.columns], schema=_JOINED)

        for rows in _met(batches):
            out = []
            for doc, row, text, found in rows:
                words = (text or "").encode().split()
                starts = () if found is None else _starts(found, size, window, len(words))
                if not len(starts):
                    out.append((doc, row, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), None))
                    continue
                joined = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                begin = np.concatenate([[0], ends[:-1] + 1])
                raw = b"".join(xxh3_128_digest(joined[a:b]) for a, b in zip(begin[starts].tolist(), ends[starts + window - 1].tolist()))
                digests = np.frombuffer(raw, "<u8").reshape(-1, 2)
                held.append((doc, row, digests[:, 0].copy(), digests[:, 1].astype(np.uint32), starts.astype(np.uint32)))
                windows += len(starts)
                out.append((doc, row, len(words), None, text))
                if windows >= FLUSH_WORDS:
                    yield from flush()
            cols = [pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, _JOINED)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(out), f.type) for f in list(_JOINED)[5:])], schema=_JOINED)
        yield from flush()

    return _meet(docs, hits, parts).mapInArrow(lambda batches: trimmed(run(batches)), JOINED)


def _repeats(blobs: DataFrame, parts: int) -> DataFrame:
    """Starts of windows whose digest a smaller doc_id has too."""

    def run(batches):
        for index, probe in _groups(batches, False):
            if probe is None:
                continue
            h, least, rest = index
            key, docs, places, rows, other = probe
            at = np.minimum(np.searchsorted(h, key), len(h) - 1)
            hit = (h[at] == key) & (rest[at] == other) & (least[at] < docs)
            if hit.any():
                yield rows[hit], places[hit]

    return blobs.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(lambda batches: trimmed(_sent(run(batches), parts)), HITS)


REMOVED = "doc_id long, row long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, *, window: int = 50, texts: bool = False) -> DataFrame:
    """doc_id and text to doc_id, n_words, n_removed, kept_sha256 and, with texts, kept: what is left of a changed text, else null.

    A row for each row of docs. A null text has no words. Rows without doc_id are smaller than none and none is smaller than
    they are, so they keep all; rows that share a doc_id are one document to the others and never repeats of each other. Each row is
    cut at the places of its own text: row, a hash of doc_id and text, names it, so rows alike in both are cut alike.
    """
    spark, size = docs.sparkSession, window // 2
    bounded_batches(spark)
    parts = partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    hits = stored(_anchors(_blocks(rows, size, parts), parts), "hits", compact=True)
    seen = stored(_candidates(rows, hits, size, window, parts), "candidates", compact=True)
    forget(hits)
    blobs = seen.where("part is not null").select("part", "kind", "blob")
    starts = stored(_repeats(blobs, parts), "repeats", compact=True)

    def cut(batches):
        for rows in _met(batches):
            out = []
            for doc, row, text, found in rows:
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if found is not None:
                    at = found.astype(np.int64)
                    at = at[at + window <= len(words)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                stays = np.cumsum(gone)[: len(words)] == 0
                kept = b" ".join(w for w, s in zip(words, stays.tolist()) if s)
                removed = int((~stays).sum())
                out.append((doc, row, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if texts and removed else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "row", "n_words", "n_removed", "kept_sha256", "kept"])

    settled = seen.where("kept_sha256 is not null").select("doc_id", "row", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    open_ = _meet(seen.where("text is not null").select("doc_id", "row", "text"), starts, parts).mapInArrow(lambda batches: trimmed(cut(batches)), REMOVED)
    out = settled.unionByName(open_)
    return out if texts else out.drop("row", "kept")


def without_repeats(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """The rows of docs with repeats cut from their texts; rows of which nothing is left go. Columns as they are.

    Null and empty texts stay as they are, as do rows without doc_id; rows that share a doc_id are cut each by its own text, and
    rows alike in both stay as many as they were. n_chars, if there, is that of what is left.
    """
    key, kept = fresh("_row", docs), fresh("_kept", docs)
    left = remove_repeats(docs, window=window, texts=True).where("kept is not null").groupBy("row").agg(F.first("kept").alias(kept)).withColumnRenamed("row", key)
    out = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text")).join(left, key, "left").where(F.col(kept).isNull() | (F.col(kept) != ""))
    changed = F.col(kept).isNotNull()
    out = out.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
