"""Content-addressed store of token ids.

A rolling hash over ids cuts each document's stream into chunks; a chunk is stored once, under the digest of its ids,
and a document is a recipe: the digests of its chunks in order. Files, all Parquet, in one folder:

* data/kind=chunk: digest, n_ids, ids (little-endian; 16 bits where the vocabulary allows, else 32), dealt by digest
* recipes: doc_id, row, start, n_ids, digests, root (Merkle root over the digests), part; in ascending doc_id order, part by part
* manifest: for each part its documents, ids, first start and the Merkle root over its documents in order; part -1 has the root over parts

Reading verifies all of it: recipes against the manifest, digests against their recipe's root, chunks against their digests.
`documents` puts ids together again. A CRC-32 of a document needs no reassembly: CRCs are linear, so each chunk's CRC is
shifted by the ids after it and the shares are added (exclusive or).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, delete, new_path, partitions, running_total, tidy, trimmed
from .tokens import default_tokenizer, packed

#: Parameters of the format: ids under the rolling hash, mean, least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 1024
FILES = "kind string, digest binary, n_ids long, ids binary, doc_id long, row long, digests array<binary>, root binary"
RECIPE = "doc_id long, row long, start long, n_ids long, digests array<binary>, root binary, part int"
MANIFEST = "part int, first_doc long, last_doc long, n_docs long, n_ids long, start long, root binary"
POLY = 0xEDB88320


class DamagedStore(ValueError):
    """Files of a store do not agree with one another."""


def digest_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=20).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; the empty list has the digest of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=20).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=20).digest() for i in range(0, len(level), 2)]
    return level[0] if level else digest_of(b"")


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows of WINDOW ids whose rolling hash makes a cut, in a stream of any documents one after another."""
    n = len(ids)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        # sum of the last WINDOW values, each times its distance from the end: depends on their order, rolls by two running sums
        total, weighted = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        np.cumsum(x * np.arange(n, dtype=np.uint64), out=weighted[1:])
        h = np.arange(WINDOW, n + 1, dtype=np.uint64) * (total[WINDOW:] - total[:-WINDOW]) - (weighted[WINDOW:] - weighted[:-WINDOW])
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return np.flatnonzero((h & np.uint64(MEAN - 1)) == 0) + WINDOW


def cut_points(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids, from the marks within it."""
    ends, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encodes doc_id and text (null: empty) with an end id each and writes the store to `path`.

    A task sends a chunk once, however often it occurs there, so a chunk that a third of all documents hold meets once for each task.
    """
    source, spark = tokenizer or default_tokenizer(), docs.sparkSession
    bounded_batches(spark)

    def emit(batches):
        tok, sent = packed(source), set()
        end = np.asarray([end_id], dtype="<u4").tobytes()
        short = tok.vocabulary <= 65536 and end_id < 65536
        for batch in batches:
            rows, encoded = [], [raw + end for raw in tok.encode(batch.column(2).to_pylist())]
            sizes = np.asarray([len(x) // 4 for x in encoded], np.int64)
            stop = np.cumsum(sizes)
            ids = np.frombuffer(b"".join(encoded), dtype="<u4")
            width, data = (2, ids.astype("<u2").tobytes()) if short else (4, ids.tobytes())
            cuts = marks(ids)
            # a window must lie within its document
            cuts = cuts[cuts - (stop - sizes)[np.searchsorted(stop, cuts)] >= WINDOW]
            bounds = np.searchsorted(cuts, stop - sizes, side="right").tolist()
            ends_at = np.searchsorted(cuts, stop, side="right").tolist()
            for doc, row, n, to_, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes.tolist(), stop.tolist(), bounds, ends_at):
                first, at, recipe = to_ - n, 0, []
                for to in cut_points(n, (cuts[a:b] - first).tolist()):
                    chunk = data[(first + at) * width : (first + to) * width]
                    name = digest_of(chunk)
                    recipe.append(name)
                    if name not in sent:
                        if len(sent) >= 500_000:
                            sent.clear()
                        sent.add(name)
                        rows.append(("chunk", name, to - at, chunk, None, None, None, None))
                    at = to
                rows.append(("recipe", None, n, None, doc, row, recipe, merkle(recipe)))
            cols = list(zip(*rows))
            types = (pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary())
            names = ("kind", "digest", "n_ids", "ids", "doc_id", "row", "digests", "root")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)] if rows else [pa.array([], t) for t in types], names=names)

    n = partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(lambda batches: trimmed(emit(batches), source), FILES)
    dealt = rows.withColumn("_key", F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "row"))).repartition(n, "_key")
    before = F.lag("digest").over(Window.partitionBy("_key").orderBy("kind", "digest"))
    once = dealt.withColumn("_before", before).where("digest is null or _before is null or digest <> _before").drop("_key", "_before")
    with tidy(spark):
        # one pass over the texts writes both kinds; recipes then go where their doc_id puts them
        once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
        recipes = _kind(spark, path, "recipe").select("doc_id", "row", "n_ids", "digests", "root")
        ordered = running_total(recipes, ["doc_id", "row"], "n_ids", "start", n)
        ordered.select(*_names(RECIPE)).write.option("compression", "zstd").parquet(f"{path}/recipes")
    delete(spark, f"{path}/data/kind=recipe")
    parts = _parts(_recipes(spark, path))
    # a row for each part of the recipes
    spark.createDataFrame([*parts, _whole(parts)], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = FILES.replace("kind string, ", "") + ", kind string"
    return spark.read.schema(schema).parquet(f"{path}/data").where(F.col("kind") == kind).drop("kind")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPE).parquet(f"{path}/recipes")


def _parts(recipes: DataFrame) -> list[tuple]:
    """Rows of the manifest, by part, as the recipes have them."""

    def one(found: pa.Table) -> pa.Table:
        rows = sorted(zip(*(found[c].to_pylist() for c in ("doc_id", "row", "start", "n_ids", "root"))), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        leaves = [struct.pack("<?qqqq", d is None, d or 0, r, s, n) + root for d, r, s, n, root in rows]
        out = [found["part"][0].as_py(), rows[0][0], rows[-1][0], len(rows), sum(r[3] for r in rows), rows[0][2], merkle(leaves)]
        types = (pa.int32(), *[pa.int64()] * 5, pa.binary())
        return pa.table({c: pa.array([v], t) for c, v, t in zip(_names(MANIFEST), out, types)})

    narrow = recipes.select("doc_id", "row", "start", "n_ids", "root", "part")
    return sorted(tuple(r) for r in narrow.groupBy("part").applyInArrow(one, MANIFEST).collect())


def _whole(parts: list[tuple]) -> tuple:
    return (-1, None, None, sum(p[3] for p in parts), sum(p[4] for p in parts), 0, merkle([struct.pack("<iqqq", p[0], *p[3:6]) + p[6] for p in parts]))


def verify(spark: SparkSession, path: str) -> None:
    """Holds the recipes against the manifest, and that against itself: each part's root and starts, and the root over all."""
    told = sorted(tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect())
    parts, at = [p for p in told if p[0] >= 0], 0
    if [p for p in told if p[0] < 0] != [_whole(parts)]:
        raise DamagedStore("the manifest does not match its root")
    for p in parts:
        if p[5] != at:
            raise DamagedStore(f"part {p[0]} of the manifest starts at another id")
        at += p[4]
    if _parts(_recipes(spark, path)) != parts:
        raise DamagedStore("the recipes do not match the manifest")


def _shift_tables() -> list[np.ndarray]:
    """In table k at v, what v * 256**k further ids do to a CRC: x to the power of 32 times that many, modulo the polynomial."""
    power = np.full(1, 1 << 30, np.uint32)  # x
    for _ in range(5):
        power = _times(power, power)
    out = []
    for _ in range(6):
        table = np.zeros(256, np.uint32)
        table[0] = 1 << 31  # one
        for k in range(8):
            table[1 << k : 2 << k] = _times(table[: 1 << k], np.full(1 << k, power[0], np.uint32))
            power = _times(power, power)
        out.append(table)
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC polynomial, bits reversed as in CRC-32."""
    a, b = a.astype(np.uint32), b.astype(np.uint32).copy()
    out = np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0)).astype(np.uint32)
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(POLY), b >> np.uint32(1)).astype(np.uint32)
    return out


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The share of a chunk's CRC in that of a document that has `after` further 32-bit ids."""
    if not _tables:
        _tables.extend(_shift_tables())
    out = crc.astype(np.uint32)
    for k, table in enumerate(_tables):
        part = (after >> (8 * k)) & 255
        if not after.size or not (after >> (8 * k)).any():
            break
        out = _times(out, table[part])
    return out


_tables: list[np.ndarray] = []


def _uses(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each recipe, whose digests are held against its root."""

    def spread(batches):
        for batch in batches:
            lists = batch.column(4)
            names, roots = lists.to_pylist(), batch.column(5).to_pylist()
            if any(merkle(n) != r for n, r in zip(names, roots)):
                raise DamagedStore("a recipe does not match its Merkle root")
            sizes = np.asarray([len(n) for n in names], np.int64)
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(4)), pa.array(nth.astype(np.int32)), lists.flatten()], names=["doc_id", "row", "start", "n_ids", "nth", "digest"])

    bounded_batches(spark)
    return _recipes(spark, path).select("doc_id", "row", "start", "n_ids", "digests", "root").mapInArrow(spread, "doc_id long, row long, start long, n_ids long, nth int, digest binary")


def _chunks(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """digest, k (number of ids) and crc (of 32-bit ids), or with ids the bytes of 32-bit ids, of chunks that match their digests."""

    def run(batches):
        for batch in batches:
            data = batch.column(2).cast(pa.binary())
            at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            raw, n = memoryview(data.buffers()[2] or b""), batch.column(1).to_numpy(zero_copy_only=False)
            width = 2 if np.array_equal(np.diff(at), 2 * n) else 4
            if not np.array_equal(np.diff(at), width * n):
                raise DamagedStore("a chunk does not match its digest: it has another length")
            wide = memoryview(np.frombuffer(raw[at[0] : at[-1]], dtype=f"<u{width}").astype("<u4")).cast("B") if len(data) else None
            out, first, scale = [], int(at[0]) if len(at) else 0, 4 // width
            for name, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if digest_of(raw[a:b]) != name:
                    raise DamagedStore(f"chunk {name.hex()} does not match its digest")
                own = wide[(a - first) * scale : (b - first) * scale]
                out.append(bytes(own) if ids else zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary() if ids else pa.int64())], names=["digest", "k", "x"])

    bounded_batches(spark)
    return _kind(spark, path, "chunk").select("digest", "n_ids", "ids").mapInArrow(run, f"digest binary, k long, x {'binary' if ids else 'long'}")


def _gathered(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """By document: doc_id, row, start, n_ids and its chunks in any order (as many as its length allows)."""
    verify(spark, path)
    placed = _uses(spark, path).join(_chunks(spark, path, ids), "digest", "left")
    first = [F.first(c).alias(c) for c in ("doc_id", "start", "n_ids")]
    return placed.groupBy("row").agg(*first, F.collect_list(F.struct("nth", "k", "x")).alias("chunks")).select("doc_id", "row", "start", "n_ids", "chunks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, verified, in no order."""

    def sums(batches):
        for batch in batches:
            lists, n = batch.column(4), batch.column(3).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            if flat.field(2).null_count:
                raise DamagedStore("a chunk is missing")
            nth, k, crc = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            sizes = np.asarray(lists.value_lengths())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((nth, doc))
            k, crc = k[order], crc[order]
            begin = np.cumsum(sizes) - sizes
            total = np.add.reduceat(k, begin) if len(k) else k
            if not np.array_equal(total, n):
                raise DamagedStore("a document's chunks do not add up")
            through = np.cumsum(k)
            after = np.repeat(through[begin + sizes - 1], sizes) - through
            out = np.bitwise_xor.reduceat(shifted(crc, after), begin).astype(np.int64) if len(k) else k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _gathered(spark, path).mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array<long>, with the end id) of each document, put together from its chunks, verified, in no order."""

    def joined(batches):
        for batch in batches:
            out = []
            for n, chunks in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if any(c["x"] is None for c in chunks):
                    raise DamagedStore("a chunk is missing")
                raw = b"".join(c["x"] for c in sorted(chunks, key=lambda c: c["nth"]))
                if len(raw) != 4 * n:
                    raise DamagedStore("a document's chunks do not add up")
                out.append(np.frombuffer(raw, "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return _gathered(spark, path, True).mapInArrow(joined, "doc_id long, start long, ids array<long>")


def store_documents(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the store to `path` (default: a new one in the shared folder) and returns what its files say.

    Null texts are empty: their end id alone. Rows that share a doc_id, or have none (first in order), are documents each.
    """
    path = path or new_path(docs.sparkSession, "token-store")
    write(docs, path, tokenizer=tokenizer, end_id=end_id)
    return read(docs.sparkSession, path)
