"""SimHash fingerprints of word shingles and their groups, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is read as segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code of length 23
(with leading zeros). A word decodes to the one codeword within 3 bits; `near` has the codewords within 4, that one and none
or five more. Two words that differ in one bit: what one decodes to is near the other. Two that differ in at most two: they
share a near codeword (tests prove both over all words up to translation). Of at most 4 errors over three segments,

* either no segment is free of errors, so two of them have exactly one: keys are pairs of codewords of two segments, decoded
  ones on one side, near ones on the other;
* or one is free of errors and another has at most two: keys are an exact segment and a near codeword of another.

So each linked pair shares a key, and a join on keys with the Hamming distance as its condition finds it. Fingerprints meet
once each, however many documents have them, and within a key first only the least fingerprint and the next smaller one are
compared with each: the components of those links stand for their members after that, and only members of different
components are joined. So a large group of near copies makes rows in proportion to its size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, bounded_batches, stored
from .components import components

BITS = 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0xAE3


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Of a whole text: lower-case A-Z, words between ASCII white space, shingles with repeats; XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if len(parts) <= words:
        return np.asarray([xxh64_intdigest(b" ".join(parts), 42)] if parts else [], np.uint64)
    joined = b" ".join(parts)
    ends = (np.cumsum([len(p) + 1 for p in parts]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: -words]]]
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = 4) -> int:
    """The bits that more than half of a text's shingle hashes have."""
    h = shingle_hashes(text, words)
    return _majority(h) if len(h) else 0


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _majority(h: np.ndarray) -> int:
    columns = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and text to doc_id and the fingerprint as a signed long. A null text has no words, and so zero."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            values = np.asarray([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Decoding tables of the (23, 12) code, built from its generator."""

    def __init__(self):
        rest = [self._rest(1 << k) for k in range(23)]
        low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for k in range(12):
            low ^= np.where((np.arange(1 << 12) >> k) & 1, rest[k], 0)
        for k in range(11):
            high ^= np.where((np.arange(1 << 11) >> k) & 1, rest[12 + k], 0)
        self.low, self.high = low, high
        lists: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for places in combinations(range(23), weight):
                s = 0
                for p in places:
                    s ^= rest[p]
                lists[s].append(sum(1 << p for p in places))
        #: error patterns of up to 4 bits by syndrome, the lightest first; -1 where there are fewer than six
        self.patterns = np.full((1 << 11, 6), -1, np.int64)
        for s, found in enumerate(lists):
            self.patterns[s, : len(found)] = found

    @staticmethod
    def _rest(x: int) -> int:
        while x.bit_length() > 11:
            x ^= GENERATOR << (x.bit_length() - 12)
        return x

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """12-bit numbers of the codewords within 4 bits, a row of six for each word, the decoded one first; which of them there are."""
        e = self.patterns[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        return (words[:, None] ^ np.maximum(e, 0)) >> 11, e >= 0


_code: list[Golay] = []


def keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints (unsigned), parallel arrays: position in values, key, whether the key is one that others probe."""
    if not _code:
        _code.append(Golay())
    code, at, out, own = _code[0], [], [], []
    parts = [((values >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    near = [code.near(p) for p in parts]
    index = np.arange(len(values))
    for kind, (a, b) in enumerate(combinations(range(3), 2)):
        (x, has_x), (y, has_y) = near[a], near[b]
        both = (x[:, :, None] << 12 | y[:, None, :]) | kind << 56
        there = has_x[:, :, None] & has_y[:, None, :]
        first = np.zeros((6, 6), bool)
        first[0, 0] = True
        at.append(np.broadcast_to(index[:, None, None], there.shape)[there])
        out.append(both[there])
        own.append(np.broadcast_to(first, there.shape)[there])
    for kind, (a, b) in enumerate(((a, b) for a in range(3) for b in range(3) if a != b), start=3):
        y, there = near[b]
        both = (parts[a][:, None] << 12 | y) | kind << 56
        at.append(np.broadcast_to(index[:, None], there.shape)[there])
        out.append(both[there])
        own.append(np.ones(int(there.sum()), bool))
    return np.concatenate(at), np.concatenate(out), np.concatenate(own)


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def linked(values: DataFrame, n: int) -> DataFrame:
    """(node, root) of the components of distinct fingerprints `fp` that have a link at up to 4 differing bits."""

    def spread(batches):
        for batch in batches:
            for from_ in range(0, batch.num_rows, 5_000):
                fp = batch.column(0).slice(from_, 5_000).to_numpy(zero_copy_only=False)
                at, key, own = keys(fp.astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(own)], names=["key", "fp", "own"])

    entries = values.select("fp").mapInArrow(spread, "key long, fp long, own boolean").repartition(n, "key")
    whole, sorted_ = Window.partitionBy("key"), Window.partitionBy("key").orderBy("fp")
    met = entries.withColumns({"_n": F.count("*").over(whole), "_own": F.max("own").over(whole), "_least": F.min("fp").over(whole), "_last": F.lag("fp").over(sorted_)})
    met = stored(met.where("_n > 1 and _own").drop("_n", "_own"), "met")
    near = [met.where((F.col("fp") != F.col(c)) & (_distance("fp", c) <= BITS)).select(F.col("fp").alias("a"), F.col(c).alias("b")) for c in ("_least", "_last")]
    near_links = stored(near[0].union(near[1]).distinct(), "near")
    roots = components(near_links)
    # Where all that share a key are of one component there is nothing more to find.
    known = roots.select(F.col("node").alias("fp"), "root")
    rest = met.drop("_least", "_last").join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rest = rest.withColumns({"_min": F.min("root").over(whole), "_max": F.max("root").over(whole)}).where("_min <> _max").drop("_min", "_max")
    rest = stored(rest, "rest")
    one, two = (rest.select(F.col("key").alias(f"key_{x}"), F.col("fp").alias(x), F.col("root").alias(f"root_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
    more = one.where("own_a").join(two, (F.col("key_a") == F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & (_distance("a", "b") <= BITS))
    return components(near_links.union(more.select("a", "b")))


def groups(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (signed), fingerprint (hex) and component_id, a row for each row of docs.

    A component's id is the least doc_id that links reach. Null doc_ids never name one, unless no other is there. Documents
    without words, null texts among them, have fingerprint zero and are linked like any other; repeated rows are one group.
    """
    n = partitions(docs)
    found = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = linked(distinct, n).select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(named, "fp").select("doc_id", "fp", hexed, "component_id")


def keep_one(docs: DataFrame, words: int = 4) -> DataFrame:
    """The rows of docs with the least doc_id of their group; of rows that repeat a doc_id, one stays. Columns as they are.

    Rows without doc_id belong to no group here and all stay.
    """
    first = groups(docs, words).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)
