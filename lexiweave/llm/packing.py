"""Best-fit packing of token streams into sequences of at most `capacity` tokens.

Bulk-synchronous best fit. Documents still to be placed, and gaps (the free ends of open sequences), are tables. Classes of lengths
are placed one after another, each up to twice its lower bound, longest class first. A round of a class

1. range-sorts documents and gaps together, from large to small, a gap before documents of its size;
2. sweeps each range: a document takes the smallest gap of its range that holds it, and what is left of that gap is there for the range's next
   documents. What a range leaves over, gaps and documents, is numbered; how many there are is carried from range to range (two
   numbers for each), and by its rank each document left over takes the last gap left over by the ranges before its own;
3. updates the gaps; those that took no document, and what is left of the others, are there in the next round.

In step 2 a gap that holds several documents of the longest length left offers as many slots. Rounds go on while some gap may hold
a document left; when none does, as many sequences are opened as those that are left need in any case (by their sizes in
all, and by how many of the shortest fit in one). Documents and gaps that are few enough for one range are finished in it, which opens
sequences itself. All is done by rows in executors; the driver sees counts by size alone, which are as many as a
sequence has tokens, and those two numbers for each range.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, partitions, stored, trimmed
from .tokens import default_tokenizer, packed

PIECES = "doc_id long, _row long, piece int, start long, length long, ids_crc32 long"
#: Rows that a range of a sweep is made for. Lengths of a 1 / CLASSES of a sequence and less are one class.
RANGE_ROWS, CLASSES = 100_000, 4


def token_pieces(docs: DataFrame, *, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id and text to pieces of at most `capacity` ids. Only longer documents are cut; their first piece takes the rest.

    A null text is empty, so it has its end id alone. Rows with the same doc_id stay apart by their `_row`, a number without meaning.
    """
    path = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)

    def cut(batches):
        tok, end = packed(path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tok.encode(batch.column(2).to_pylist())):
                ids, at, k = ids + end, 0, 0
                n = len(ids) // 4
                size = n % capacity or capacity
                while at < n:
                    for c, v in zip(cols, (doc, row, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]))):
                        c.append(v)
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "_row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), "text")
    return rows.mapInArrow(lambda batches: trimmed(cut(batches), path), PIECES)


#: kind 0: a slot of a gap that is left over, 1: a document left over, 2: a document and where it is, 3: a gap too small for later ranges.
#: nth counts those of a kind in their range.
SWEPT = "part int, kind int, nth long, id long, length long, seq long, slot int, room long"


def swept(lengths: list[int], rooms: list[int], capacity: int, opens: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit of documents in their order: the gap (a number; opened ones follow on) and its room before for each, (-1, 0) for those
    left over, and the room of all gaps after it. Of gaps of a size the last is taken."""
    after, where = list(rooms), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for gap, room in enumerate(rooms):
        by_room[room].append(gap)
        mask |= 1 << room
    for length in lengths:
        fit = mask >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            gap = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        elif opens:
            room, gap = capacity, len(after)
            after.append(capacity)
        else:
            where.append((-1, 0))
            continue
        where.append((gap, room))
        after[gap] = left = room - length
        if left:
            by_room[left].append(gap)
            mask |= 1 << left
    return where, after


def _sweep(docs: DataFrame, gaps: DataFrame | None, most: int, n: int, capacity: int, opened: int) -> DataFrame:
    """One round's sweep of docs (id, length), of at most `most` tokens, and gaps (seq, room) over n ranges; one range opens sequences."""
    none = F.lit(None).cast("long")
    events = docs.select(F.col("length").alias("size"), F.lit(1).alias("is_doc"), "id", none.alias("seq"))
    if gaps is not None:
        events = events.unionAll(gaps.select(F.col("room").alias("size"), F.lit(0).alias("is_doc"), none.alias("id"), "seq"))
    order = [F.desc("size"), "is_doc", "id", "seq"]

    def run(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        part = TaskContext.get().partitionId()
        size, doc = table["size"].to_numpy(), table["is_doc"].to_numpy() > 0
        ids, seqs = table["id"].filter(pa.array(doc)).to_numpy(), table["seq"].filter(pa.array(~doc)).to_numpy()
        lengths, rooms = size[doc], size[~doc]
        where, after = swept(lengths.tolist(), rooms.tolist(), capacity, n == 1)
        gap, room = (np.array([w[k] for w in where], np.int64) for k in (0, 1))
        seqs = np.concatenate([seqs, opened + np.arange(len(after) - len(seqs))]).astype(np.int64)
        after = np.array(after, np.int64)

        def out(kind, **columns):
            k = len(next(iter(columns.values())))
            full = {"part": np.full(k, part), "kind": np.full(k, kind), "nth": np.arange(k)} | columns
            types = {"int": pa.int32(), "long": pa.int64()}
            fields = [c.split() for c in SWEPT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(full[c], types[t]) if c in full else pa.nulls(k, types[t]) for c, t in fields], names=[c for c, _ in fields])

        at = gap >= 0
        if at.any():
            yield out(2, id=ids[at], length=lengths[at], seq=seqs[gap[at]], room=room[at])
        if not at.all():
            yield out(1, id=ids[~at], length=lengths[~at])
        # later ranges have no document above this one's least size: what is left of gaps, if it holds that, is offered to them by
        # slots, from large to small, so that the last is the smallest
        for kind, free in ((0, np.flatnonzero(after >= size[-1])), (3, np.flatnonzero((after > 0) & (after < size[-1])))):
            free = free[np.argsort(-after[free], kind="stable")]
            slots = np.maximum(1, after[free] // most) if n > 1 and kind == 0 else np.ones(len(free), np.int64)
            if len(free):
                nth = np.arange(int(slots.sum())) - np.repeat(np.cumsum(slots) - slots, slots) + 1
                yield out(kind, seq=np.repeat(seqs[free], slots), slot=nth.astype(np.int32), room=np.repeat(after[free], slots))

    # equal sizes are told apart by their numbers, so no size makes a range longer
    dealt = events.repartitionByRange(n, *order) if n > 1 else events.coalesce(1)
    return stored(dealt.sortWithinPartitions(*order).mapInArrow(lambda b: trimmed(run(b)), SWEPT), "swept")


def carried(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of (range, slots left over, documents left over), by range: (kind, range, from, to, number of the first pair).

    A range's documents come after the slots of the ranges before it, and take the last ones first; nth of slots runs against that.
    """
    stack: list[tuple[int, int]] = []
    out, pair = [], 0
    for part, slots, docs in sorted(left):
        a = 0
        while a < docs and stack:
            at, free = stack.pop()
            n = min(docs - a, free)
            out.append((1, part, a, a + n, pair))
            out.append((0, at, free - n, free, pair))
            a, pair = a + n, pair + n
            if free > n:
                stack.append((at, free - n))
        if slots:
            stack.append((part, slots))
    return out


def _round(docs: DataFrame, gaps: DataFrame | None, least: int, most: int, n: int, capacity: int, opened: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a round places (id, seq, offset), the documents left (id, length), and all gaps after it (seq, room)."""
    rows = _sweep(docs, None if gaps is None else gaps.where(F.col("room") >= least), most, n, capacity, opened)
    placed = rows.where("kind = 2").select("id", "seq", (capacity - F.col("room")).alias("offset"))
    left, after = rows.where("kind = 1"), rows.where("kind in (0, 3) and slot = 1").select("seq", "room")
    if n > 1:
        counts = rows.where("kind < 2").groupBy("part").agg(F.count_if(F.col("kind") == 0).alias("slots"), F.count_if(F.col("kind") == 1).alias("docs")).collect()
        found = carried([tuple(r) for r in counts])
        if found:
            # at most a few rows for each range
            ranges = F.broadcast(docs.sparkSession.createDataFrame(found, "kind int, part int, from long, to long, first long"))
            over = rows.where("kind < 2").join(ranges, ["kind", "part"]).where("nth >= from and nth < to")
            rank = F.when(F.col("kind") == 1, F.col("nth") - F.col("from")).otherwise(F.col("to") - 1 - F.col("nth"))
            over = over.withColumn("pair", F.col("first") + rank)
            of_docs, of_slots = over.where("kind = 1").select("pair", "id", "length"), over.where("kind = 0").select("pair", "seq", "slot", "room")
            pairs = of_docs.join(of_slots, "pair")
            before = F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
            placed = placed.unionAll(pairs.select("id", "seq", (capacity - F.col("room") + F.coalesce(before, F.lit(0))).alias("offset")))
            used = pairs.groupBy("seq").agg(F.sum("length").alias("used"))
            after = after.join(used, "seq", "left").select("seq", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).where("room > 0")
            here = (left["part"] == ranges["part"]) & (ranges["kind"] == 1) & (left["nth"] >= ranges["from"]) & (left["nth"] < ranges["to"])
            left = left.join(ranges, here, "left_anti")
    if gaps is not None:
        after = after.unionAll(gaps.where(F.col("room") < least))
    return placed, left.select("id", "length"), after


def _sizes(docs: DataFrame, gaps: DataFrame | None) -> tuple[dict[int, int], dict[int, int]]:
    """How many documents there are of each length, and gaps of each size: at most as many numbers as a sequence has tokens."""
    both = docs.select(F.lit(1).alias("is_doc"), F.col("length").alias("size"))
    if gaps is not None:
        both = both.unionAll(gaps.select(F.lit(0).alias("is_doc"), F.col("room").alias("size")))
    found = both.groupBy("is_doc", "size").count().collect()
    return tuple({r["size"]: r["count"] for r in found if r["is_doc"] == k} for k in (1, 0))


def _placements(docs: DataFrame, capacity: int, n_most: int) -> DataFrame:
    """id and length (1 to capacity) to id, seq and offset."""
    spark = docs.sparkSession
    gaps, opened, high = None, 0, capacity
    out: list[DataFrame] = []
    while high:
        low = high // 2 if high // 2 >= capacity // CLASSES else 0
        left = docs.where((F.col("length") > low) & (F.col("length") <= high))
        lengths, rooms = _sizes(docs.where(F.col("length") <= high), gaps)
        if sum(lengths.values()) + sum(rooms.values()) <= RANGE_ROWS:
            low, left = 0, docs.where(F.col("length") <= high)
        lengths, high = {size: k for size, k in lengths.items() if size > low}, low
        while lengths:
            least, most, count = min(lengths), max(lengths), sum(lengths.values())
            able = sum(k for size, k in rooms.items() if size >= least)
            n = max(1, min(n_most, -(-(count + able) // RANGE_ROWS)))
            if not able and n > 1:
                # what is left needs so many sequences in any packing
                able = max(-(-count // (capacity // least)), -(-sum(size * k for size, k in lengths.items()) // capacity))
                new = spark.range(opened, opened + able).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("room"))
                gaps = new if gaps is None else gaps.unionAll(new)
                opened += able
            placed, left, gaps = _round(left, gaps, least, most, n, capacity, opened)
            out.append(placed)
            if high or n > 1:
                gaps = stored(gaps, "gaps")
            if n == 1:
                # one range has placed all of them
                opened = max(opened, (placed.agg(F.max("seq")).head()[0] or 0) + 1) if high else opened
                break
            lengths, rooms = _sizes(left, gaps)
    result = out[0] if out else spark.createDataFrame([], "id long, seq long, offset long")
    for placed in out[1:]:
        result = result.unionAll(placed)
    return result


def pack(pieces: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to capacity (others are an error); columns of these names are replaced.

    Other columns stay, repeated rows are rows of their own, and which of several rows of a length comes first means nothing. No rows: no rows.
    """
    id_ = fresh("_id", pieces)
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    numbered = stored(pieces.select(*kept).withColumn(id_, F.monotonically_increasing_id()), "pieces")
    plain = numbered.select(F.col(id_).alias("id"), F.col("length").cast("long").alias("length"))
    if not plain.where(f"length is null or length < 1 or length > {capacity}").isEmpty():
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    # pieces as long as a sequence are one; all others are placed in rounds
    alone = plain.where(F.col("length") == capacity).select("id", (-1 - F.col("id")).alias("seq"), F.lit(0).cast("long").alias("offset"))
    found = alone.unionAll(_placements(plain.where(F.col("length") < capacity), capacity, max(partitions(pieces), 2)))
    found = found.select(F.col("id").alias(id_), F.col("seq").alias("sequence_id"), "offset")
    return numbered.join(found, id_).select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id and text to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, capacity=capacity, tokenizer=tokenizer, end_id=end_id).drop("_row"), capacity=capacity)
