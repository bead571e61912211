"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Phrases are runs of `size` words of a benchmark item (all of a shorter one). The index keeps postings (term, document,
position) of the terms that queries start from. For each phrase these are its rarest ones in the whole corpus; terms that
are too frequent to sift much are left out of a phrase's list, unless it has no other. A posting less its term's place in an
item is an alignment of the item in the document; alignments at which all the chosen terms of some phrase meet are compared
with the document's words, and the exact matches are what counts.

What is broadcast are terms, places and items of the benchmark, and candidates, each only while its rows take few bytes
(`common.small`); beyond that the same joins shuffle, frequent terms dealt over SALTS tasks each. Documents are read twice as a whole,
for counts and for postings, and those with candidates once more; they are never sorted or gathered. A document's number of
words comes as a posting of its own, of the empty term, whose position it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, fresh, small, stored

#: Tasks that the occurrences of a term are dealt over where terms are too many to broadcast.
SALTS = 64
#: Terms to intersect for a phrase, and how many words of text there must be for each occurrence of a term that is not its rarest.
TERMS, SIFT = 3, 2_000
#: ASCII letters and digits and all that is not ASCII make words; the rest of ASCII, and A-Z, is translated.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: Column) -> Column:
    """Words of a whole text with A-Z in lower case; null has none. A translation and a split at spaces: no regular expression."""
    plain = F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is known by its id and its text, so repeated ids do no harm; null ids are all right."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64("text").alias("_t"), "text")


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences (item, words), and the ids that have each (item, item_id)."""
    all_ = stored(benchmark.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0").withColumn("item", F.sha2(F.array_join("words", " "), 256)), "items")
    return stored(all_.dropDuplicates(["item"]).select("item", "words"), "items"), all_.where("item_id is not null").select("item", F.col("item_id").cast("string").alias("item_id")).distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: a row (_d, _t, term, pos) for each occurrence of one of the terms, and one of the empty term at a document's end."""
    ended = F.concat(words(F.col("text")), F.array(F.lit("")))
    every = docs.select("_d", "_t", F.posexplode(ended).alias("pos", "term"))
    terms = stored(terms.select("term").union(terms.sparkSession.range(1).select(F.lit(""))).distinct(), "terms")
    few = small(terms)
    if few is not terms:
        return stored(every.join(few, "term"), "postings")
    dealt = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = every.withColumn("_salt", F.pmod(F.xxhash64("_t", "pos"), F.lit(SALTS)).cast("int"))
    return stored(salted.join(dealt, ["term", "_salt"]).drop("_salt"), "postings")


def _anchors(items: DataFrame, counts: DataFrame, total: int, size: int) -> DataFrame:
    """Adds to items: len (of a phrase), phrases (places of the chosen terms of each)."""
    placed = items.select("item", F.posexplode("words").alias("off", "term")).join(counts, "term", "left")
    sorted_ = placed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("off", F.coalesce("n", F.lit(0)).alias("n")))).alias("places"))
    chosen = lambda w: F.array_sort(F.transform(F.slice("places", w + 1, F.col("len")), lambda p: F.struct(p["n"].alias("n"), p["off"].alias("off"))))
    sift = lambda p, k: (k == 0) | (p["n"] * SIFT <= total)
    out = items.join(sorted_, "item").withColumn("len", F.least(F.lit(size), F.size("words")))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("len"))
    return out.withColumn("phrases", F.array_distinct(F.transform(starts, lambda w: F.array_sort(F.transform(F.filter(F.slice(chosen(w), 1, TERMS), sift), lambda p: p["off"]))))).drop("places")


def matches(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Exact occurrences of phrases (_d, _t, item, the places of the document's words under them, and whether one of them has
    `size` words), and a row (_d, _t, n_words) for each row of docs."""
    text = docs.select("_d", "_t", "text")
    vocabulary = stored(items.select(F.explode("words").alias("term")).distinct(), "terms")
    # counted by task before the join, so that a frequent word makes one row a task where the join shuffles
    counted = text.select(F.explode(words(F.col("text"))).alias("term")).join(small(vocabulary), "term", "left_semi").groupBy("term")
    counts = stored(counted.agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).head()[0] or 0
    known = stored(_anchors(items, counts, total, size), "anchors")
    anchors = stored(known.select("item", "words", F.explode(F.array_distinct(F.flatten("phrases"))).alias("off")).select("item", "off", F.element_at("words", F.col("off") + 1).alias("term")), "anchors")
    index = postings(text, anchors)
    n_words = index.where("term = ''").select("_d", "_t", F.col("pos").cast("long").alias("n_words"))
    met = index.join(small(anchors), "term").groupBy("_d", "_t", "item", (F.col("pos") - F.col("off")).alias("at")).agg(F.collect_set("off").alias("offs"))
    met = met.join(small(stored(known.select("item", "phrases", F.size("words").alias("n")), "phrases")), "item").where(F.exists("phrases", lambda p: F.size(F.array_except(p, F.col("offs"))) == 0))
    # one document's alignments; those of a repeated row are found once for each of it
    candidates = stored(met.groupBy("_d", "_t").agg(F.collect_set(F.struct("item", "at", "n")).alias("met")), "candidates")
    found = text.join(small(candidates), ["_d", "_t"]).dropDuplicates(["_d", "_t"]).withColumn("doc", words(F.col("text")))
    # only the words that an item would lie over go on with it, never a document's whole list
    over = lambda m: F.struct(m["item"].alias("item"), m["at"].alias("at"), F.slice("doc", F.greatest(m["at"], F.lit(0)) + 1, m["n"] + F.least(m["at"], F.lit(0))).alias("doc"))
    found = found.select("_d", "_t", F.explode(F.transform("met", over)).alias("m")).select("_d", "_t", "m.*")
    found = found.join(small(stored(known.select("item", "words", "len"), "items")), "item")
    from_ = F.greatest(F.col("at"), F.lit(0))
    same = lambda s: (F.col("at") + s >= 0) & (F.slice("doc", F.greatest(F.col("at") + s - from_, F.lit(0)) + 1, F.col("len")) == F.slice("words", s + 1, F.col("len")))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - F.col("len")), same)
    places = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(F.col("at") + s, F.col("at") + s + F.col("len") - 1))))
    out = stored(found.select("_d", "_t", "item", places.alias("places"), (F.col("len") >= size).alias("full")).where("size(places) > 0"), "matches")
    forget(vocabulary, counts, candidates, anchors)
    return out, n_words


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = 13, full: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (hit words are a twentieth or more), a row for each row of docs.

    Null and empty texts have no words. Items that repeat a text count by their ids; without an id they mark words only. Rows that
    share a doc_id are told apart by their texts. full: adds _d and _t (id and hash of the text) and full, whether some
    window of `size` words occurs.
    """
    rows = _keyed(docs)
    items, ids = items_of(benchmark)
    hit, n_words = matches(rows, items, size)
    hits = F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long")
    by_doc = hit.groupBy("_d", "_t").agg(hits.alias("n_hit"), F.max("full").alias("full"))
    named = hit.select("_d", "_t", "item").distinct().join(small(stored(ids, "ids")), "item").groupBy("_d", "_t").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    out = n_words.join(by_doc.join(named, ["_d", "_t"], "left"), ["_d", "_t"], "left")
    ids_ = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    columns = [
        F.when(F.col("_d") > -(2**63), F.col("_d")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids_).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids_, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    ]
    return out.select(*columns, *(["_d", "_t", F.coalesce("full", F.lit(False)).alias("full")] if full else []))


def proximity(docs: DataFrame, items: DataFrame, *, within: int) -> DataFrame:
    """Where all words of an item stand in some order within so many words: doc_id, item_id, pos (of the first of them).

    Items without words and null texts have no matches; rows that repeat an id and text count once, other rows each.
    """
    rows = _keyed(docs).dropDuplicates(["_d", "_t"])
    asked = stored(items.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct(), "asked")
    size = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    index = postings(rows.select("_d", "_t", "text"), asked)
    w = Window.partitionBy("_d", "_t", "item_id").orderBy("pos").rangeBetween(0, within - 1)
    near = index.join(small(asked), "term").withColumn("_near", F.size(F.collect_set("term").over(w))).join(small(stored(size, "size")), "item_id")
    return near.where("_near = n").select(F.when(F.col("_d") > -(2**63), F.col("_d")).alias("doc_id"), "item_id", "pos")


def clean(docs: DataFrame, benchmark: DataFrame, *, size: int = 13) -> DataFrame:
    """The rows of docs that hold no window of `size` words of the benchmark and of whose words less than a twentieth are hit.

    So a long document with one passage of it goes, while one with an item of a few common words stays unless they are much of it.
    Rows are judged each by its own text, with a doc_id or without, and repeated rows alike. Columns as they are.
    """
    d, t = fresh("_d", docs), fresh("_t", docs)
    bad = contamination(docs, benchmark, size=size, full=True).where("contaminated or full").select(F.col("_d").alias(d), F.col("_t").alias(t)).distinct()
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), t: F.xxhash64("text")})
    return keyed.join(small(stored(bad, "bad")), [d, t], "left_anti").select(*docs.columns)
