"""Alignments as rows: composition, repair, pieces that do not cross, joining of texts. Keys name what a row's edges belong to.

Edges are rows (keys, i, o) with a null o for a deletion; where their order counts they have `ord` too. Each operation shuffles
once on the keys. appended_lists() keeps the edges of a part in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compose(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Edges over two steps, each once."""
    onward = second.select(*keys, F.col("i").alias("_m"), F.col("o").alias("_o"))
    return first.select(*keys, "i", F.col("o").alias("_m")).join(onward, [*keys, "_m"]).select(*keys, "i", F.col("_o").alias("o")).distinct()


def repair(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Deletions go to the output before them, or else to the one after; an input with a deletion keeps no other edge; each once."""
    per_input = Window.partitionBy(*keys, "i")
    w = Window.partitionBy(*keys).orderBy("i", "ord")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    kept = edges.withColumn("_gone", F.max(F.col("o").isNull()).over(per_input)).where("o is null or not _gone")
    full = kept.select(*keys, "i", "ord", F.coalesce(F.last("o", True).over(before), F.first("o", True).over(after)).alias("o"))
    return full.groupBy(*keys, "i", "o").agg(F.min("ord").alias("ord")).select(*keys, "i", "o", "ord")


def segments(edges: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """pos, in_sub and out_sub: the smallest pieces without crossing. texts: keys, input, output."""
    spans = edges.where("o is not null").groupBy(*keys, "i").agg(F.min("o").alias("low"), F.max("o").alias("high"))
    w = Window.partitionBy(*keys).orderBy("i")
    most = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    least = F.min("low").over(w.rowsBetween(0, Window.unboundedFollowing))
    cuts = spans.select(*keys, "i", most.alias("most"), least.alias("least")).where("most is null or most < least")
    starts = cuts.select(*keys, F.when(F.col("most").isNull(), 0).otherwise(F.col("i")).alias("a"), F.when(F.col("most").isNull(), 0).otherwise(F.col("least")).alias("b"))
    w2 = Window.partitionBy(*keys).orderBy("a")
    out = texts.join(starts, keys, "left").select(*keys, "input", "output", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    out = out.withColumns({"_a": F.coalesce(F.lead("a").over(w2), F.length("input")), "_b": F.coalesce(F.lead("b").over(w2), F.length("output")), "pos": F.row_number().over(w2) - 1})
    piece = lambda s, a, b: F.substring(F.col(s), F.col(a) + 1, F.col(b) - F.col(a))
    return out.where("input <> '' or output <> ''").select(*keys, "pos", piece("input", "a", "_a").alias("in_sub"), piece("output", "b", "_b").alias("out_sub"))


def pretty(edges: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Edges as pairs of characters."""
    both = edges.join(texts, keys)
    char = lambda s, k: F.substring(F.col(s), F.col(k) + 1, F.lit(1))
    return both.select(*keys, "i", "o", char("input", "i").alias("from"), F.when(F.col("o").isNotNull(), char("output", "o")).alias("to"))


def appended(parts: DataFrame, edges: DataFrame, keys: list[str], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Texts joined from parts (keys, pos, input, output) in order, and their edges (keys, pos, i, o, ord), moved and repaired."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select(*keys, pos, "input", "output", F.coalesce(F.sum(F.length("input")).over(w), F.lit(0)).alias("_i"), F.coalesce(F.sum(F.length("output")).over(w), F.lit(0)).alias("_o"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "input", "output")))
    texts = parts.groupBy(*keys).agg(ordered.alias("_all")).select(*keys, F.concat_ws("", F.transform("_all", lambda x: x["input"])).alias("input"), F.concat_ws("", F.transform("_all", lambda x: x["output"])).alias("output"))
    shifted = edges.join(moved.select(*keys, pos, "_i", "_o"), [*keys, pos]).select(*keys, (F.col("i") + F.col("_i")).alias("i"), (F.col("o") + F.col("_o")).alias("o"), F.struct(pos, "ord").alias("ord"))
    return texts, repair(shifted, keys)


def appended_lists(parts: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The same with edges as lists: of parts (keys, pos, input, output, edges, each list repaired on its own) the same columns, with edges
    moved by what is before them and repaired over all parts of their keys. One row a part throughout; only texts' lengths and first and
    last outputs meet in windows, so that no edge is a row of its own. A part without an input has no edges."""
    w = Window.partitionBy(*keys).orderBy(pos, "input", "output")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    length = lambda c: F.sum(F.coalesce(F.length(c), F.lit(0))).over(before)
    # two lists of numbers take a quarter of what pairs do, in shuffles and sorts
    lists = parts.withColumns({"_a": F.col("edges.i"), "_b": F.col("edges.o")}).drop("edges")
    moved = lists.withColumns({"_i": F.coalesce(length("input"), F.lit(0)), "_o": F.coalesce(length("output"), F.lit(0))})
    # where a part has an output all of its edges have one, as each list is repaired
    ends = moved.withColumns({"_first": F.try_element_at("_b", F.lit(1)) + F.col("_o"), "_last": F.try_element_at("_b", F.lit(-1)) + F.col("_o")})
    ends = ends.withColumn("_near", F.coalesce(F.last("_last", True).over(before), F.first("_first", True).over(after)))
    pair = lambda a, b: F.struct((a + F.col("_i")).alias("i"), F.coalesce(b + F.col("_o"), F.col("_near")).alias("o"))
    return ends.withColumn("edges", F.zip_with("_a", "_b", pair)).drop("_a", "_b", "_i", "_o", "_first", "_last", "_near")


def joined_lists(parts: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, input, output and n_edges_in, how many inputs have edges, of parts as appended_lists() returns them. Null where all parts are."""
    own = parts.withColumn("_n", F.size(F.array_distinct("edges.i"))).select(*keys, F.struct(pos, "input", "output").alias("_part"), F.when(F.col("edges").isNotNull(), F.col("_n")).alias("_n"))
    whole = lambda c: F.when(F.exists("_all", lambda x: x[c].isNotNull()), F.concat_ws("", F.transform("_all", lambda x: x[c])))
    groups = own.groupBy(*keys).agg(F.array_sort(F.collect_list("_part")).alias("_all"), F.sum("_n").cast("long").alias("n_edges_in"))
    return groups.select(*keys, whole("input").alias("input"), whole("output").alias("output"), "n_edges_in")
