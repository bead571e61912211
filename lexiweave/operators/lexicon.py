"""Lexicons of aligned pronunciations: reading them, looking words up in plain Python, and as a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MalformedMapping
from ..functions import edges as E
from ..functions import text as T
from ..plans.mapping import Mapping
from .provenance import Outcome

EMPTY = "_"


def parse_alignment(line: str, delimiter: str = "") -> tuple[str, list[tuple[int, str]]]:
    """A line of units in}out, parts of either side apart by |, _ for nothing: the word, and (letters, output) of each unit."""
    word, units = [], []
    for unit in line.split():
        left, mark, right = unit.rpartition("}")
        if not mark:
            raise MalformedMapping(f"a unit without }}: {unit}")
        letters = "" if left == EMPTY else "".join(left.split("|"))
        word.append(letters)
        units.append((len(letters), "" if right == EMPTY else delimiter.join(right.split("|"))))
    return "".join(word), units


def apply_lexicon(mapping: Mapping, text: str) -> Outcome:
    """A word's units end to end with the delimiter after each that has an output. A word that is not there gives nothing."""
    word = T.unicode_escape(text)
    if not mapping.case_sensitive:
        word = word.lower()
    word, moved = T.normalize_with_indices(word, mapping.norm_form)
    table = mapping.extra.setdefault("_by_word", {})
    if not table:
        table.update({w: u for w, u in reversed(mapping.alignments or [])})
    units = table.get(word)
    if units is None:
        return Outcome(text, "", [])
    edges, out, at = [], "", 0
    for n, output in units:
        places = range(len(out), len(out) + len(output))
        ins = range(at, at + n) if n else [min(at, max(len(word) - 1, 0))]
        edges += [(i, o) for i in ins for o in places] if output else [(i, None) for i in ins if n]
        out += output + (mapping.out_delimiter if output else "")
        at += n
    edges = E.repair(edges)
    if not out:
        edges = [(k, None) for k in range(len(word))]
    return Outcome(text, out, [(a, b) for a, b in E.compose(moved, edges) if a < len(text)])


def lexicon_frame(spark: SparkSession, path: str, delimiter: str = "") -> DataFrame:
    """A file of alignments as rows: word, units (n, out), output; read and parsed in Spark."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    units = F.split(F.trim("value"), r"\s+")
    side = lambda u, k: F.regexp_extract(u, r"^(.*)\}([^}]*)$", k)
    letters = lambda u: F.when(side(u, 1) == EMPTY, "").otherwise(F.replace(side(u, 1), F.lit("|"), F.lit("")))
    sounds = lambda u: F.when(side(u, 2) == EMPTY, "").otherwise(F.replace(side(u, 2), F.lit("|"), F.lit(delimiter)))
    word = F.concat_ws("", F.transform(units, letters))
    return lines.select(word.alias("word"), F.transform(units, lambda u: F.struct(F.length(letters(u)).alias("n"), sounds(u).alias("out"))).alias("units"))


def lexicon_output(units, delimiter: str = ""):
    """Output of a column of units."""
    said = F.filter(units, lambda u: u["out"] != "")
    return F.concat_ws("", F.transform(said, lambda u: F.concat(u["out"], F.lit(delimiter))))


def convert_by_join(words: DataFrame, column: str, lexicon: DataFrame, *, delimiter: str = "", case_sensitive: bool = False, into: str = "output") -> DataFrame:
    """Adds a lexicon's output to a column of words, empty where a word is not there; Spark picks the join by the lexicon's size."""
    table = lexicon.groupBy("word").agg(F.first("units").alias("_units")).select(F.col("word").alias("_word"), "_units")
    key = F.col(column) if case_sensitive else F.lower(column)
    joined = words.join(table, key == F.col("_word"), "left")
    return joined.withColumn(into, F.coalesce(lexicon_output(F.col("_units"), delimiter), F.lit(""))).drop("_word", "_units")
