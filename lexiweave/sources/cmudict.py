"""A pronouncing dictionary of the CMU kind, read in Spark: words and their first pronunciation in IPA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dictionary(spark: SparkSession, path: str, ipa: dict[str, str]) -> DataFrame:
    """word and phones: comments, stress and further pronunciations (with a number in brackets) are left out.

    ipa maps ARPABET symbols; a line with a symbol that it lacks has null phones.
    """
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    rows = spark.read.text(path).select(line.alias("line")).where(F.col("line").rlike(r"^\S+\s+\S") & ~F.col("line").startswith(";;;"))
    rows = rows.select(F.regexp_extract("line", r"^(\S+)\s+(.*)$", 1).alias("word"), F.regexp_extract("line", r"^(\S+)\s+(.*)$", 2).alias("said")).where(~F.col("word").rlike(r".\(\d+\)$"))
    known = F.create_map(*[F.lit(x) for pair in ipa.items() for x in pair])
    symbols = F.transform(F.split("said", r"\s+"), lambda s: known[F.regexp_replace(s, r"\d+$", "")])
    return rows.select("word", F.when(~F.exists(symbols, lambda s: s.isNull()), F.concat_ws("", symbols)).alias("phones"))
