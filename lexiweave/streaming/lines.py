"""Conversion of unbounded lines: a projection without state, so it runs in append mode and needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.columns import convert
from ..operators.transducers import BaseTransducer


def converted_lines(lines: DataFrame, transducer: BaseTransducer, column: str = "value", into: str = "converted") -> DataFrame:
    return lines.withColumn(into, convert(transducer, F.col(column)))


def text_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Lines of text files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def convert_stream(source: DataFrame, transducer: BaseTransducer, sink: str, checkpoint: str, *, column: str = "value", available_now: bool = False) -> StreamingQuery:
    """Converts a stream to Parquet, each row once; with available_now it ends when what is there has been converted."""
    writer = converted_lines(source, transducer, column).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
