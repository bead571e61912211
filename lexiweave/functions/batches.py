"""Bounds of the batches that Spark hands to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of rows that an Arrow batch holds at most, besides its last row.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, since texts may be long. A lower bound that is set stays, as does that on rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(value: str) -> int:
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    plain = value.lower().removesuffix("b")
    if plain[-1:] in units and plain[:-1].isdigit():
        return int(plain[:-1]) << units[plain[-1]]
    return int(plain) if plain.isdigit() else 0
