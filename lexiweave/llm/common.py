"""What the operators of this subpackage share: materialisation in the shared folder, tables, bounds, running totals."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import BATCH_BYTES, bounded_batches  # noqa: F401 (operators import them from here)

#: Bytes of a table's rows, written out as JSON, up to which it is broadcast.
BROADCAST_BYTES = 48 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one;
    on a cluster that is an error, as executors would not see one another's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="lexiweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in this application's part of the shared folder, which goes when the driver ends."""
    own = f"{shared_folder(spark)}/lexiweave-{spark.sparkContext.applicationId}"
    if own not in _owned:
        fs, where = _file_system(spark, own)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _owned.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_owned: set[str] = set()


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of each execution when that ends, instead of some time after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str = "step", *, compact: bool = False) -> DataFrame:
    """df, written to the shared folder and reread: cuts the lineage, and lost executors lose nothing of it.

    compact: with a stronger compression, for what holds texts or many rows.
    """
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd" if compact else "snappy").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Deletes what stored() wrote for frames that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            fs, where = _file_system(df.sparkSession, path)
            with contextlib.suppress(Exception):  # left for the driver's end
                fs.delete(where, True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file, if it is there."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def small(df: DataFrame) -> DataFrame:
    """df (stored, so cheap to read), broadcast if its rows take few bytes; else as it is, for a join that shuffles."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32).alias("b")).head()["b"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh(name: str, *taken) -> str:
    """A column name that none of the frames or lists of names has, whatever the case."""
    used = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    while name.lower() in used:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Large objects that this worker keeps from task to task, by what they are for.
_kept: dict = {}


def kept(name, make):
    """What this worker has kept under that name, else what make() gives. It goes with the first task of a function that does not keep it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def trimmed(batches, keeps=None):
    """The batches of a Python function; at its end the worker, which Spark keeps, gives free memory back to the system.

    Of what earlier tasks have kept only that under the name `keeps` stays: other functions need the memory.
    """
    if others := [name for name in _kept if name != keeps]:
        for name in others:
            del _kept[name]
        give_back()
    yield from batches
    give_back()


def give_back() -> None:
    """Gives memory that this process has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(df: DataFrame) -> int:
    """How many parts a shuffle of something as large as df should have: as many as its scan, and as are configured at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def running_total(df: DataFrame, order: list[str], value: str, into: str, n: int) -> DataFrame:
    """Adds the sum of `value` over all rows before each one in `order`, and `part`, the number of its range of rows.

    Range partitions are summed on their own; only one number for each partition meets in one task.
    The result is stored, as the partition numbers must not change between the two passes.
    """
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranged")
    totals = ranged.groupBy("_pid").agg(F.sum(value).alias("_sum"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_pid", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_pid").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn(into, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # one row for each partition: its size is that of the partition list itself
    return out.join(F.broadcast(bases), "_pid").withColumn(into, (F.col(into) + F.col("_base")).cast("long")).withColumnRenamed("_pid", "part").drop("_base", "_nth")
