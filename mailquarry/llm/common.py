"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIR_KEY = "spark.checkpoint.dir"


def bound_batches(spark: SparkSession, rows: int = 500, size: str = "2m") -> None:
    """Bounds what a Python worker gets at once: with the usual 10,000 rows, long texts fill its memory and the buffers on the
    JVM side. Spark has these two settings for a session only, so the caller's session keeps them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one for a local master, as in tests;
    on a cluster that would scatter the files over machines, so it is an error."""
    named = spark.conf.get(DIR_KEY, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{DIR_KEY} must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='mailquarry-')}"
        spark.conf.set(DIR_KEY, named)
    return named


#: Folders that cut() has made and nothing has deleted yet, each with the configuration that reaches it.
_MADE: dict[str, tuple] = {}
#: Of the folders of bucketed(), the session and the name in its catalogue.
_NAMED: dict[str, tuple[SparkSession, str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table or files; sweep() deletes it if nothing else does."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark._jvm, spark._jsc.hadoopConfiguration()
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and a lost executor costs
    no more than the tasks it ran."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like cut(), dealt into buckets of the column `key`: later joins and groups by it move no row of this table again."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_folder(spark, name)
    called = path.rpartition("/")[2].replace("-", "_")
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(called)
    _NAMED[path] = spark, called
    out = spark.table(called)
    out._cut_at = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete the files of tables made by cut() that nothing will read again."""
    for df in tables:
        drop_folder(df._cut_at)


def drop_folder(path: str) -> None:
    jvm, conf = _MADE.pop(path)
    if path in _NAMED:
        spark, called = _NAMED.pop(path)
        spark.sql(f"DROP TABLE IF EXISTS {called}")
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """To be called after a large cut(): Spark deletes the shuffle files of a finished job only when the driver's collector
    finds its plan unreachable, which on a driver with little to do may be long after the disks are full."""
    spark._jvm.System.gc()


def sweep() -> None:
    """Delete the tables that results still read. To be called when no result is read any more; at the latest it is as the
    driver ends."""
    for path in list(_MADE):
        try:
            drop_folder(path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            _MADE.pop(path, None)
            _NAMED.pop(path, None)


atexit.register(sweep)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    stem = "_"
    while any(f"{stem}{x}".lower() in taken or f"{stem}{x}_k".lower() in taken for x in names):
        stem += "_"
    return [f"{stem}{x}" for x in names]


def trim() -> None:
    """Give the memory that a Python worker has freed back to the machine: workers live on between stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Column out: 0, 1, 2, ... without gaps within each value of keys, in an order fixed by the columns order.

    No key's rows meet in one task: rows are numbered in `buckets` hash buckets of a key, and each bucket starts where
    the counts of those before it end. df is read twice, so it should be a table. Null keys count as a value."""
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), before.alias("_start"))
    rows = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    on = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(starts, on).withColumn(out, F.col("_start") + F.col("_rn")).drop("_b", "_rn", "_kb", "_start", *[f"_k{i}" for i in range(len(keys))])


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes, none for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
