"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, tuple] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with drop(), at the latest as the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='mailquarry-')}"
    path = f"{named}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark._jvm, spark._jsc.hadoopConfiguration()
    return path


def drop(path: str) -> None:
    """Deletes what scratch() named; nothing may read it any more."""
    jvm, conf = _MADE.pop(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def bound_batches(spark: SparkSession, rows: int = 500, size: str = "2m") -> None:
    """Bounds what a Python worker gets at once: with the usual 10,000 rows, long texts fill its memory. Spark has these two
    settings for a session only, so the caller's session keeps them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: the lineage ends there, and a lost executor costs only its tasks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@atexit.register
def sweep() -> None:
    """Deletes everything that is left."""
    for path in list(_MADE):
        try:
            drop(path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            _MADE.pop(path, None)
