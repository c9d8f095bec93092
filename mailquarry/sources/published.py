"""Sets that are published whole or not at all, in versions, with a manifest of their files' hashes.

A version is written beside the others under a hidden name; its files are then read back and hashed in the cluster, and the
manifest is written among them. Renaming the folder, one step of the file system, makes it visible. What breaks off before leaves
a hidden folder that no reader looks at, which the next publication deletes. Versions do not change; readers take the last or
one that they name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, n_bytes long, sha256 string"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions there are, from 1."""
    at, fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_bytes, sha256) of the data files in a folder, as they are stored now."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def publish(df: DataFrame, path: str, rows_a_file: int = 1_000_000) -> int:
    """Writes df as the next version, and returns its number. Of two that publish at once one fails and leaves nothing."""
    spark = df.sparkSession
    at, fs = _fs(spark, path)
    if fs.exists(at):
        for s in fs.listStatus(at):
            if s.getPath().getName().startswith("_hidden-"):
                fs.delete(s.getPath(), True)
    hidden = f"{path}/_hidden-{uuid.uuid4().hex}"
    try:
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(f"{hidden}/data")
        hashes(spark, f"{hidden}/data").repartition(1).write.json(f"{hidden}/manifest")
        number = max(versions(spark, path), default=0) + 1
        target = _fs(spark, f"{path}/v{number}")[0]
        if fs.exists(target) or not fs.rename(_fs(spark, hidden)[0], target):
            raise FileExistsError(f"version {number} was published meanwhile")
    except BaseException:
        fs.delete(_fs(spark, hidden)[0], True)
        raise
    return number


def read_published(spark: SparkSession, path: str, schema: str | None = None, version: int | None = None) -> DataFrame:
    """The last version, or that of a number."""
    there = versions(spark, path)
    if not there or version is not None and version not in there:
        raise FileNotFoundError(f"{path}: no version" + f" {version}" * (version is not None))
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/v{version or there[-1]}/data")


def damage(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(file, state) of the files of a version that are not as its manifest has them: changed, missing or added."""
    said = spark.read.schema(MANIFEST).json(f"{path}/v{version}/manifest").withColumnRenamed("sha256", "want")
    found = hashes(spark, f"{path}/v{version}/data").select("file", "sha256")
    both = said.join(found, "file", "full_outer")
    state = F.when(F.col("want").isNull(), "added").when(F.col("sha256").isNull(), "missing").when(F.col("want") != F.col("sha256"), "changed")
    return both.select("file", state.alias("state")).where("state is not null")
