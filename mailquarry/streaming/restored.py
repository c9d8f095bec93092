"""Sessions whose state outlives the stream: a store that a restarted query goes on from, in which a tool call counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPENDS = ("LIST", "SEARCH", "READ")
#: Bytes of files that a batch takes; a larger file is a batch of its own.
BATCH = 1 << 30


def sessions(log: DataFrame, budget: int) -> DataFrame:
    """A streaming log (user_id, event_id, tool, k) to one updated row a session. State is a row of each call that has ended, so
    that one that comes again, in the same batch or after a restart, changes nothing; and of each session its counters and the set
    of handles it has opened. The session of Spark needs the store ROCKS as its PROVIDER, or keeps the calls in memory."""
    calls = log.dropDuplicates(["user_id", "event_id"])
    used, handle = F.col("tool").isin(*SPENDS), F.when(F.col("tool") == "READ", F.col("k"))
    told = calls.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(used).alias("used"), F.collect_set(handle).alias("handles"), F.max("event_id").alias("last_call"))
    return told.select("user_id", "calls", "used", F.size("handles").cast("long").alias("opened"), (F.col("used") >= budget).alias("exhausted"), "last_call")


def advance(spark: SparkSession, schema, source: str, folder: str, budget: int) -> None:
    """Streams what is new among the files of source and stops. The next call, of this driver or another, goes on from the state
    in folder; a batch that was under way is done anew and replaces what it had written."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH).parquet(source)

        def keep(df: DataFrame, epoch: int) -> None:
            df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/{epoch}")

        sessions(stream, budget).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each session."""
    out = spark.read.parquet(f"{folder}/out/*")
    rest = [c for c in out.columns if c not in ("user_id", "epoch")]
    return out.groupBy("user_id").agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select("user_id", "r.*")
