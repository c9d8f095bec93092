"""Session logs as a stream: the same measures as the batch query, kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "calls long, reads long, searches long, opened array<int>, reopened long"
OUT = "user_id long, n_tool_calls long, reads long, searches long, opened long, redundant long"


def _fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    calls, reads, searches, opened, again = state.get if state.exists else (0, 0, 0, [], 0)
    seen = set(opened)
    for log in batches:
        calls += len(log)
        searches += int((log["tool"] == "SEARCH").sum())
        for k in log.loc[log["tool"] == "READ", "k"]:
            reads += 1
            if pd.notna(k):
                again += int(k) in seen
                seen.add(int(k))
    state.update((calls, reads, searches, sorted(seen), again))
    yield pd.DataFrame([(key[0], calls, reads, searches, len(seen), again)], columns=[c.split()[0] for c in OUT.split(", ")])


def session_metrics(log: DataFrame) -> DataFrame:
    """A streaming log (user_id, tool, k) to one updated row a session. State is a session's counters and the set of handles
    it has opened, which its budget bounds."""
    return log.groupBy("user_id").applyInPandasWithState(_fold, OUT, STATE, "update", "NoTimeout")


def replay(spark: SparkSession, log: DataFrame, folder: str, batches: int = 3) -> DataFrame:
    """The log written as files and streamed in that many micro-batches; the last row of each session."""
    log.repartition(batches, "event_id").write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")

    def keep(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/{epoch}")

    q = session_metrics(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out/*")
    rest = [c.split()[0] for c in OUT.split(", ")][1:]
    return out.groupBy("user_id").agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select("user_id", "r.*")
