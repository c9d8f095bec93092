"""Builds in rounds: cases go through stages, go back with feedback where one fails, and are kept or dropped in the end.

The work table is a published set. Version by version it holds the rows that a round has worked on, so a round reads the open rows
of the last version and nothing else, and what is settled is neither read nor written again. A round shows whole or not at all:
one that breaks off is done anew from the version before, and what its stages have paid for is in their ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.sources import published

#: What the work table adds to the columns of a case.
STATE = ("status", "stage", "tries", "way", "ways", "feedback", "round", "log")


@dataclass(frozen=True)
class Stage:
    """A stage gets its open rows, with `way`, `tries` and `feedback`, and returns them with the columns it fills, the `feedback` to
    pass on and a `verdict`: ok, drop, or the stage to go back to; null, an answer that cannot be read, is the stage itself."""

    name: str
    work: Callable[[DataFrame], DataFrame]


def _seen(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*[f"{path}/v{v}/data" for v in published.versions(spark, path)])


def begin(cases: DataFrame, path: str, *keys: str, ways: Column | None = None) -> DataFrame:
    """Puts those cases into the work table that it does not know by their keys, and returns its open rows. Of repeated keys one
    row counts; a null is a key like another. A case tries its `ways` in order (null or empty: one, without a name)."""
    clash = set(cases.columns) & set(STATE)
    if clash:
        raise ValueError(f"columns of the work table: {sorted(clash)}")
    spark = cases.sparkSession
    listed = F.lit(None).cast("array<string>") if ways is None else ways.cast("array<string>")
    whole = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(None).cast("string")))
    fresh = cases.withColumn("_w", whole).dropDuplicates(list(keys))
    new = fresh.select(
        *cases.columns, F.lit("OPEN").alias("status"), F.lit(0).alias("stage"), F.lit(0).alias("tries"), F.element_at("_w", 1).alias("way"), F.expr("slice(_w, 2, size(_w))").alias("ways"),
        F.lit("").alias("feedback"), F.lit(0).alias("round"), F.array().cast("array<string>").alias("log"),
    )
    if published.versions(spark, path):
        known = _seen(spark, path, new.schema).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        added = new.join(known, same, "left_anti")
        if added.isEmpty():
            return open_rows(spark, path)
        new = added.unionByName(open_rows(spark, path))
    published.publish(new, path)
    return open_rows(spark, path)


def open_rows(spark: SparkSession, path: str) -> DataFrame:
    return published.read_published(spark, path).where("status = 'OPEN'")


def step(spark: SparkSession, path: str, stages: Sequence[Stage], tries: int) -> bool:
    """One round over all open rows, each at its own stage; false if there was none. A case that has failed `tries` times begins
    its next way at the first stage, and is dropped where there is none."""
    todo = open_rows(spark, path)
    at = {r["stage"] for r in todo.select("stage").distinct().collect()}  # at most one number a stage
    if not at:
        return False
    number = {s.name: k for k, s in enumerate(stages)}
    places = F.create_map(*[x for name, k in number.items() for x in (F.lit(name), F.lit(k))])
    out = None
    for k in sorted(at):
        s = stages[k]
        done = s.work(todo.where(F.col("stage") == k)).withColumn("_v", F.coalesce("verdict", F.lit(s.name)))
        fails = F.col("tries") + 1
        ok, back = F.col("_v") == "ok", places[F.col("_v")]
        unknown = F.raise_error(F.concat(F.lit(f"{s.name}: no such stage: "), F.col("_v")))
        spent, more = fails >= tries, F.size("ways") > 0
        kept = F.struct(F.lit("KEPT" if k + 1 == len(stages) else "OPEN").alias("status"), F.lit(min(k + 1, len(stages) - 1)).alias("stage"), "tries", "way", "ways", "feedback")
        gone = F.struct(F.lit("DROP").alias("status"), "stage", "tries", "way", "ways", "feedback")
        lost = F.struct(F.lit("DROP").alias("status"), "stage", fails.alias("tries"), "way", "ways", "feedback")
        other = F.struct(F.lit("OPEN").alias("status"), F.lit(0).alias("stage"), F.lit(0).alias("tries"), F.element_at("ways", 1).alias("way"), F.expr("slice(ways, 2, size(ways))").alias("ways"), F.lit("").alias("feedback"))
        again = F.struct(F.lit("OPEN").alias("status"), F.coalesce(back, unknown.cast("int")).alias("stage"), fails.alias("tries"), "way", "ways", "feedback")
        then = F.when(ok, kept).when(F.col("_v") == "drop", gone).when(spent & more, other).when(spent, lost).otherwise(again)
        told = F.concat("log", F.array(F.concat_ws(":", F.lit(s.name), "_v")))
        moved = done.withColumn("_s", then).select(*[F.col(f"_s.{c}").alias(c) if c in STATE[:6] else {"round": F.col("round") + 1, "log": told}.get(c, F.col(c)).alias(c) for c in todo.columns])
        out = moved if out is None else out.unionByName(moved)
    published.publish(out, path)
    return True


def built(spark: SparkSession, path: str) -> DataFrame:
    """The settled rows of all rounds."""
    return _seen(spark, path).where("status <> 'OPEN'")


def run(spark: SparkSession, path: str, stages: Sequence[Stage], tries: int) -> DataFrame:
    """Rounds until nothing is open. A case goes back at most `tries` times a way, so their number is bounded."""
    while step(spark, path, stages, tries):
        pass
    return built(spark, path)
