"""The seam to a text generator: a list of prompts in, a list of texts out. Nothing here reaches a network; the caller brings
the generator, and tests bring a deterministic one."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Generate = Callable[[list[str]], list[str]]


#: What a service raises when it is busy or away. Anything else is a fault of the program and ends the job.
SERVICE_ERRORS = (OSError, TimeoutError, ConnectionError)


def generated(make: Callable[[], Generate], prompt: Column, tries: int = 3, errors: tuple[type[Exception], ...] = SERVICE_ERRORS, wait: float = 0.0) -> Column:
    """A column of generated texts. The generator is made once a task; a batch that fails with one of `errors` is tried again
    after `wait` seconds, twice as long each time, then prompt by prompt, and what still fails is the empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = make()

        def attempt(prompts: list[str]) -> list[str] | None:
            for n in range(tries):
                try:
                    return list(generate(prompts))
                except errors:
                    time.sleep(wait * 2**n)
            return None

        for batch in batches:
            prompts = batch.fillna("").tolist()
            out = attempt(prompts)
            yield pd.Series(out if out is not None else [(attempt([p]) or [""])[0] for p in prompts])

    return run(prompt)


def paid_once(df: DataFrame, make: Callable[[], Generate], prompt: str, ledger: str, out: str = "answer", a_task: int = 64, tries: int = 3, errors: tuple[type[Exception], ...] = SERVICE_ERRORS, wait: float = 1.0, rate: float | None = None) -> DataFrame:
    """df with the answers to its prompts, from a ledger: a table of answers by the prompts' hashes, in a folder that outlives the
    job. Only prompts that it does not have are sent, each different one once.

    A task has at most about `a_task` prompts and its answers are in the ledger as soon as it ends, also if the job fails later
    or an executor is lost: what a next run pays for anew is the unfinished tasks. An error may say how long to wait, as
    `retry_after`; else waits double from `wait`. A batch that fails to the end fails its task and so leaves no answer. `rate` is
    the prompts a second that all tasks together may send; each waits as if all cores sent. Null prompts have no answer."""
    spark = df.sparkSession
    asked = df.where(F.col(prompt).isNotNull()).select(F.sha2(F.col(prompt), 256).alias("_h"), F.col(prompt).alias("_p")).dropDuplicates(["_h"])
    schema = "_h string, _a string"
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    known = spark.read.schema(schema).parquet(ledger) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], schema)
    new = asked.join(known.select("_h"), "_h", "left_anti")
    pause = spark.sparkContext.defaultParallelism / rate if rate else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make()
        for batch in batches:
            time.sleep(pause * len(batch))
            for n in range(tries):
                try:
                    answers = list(generate(batch["_p"].tolist()))
                    break
                except errors as e:
                    if n == tries - 1:
                        raise
                    time.sleep(getattr(e, "retry_after", None) or wait * 2**n)
            yield pd.DataFrame({"_h": batch["_h"], "_a": answers})

    # the second kind of committer moves a task's file into the table when the task ends
    tasks = max(1, -(-new.count() // a_task))
    new.repartition(tasks, "_h").mapInPandas(run, schema).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(ledger)
    # a run that broke off and one beside it may both have an answer: the least counts
    answers = spark.read.schema(schema).parquet(ledger).groupBy("_h").agg(F.min("_a").alias(out))
    return df.withColumn("_h", F.sha2(F.col(prompt), 256)).join(answers, "_h", "left").drop("_h")


def echo() -> Generate:
    """A deterministic stand-in: a verdict that depends on the prompt alone."""
    return lambda prompts: [f'{{"match": {"true" if hashlib.sha256(p.encode()).digest()[0] % 2 else "false"}}}' for p in prompts]


def strict_match(c: Column) -> Column:
    """True only for a JSON true, not for the string."""
    return F.coalesce(F.variant_get(F.try_parse_json(c), "$.match", "boolean") & (F.schema_of_variant(F.variant_get(F.try_parse_json(c), "$.match", "variant")) == "BOOLEAN"), F.lit(False))


def judged(df: DataFrame, make: Callable[[], Generate], prompt: Column, found: Column) -> DataFrame:
    """df with a verdict; only rows with something found are sent, filtered before the generator so that none else is paid
    for."""
    asked = df.where(found).withColumn("verdict", strict_match(generated(make, prompt)))
    return asked.unionByName(df.where(~found).withColumn("verdict", F.lit(None).cast("boolean")))
