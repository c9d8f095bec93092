"""Test archives: clue threads, noise, handles, pages and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.operators.records import hash_order


def noise_pool(corpus: DataFrame, *taken: DataFrame) -> DataFrame:
    """Threads of the corpus (thread) that none of the others has."""
    for t in taken:
        corpus = corpus.join(t.select("thread"), "thread", "left_anti")
    return corpus


def haystacks(cases: DataFrame, corpus: DataFrame, taken: DataFrame, noise: int, seed: int) -> DataFrame:
    """(case, thread, clue, place): each case's clue threads and `noise` threads of the pool, in one seeded order.

    cases (case, thread) are clue threads, taken (case, thread) what is too near to a case. The noise of all cases is one
    seeded order of the corpus, of which a case takes the first threads that it may: those before the place `noise` plus the
    number of its own exclusions, clue threads included. Only these are met with cases, so
    the cost is cases x noise, not cases x corpus."""
    clues = cases.select("case", "thread").distinct()
    shut = taken.select("case", "thread").union(clues).distinct()
    most = shut.groupBy("case").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("m")).first()["m"]
    pool = corpus.select("thread").distinct().orderBy(hash_order(F.col("thread"), seed), "thread").limit(noise + int(most))
    pairs = clues.select("case").distinct().crossJoin(pool).join(shut, ["case", "thread"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("case").orderBy(hash_order(F.col("thread"), seed), "thread"))
    kept = pairs.withColumn("n", nth).where(F.col("n") <= noise).select("case", "thread", F.lit(False).alias("clue"))
    both = clues.withColumn("clue", F.lit(True)).unionByName(kept)
    place = F.row_number().over(Window.partitionBy("case").orderBy(hash_order(F.concat_ws(":", "case", "thread"), seed), "thread"))
    return both.withColumn("place", place)


def next_segment(seen: DataFrame, total: int) -> DataFrame:
    """(session, segment): the next page of `total` not seen, from the cursor on, else from the start; null if all are. seen
    (session, segments array<int>, cursor int)."""
    left = F.array_except(F.sequence(F.lit(0), F.lit(total - 1)), "segments")
    ahead = F.filter(left, lambda x: x >= F.col("cursor"))
    return seen.select("session", F.coalesce(F.array_min(ahead), F.array_min(left)).alias("segment"))
