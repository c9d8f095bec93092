"""Choices that depend on all earlier ones, made in rounds of joins instead of one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.operators import records as R
from mailquarry.shared import drop, written


def first_independent(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node) of those that going through all nodes in order would take, taking each one that has no link with one taken
    before. nodes (node), links (a, b), a < b; the order is that of the numbers.

    A round takes every open node without an open link to an earlier one, and gives up the later neighbours of what it takes:
    what is decided no longer depends on the order of work, so it is what the sequence decides. Each round takes at least the
    first open node of every group of linked ones; in an order that has nothing to do with the links the number of rounds grows
    with the logarithm of the number of nodes. A number reaches the driver each round."""
    free = nodes.select("node").distinct()
    open_links, path = written(links.select("a", "b").distinct(), "links")
    given_up, lost = written(free.where("false"), "given-up")
    while True:
        later = open_links.select(F.col("b").alias("node")).distinct()
        # those that wait for no earlier one, and still have later ones: the others are settled and have no part any more
        taken = open_links.select(F.col("a").alias("node")).distinct().join(later, "node", "left_anti")
        out = open_links.join(taken.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        gone, gone_path = written(out, "gone")
        if gone.isEmpty():
            drop(gone_path)
            break
        rest = open_links.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        then, then_path = written(rest, "links")
        more, more_path = written(given_up.union(gone), "given-up")
        for old in (path, lost, gone_path):
            drop(old)
        open_links, path, given_up, lost = then, then_path, more, more_path
    result, _ = written(free.join(given_up, "node", "left_anti"), "taken")
    drop(path)
    drop(lost)
    return result


def accepted(topics: DataFrame, quota: int, least: float) -> DataFrame:
    """(category, id) of the topics that each category accepts. topics (category, id, toks), in the order of ids, which are
    numbers: those with words, below that similarity with all accepted before in the category, until the quota is met.

    A quota only ends the sequence, so its first ones are those of the sequence without it. Of equal sets only the first can be
    accepted."""
    known = topics.where(F.size("toks") > 0).select("category", "id", F.transform("toks", lambda t: F.concat_ws("\x01", F.col("category").cast("string"), t)).alias("toks"))
    sets = known.groupBy(F.array_sort("toks").alias("toks")).agg(F.min("id").alias("id"))
    links = R.similar_sets(known.select("id", "toks"), least).select("a", "b")
    taken = first_independent(sets.select(F.col("id").alias("node")), links)
    rows = topics.select("category", "id").join(taken.withColumnRenamed("node", "id"), "id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("category").orderBy("id"))
    return rows.withColumn("_n", nth).where(F.col("_n") <= quota).select("category", "id")


def first_choices(wishes: DataFrame, soft: bool = False) -> DataFrame:
    """(who, what, place, free) of wishes (who, what, place): going through all `who` in order, each gets the first of its wishes,
    by place, that none before it has got. Soft: who finds all of its wishes taken gets its first one beside the one who has it,
    and `free` is false.

    In a round each open `who` asks for the best wish that has not been refused, and of those who ask for one thing the
    earliest keeps it for now and refuses the others: a later round may bring an earlier one. As things prefer as the order
    does, what is kept in the end is what the sequence gives. Each round refuses something; the refused never ask again, so the
    rounds end. A number reaches the driver each round."""
    open_, path = written(wishes.select("who", "what", "place").distinct(), "wishes")
    while True:
        asks = open_.groupBy("who").agg(F.min_by("what", F.struct("place", "what")).alias("what"))
        kept = asks.groupBy("what").agg(F.min("who").alias("holder"))
        # nobody behind the holder gets it, now or later
        then, then_path = written(open_.join(kept, "what", "left").where("holder is null or who <= holder").drop("holder").select("who", "what", "place"), "wishes")
        settled = then.count() == open_.count()
        drop(path)
        open_, path = then, then_path
        if settled:
            break
    first = open_.groupBy("who").agg(F.min_by(F.struct("what", "place"), F.struct("place", "what")).alias("w")).select("who", "w.*", F.lit(True).alias("free"))
    if not soft:
        return first
    best = wishes.join(first.select("who"), "who", "left_anti").groupBy("who").agg(F.min_by(F.struct("what", "place"), F.struct("place", "what")).alias("w"))
    return first.union(best.select("who", "w.*", F.lit(False).alias("free")))
