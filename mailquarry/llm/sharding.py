"""Balanced shards that keep linked documents together: label propagation with the best flows under capacities.

Documents with equal texts are linked. The law is `rows`: shard sizes are at most one row apart. Linked documents start one
group after the other, the same number in each shard, so at most the groups at the borders of shards are cut. In each round a
document wants the shard where most of its neighbours are; how many go from shard i to shard j is the optimum of a linear
program, the most gain in all with no shard over its capacity, cycles of several shards included, and the moves of most gain
go first. Where none is possible, shards without room are no targets for a round. A group has one target a round, so each move
leaves fewer edges cut, and rounds end when no document can move. Documents without a link fill the room that is left, so they
cost no edge.

Copies of one text within one shard are alike, so the state is one row for each (text, shard) with a count; a text that holds
a third of all rows is eight rows. Only sums over pairs of shards and gains reach the driver, for a pair at most as many as the
root of twice the rows. Rows are numbered in hash buckets, so no shard's or text's rows meet in one task.

Null text counts as empty: size 1, and linked to other empty texts. Null doc_ids and repeated rows are rows like any other,
each with its own slot. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.llm.common import cut, drop_cut, number_within, table, utf8

SHARDS = 8
#: Rows in a bucket of a numbering, on average.
BUCKET_ROWS = 20_000
G = ["g1", "g2"]


def _buckets(n: int) -> int:
    return max(512, n // BUCKET_ROWS)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, g1, g2): g1 and g2 are a 128-bit key of the text."""
    t = utf8("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("g1"), F.xxhash64(F.lit("second"), t).alias("g2"))


def capacities(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _start(groups: DataFrame, shards: int, buckets: int) -> DataFrame:
    """(g1, g2, shard, n): the documents of all groups, one group after the other, the same number to each shard."""
    b = groups.withColumn("b", F.pmod("g1", F.lit(buckets)))
    sums = b.groupBy("b").agg(F.sum("n").alias("m"))
    starts = sums.select("b", (F.sum("m").over(Window.orderBy("b")) - F.col("m")).alias("base"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = F.sum("n").over(Window.partitionBy("b").orderBy(*G)) - F.col("n")
    at = b.withColumn("before", before).join(starts, "b").withColumn("at", F.col("base") + F.col("before"))
    ends = np.cumsum([0, *capacities(total, shards)]).tolist()
    shares = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(x).alias("x"), F.lit(y).alias("y")) for s, (x, y) in enumerate(zip(ends, ends[1:]))])
    part = F.explode(F.filter(shares, lambda c: (c["x"] < F.col("at") + F.col("n")) & (c["y"] > F.col("at")))).alias("c")
    parts = at.select(*G, "at", "n", part)
    return parts.select(*G, "c.shard", (F.least(F.col("at") + F.col("n"), "c.y") - F.greatest("at", "c.x")).alias("n"))


def best_flows(wanted: dict[tuple[int, int], dict[int, int]], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents go from i to j so that the sum of their gains is the most that any flows have that bring no shard more
    than its room: the linear program of balanced label propagation, whose utilities are concave, as moves of most gain go
    first. wanted has for (i, j) how many documents have each gain, 1 at least. It is solved exactly as a flow of least cost:
    all moves are made, and what that brings a shard too much goes back by the cheapest paths of moves undone or made again."""
    steps = {k: sorted(x.items()) for k, x in wanted.items()}
    undone = {k: [0, 0] for k in steps}  # of a pair: the step that is being undone, and how many of it are
    pool, over, into = len(room), [0] * (len(room) + 1), [0] * len(room)
    for (i, j), x in steps.items():
        n = sum(n for _, n in x)
        over[i], over[j] = over[i] - n, over[j] + n

    def arcs():
        for (i, j), x in steps.items():
            at, n = undone[i, j]
            if at < len(x):
                yield j, i, x[at][0], x[at][1] - n, (i, j), 1
            if n or at:
                gain, size = x[at if n else at - 1]
                yield i, j, -gain, n or size, (i, j), -1
        for j, r in enumerate(room):
            yield j, pool, 0, r - into[j], j, 1
            yield pool, j, 0, float("inf"), j, -1

    while any(x > 0 for x in over):
        cost, by = [0 if x > 0 else float("inf") for x in over], {}
        open_, nearer = [x for x in arcs() if x[3] > 0], True
        while nearer:
            nearer = False
            for x in open_:
                if cost[x[0]] + x[2] < cost[x[1]]:
                    cost[x[1]], by[x[1]], nearer = cost[x[0]] + x[2], x, True
        end = min((j for j, x in enumerate(over) if x < 0), key=lambda j: cost[j])
        path, start = [], end
        while start in by:
            path.append(by[start])
            start = by[start][0]
        n = min(over[start], -over[end], *[x[3] for x in path])
        over[start], over[end] = over[start] - n, over[end] + n
        for _, _, _, _, k, way in path:
            if isinstance(k, int):
                into[k] += way * n
                continue
            at, m = undone[k]
            at, m = (at - 1, steps[k][at - 1][1]) if way < 0 and not m else (at, m)
            m += way * n
            undone[k] = [at + 1, 0] if m == steps[k][at][1] else [at, m]
    left = {k: sum(n for _, n in x[undone[k][0] :]) - undone[k][1] for k, x in steps.items()}
    return {k: n for k, n in left.items() if n}


def propagate(state: DataFrame, capacity: list[int], buckets: int) -> DataFrame:
    """Rounds of moves from `state` (g1, g2, shard, n), a table, until none is possible."""
    only_open = False
    while True:
        load = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [c - load.get(s, 0) for s, c in enumerate(capacity)]
        targets = [s for s, r in enumerate(room) if r > 0 or not only_open]
        best = state.where(F.col("shard").isin(targets)).groupBy(*G).agg(F.max_by(F.struct("shard", "n"), F.struct("n", F.xxhash64(*G, "shard"))).alias("to"))
        # the one that goes is no neighbour of itself
        moves = state.join(best, G).withColumn("gain", F.col("to.n") - F.col("n") + 1).withColumnRenamed("shard", "from")
        # a group has one target a round, so equal gains cannot swing: any move to it leaves fewer edges cut
        moves = moves.where((F.col("from") != F.col("to.shard")) & (F.col("gain") > 0))
        moves = cut(moves.select(*G, "from", F.col("to.shard").alias("to"), "n", F.col("gain"), F.pmod("g1", F.lit(buckets)).alias("b")), "moves")
        wanted = {}
        for r in moves.groupBy("from", "to", "gain").agg(F.sum("n").alias("n")).collect():
            wanted.setdefault((r["from"], r["to"]), {})[r["gain"]] = r.n
        quota = best_flows(wanted, room)
        if not quota:
            drop_cut(moves)
            if only_open or not wanted:
                return state
            only_open = True
            continue
        only_open = False
        may = F.coalesce(F.create_map(*[F.lit(x) for (i, j), q in quota.items() for x in (i * len(capacity) + j, q)])[F.col("from") * len(capacity) + F.col("to")], F.lit(0))
        sums = moves.groupBy("from", "to", "gain", "b").agg(F.sum("n").alias("m"))
        base = sums.withColumn("base", F.sum("m").over(Window.partitionBy("from", "to").orderBy(F.desc("gain"), "b")) - F.col("m")).drop("m")
        before = F.sum("n").over(Window.partitionBy("from", "to", "gain", "b").orderBy(*G)) - F.col("n")
        placed = moves.withColumn("before", before).join(base, ["from", "to", "gain", "b"])
        goes = placed.withColumn("go", F.greatest(F.lit(0), F.least("n", may - F.col("base") - F.col("before")))).where("go > 0")
        change = goes.select(*G, F.explode(F.array(F.struct(F.col("from").alias("shard"), (-F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n")))).alias("c")).select(*G, "c.shard", "c.n")
        then = cut(state.union(change.select(*G, "shard", "n")).groupBy(*G, "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
        drop_cut(state, moves)
        state = then


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, g1, g2, shard) for each row of docs (doc_id, text), a table."""
    rows = cut(digest(docs), "digests")
    n = rows.count()
    capacity, buckets = capacities(n, shards), _buckets(n)
    groups = cut(rows.groupBy(*G).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    state = propagate(cut(_start(groups, shards, buckets), "state"), capacity, buckets)
    load = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    to = F.sum("n").over(Window.partitionBy(*G).orderBy("shard"))
    ranges = state.withColumn("to", to).groupBy(*G).agg(F.array_sort(F.collect_list(F.struct("to", "shard"))).alias("ranges"))
    known = rows.join(ranges, G, "left")
    order = ["doc_id", "size", "text_crc32"]
    split = cut(known, "linked")
    linked = number_within(split.where("ranges is not null"), G, order, "at", buckets)
    linked = linked.withColumn("shard", F.filter("ranges", lambda r: F.col("at") < r["to"])[0]["shard"])
    alone = number_within(split.where("ranges is null"), [], [*order, *G], "at", buckets)
    out = alone.withColumn("shard", _place(F.col("at"), [c - load.get(s, 0) for s, c in enumerate(capacity)]))
    columns = ["doc_id", "size", "text_crc32", *G, "shard"]
    done = cut(linked.select(*columns).union(out.select(*columns)), "shards")
    drop_cut(rows, groups, state, split)
    return done


def _place(at: Column, room: list[int]) -> Column:
    """The shard of the at-th document that fills the room."""
    out, upto = F.lit(len(room) - 1), sum(room)
    for s in range(len(room) - 1, -1, -1):
        out = F.when(at < upto, F.lit(s)).otherwise(out) if s < len(room) - 1 else out
        upto -= room[s]
    return out


def cut_edges(assigned: DataFrame) -> DataFrame:
    """(edges, cut): pairs of equal texts, and those of them in different shards."""
    each = assigned.groupBy(*G, "shard").agg(F.count(F.lit(1)).alias("n"))
    group = each.groupBy(*G).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    return group.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("edges"), F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("kept")).cast("long").alias("cut"))


def op5_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = assign(table(spark, sf_dir, "documents"))
    placed = number_within(assigned, ["shard"], ["doc_id", "size", "text_crc32", *G], "slot", _buckets(assigned.count()))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_balanced_sharding": op5_balanced_sharding}
