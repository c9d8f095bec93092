"""Scores, reports and statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.shared import bound_batches, written


def safe_mean(c: Column | str, digits: int = 6) -> Column:
    return F.coalesce(F.round(F.avg(c), digits), F.lit(0.0))


def sem(c: str) -> Column:
    """Standard error of the mean from the population deviation; 0 for one value."""
    return F.when(F.count(c) > 1, F.stddev_pop(c) / F.sqrt(F.count(c))).otherwise(0.0)


def thread_evidence(cited: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, precision, recall) by threads: cited (key, thread; null for an unknown handle), wanted (key, thread). Unknown
    handles are left out; nothing known cited gives 0 and 0."""
    known = cited.where("thread is not null").distinct()
    hits = known.join(wanted.distinct(), ["key", "thread"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("hits"))
    counts = known.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    need = wanted.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("need"))
    keys = cited.select("key").union(wanted.select("key")).distinct()
    out = keys.join(counts, "key", "left").join(hits, "key", "left").join(need, "key", "left").na.fill(0)
    return out.select("key", F.when(F.col("n") > 0, F.bround(F.col("hits") / F.col("n"), 3)).otherwise(0.0).alias("precision"), F.when(F.col("n") > 0, F.bround(F.col("hits") / F.greatest("need", F.lit(1)), 3)).otherwise(0.0).alias("recall"))


def message_evidence(cited: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, precision, recall) by messages: unknown ids stay in the denominator, nothing is rounded."""
    hit = cited.join(wanted.withColumn("ok", F.lit(1)), ["key", "message"], "left")
    need = wanted.groupBy("key").agg(F.countDistinct("clue").alias("need"))
    each = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("ok", F.lit(0))).alias("valid"), F.countDistinct("clue").alias("clues"))
    return each.join(need, "key", "left").select("key", (F.col("valid") / F.col("n")).alias("precision"), (F.col("clues") / F.greatest(F.coalesce("need", F.lit(0)), F.lit(1))).alias("recall"))


def product_gate(found: Column, match: Column, recall: Column, precision: Column) -> Column:
    """Of rounded parts; a match counts only if something was found."""
    f = F.when(found, 1.0).otherwise(0.0)
    return F.bround(f * F.when(found & match, 1.0).otherwise(0.0) * recall * precision, 3)


def auc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """P(positive > negative) + P(equal) / 2 from midranks: counts by value, so rows with one value are one row of the window."""
    each = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(score)) - F.col("n")
    mid = each.withColumn("mid", before + (F.col("n") + 1) / 2)
    sums = mid.groupBy(*by).agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
    return sums.select(*by, ((F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"))


#: Rows of a block of vectors, and queries compared with it at a time.
ROWS, STRIP = 4096, 256


def _pack_vectors(batches):
    """Blocks of rows (id, v) of one width, in the order of ids."""
    held: dict[int, tuple[list, list]] = {}

    def block(width):
        ids, vectors = held.pop(width)
        order = np.argsort(ids, kind="stable")
        data = np.asarray(vectors, "<f8").reshape(len(ids), width)[order]
        return pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "ids": [np.asarray(ids, "<i8")[order].tobytes()], "v": [data.tobytes()]})

    for batch in batches:
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
            ids, vectors = held.setdefault(len(v), ([], []))
            ids.append(i)
            vectors.append(v)
            if len(ids) >= ROWS:
                yield block(len(v))
    for width in list(held):
        yield block(width)


def _near(k: int):
    """Of each block of queries and of rows the k nearest rows of each query. A product of matrices tells roughly how far rows are;
    what may be among the k by that is measured component by component."""

    def run(batches):
        for batch in batches:
            for cell in batch.to_pylist():
                if cell["width"] != cell["q_width"]:
                    continue
                ids, qids = np.frombuffer(cell["ids"], "<i8"), np.frombuffer(cell["q_ids"], "<i8")
                x, y = np.frombuffer(cell["q_v"], "<f8").reshape(len(qids), -1), np.frombuffer(cell["v"], "<f8").reshape(len(ids), -1)
                xx, yy = (x * x).sum(1), (y * y).sum(1)
                for a in range(0, len(qids), STRIP):
                    rough = xx[a : a + STRIP, None] + yy - 2 * (x[a : a + STRIP] @ y.T)
                    rough[qids[a : a + STRIP, None] == ids] = np.inf
                    # rounding of the product, and of distances to 9 decimals
                    slack = 1e-12 * (xx[a : a + STRIP] + yy.max()) * x.shape[1] + 1e-8 * (1 + np.sqrt(xx[a : a + STRIP] + yy.max()))
                    limit = (np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(rough), np.inf)) + slack
                    out = []
                    for i, row in enumerate(rough, a):
                        may = np.flatnonzero((row <= limit[i - a]) & (ids != qids[i]))
                        d = np.sqrt(((x[i] - y[may]) ** 2).sum(1))
                        first = np.argsort(np.round(d, 9), kind="stable")[:k]
                        out.append((np.full(len(first), qids[i]), ids[may[first]], d[first]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["qid", "id", "distance"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 1) -> DataFrame:
    """The k nearest rows (id, v) of each query (qid, v), itself left out, by Euclidean distance; ties of distances, to 9 decimals, go
    to the smaller id. ids are whole numbers. Vectors are packed into blocks, each block of queries meets each of rows, and only the k
    nearest of such a cell go on. Vectors with a component that is null or not finite, and those of another length, are near to
    nothing."""
    bound_batches(rows.sparkSession)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    known = lambda df, key: df.where(F.col("v").isNotNull() & finite & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    pack = lambda df, name: written(df.mapInArrow(_pack_vectors, "width int, ids binary, v binary"), name)[0]
    cells = pack(known(rows, "id"), "rows").crossJoin(pack(known(queries, "qid"), "queries").toDF("q_width", "q_ids", "q_v"))
    found = cells.mapInArrow(_near(k), "qid long, id long, distance double")
    w = Window.partitionBy("qid").orderBy(F.round("distance", 9), "id")
    kinds = queries.schema["qid"].dataType, rows.schema["id"].dataType
    return found.select(F.col("qid").cast(kinds[0]).alias("qid"), F.col("id").cast(kinds[1]).alias("id"), "distance").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def principal(rows: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, p1..pk): each centred vector along the k directions of most variance; a direction's largest weight is positive,
    so signs are the same on every engine. Only the covariances, one number for each two dimensions, reach the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    known = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_v"))
    names = [f"p{i + 1}" for i in range(k)]
    if known.isEmpty():
        return known.select(key, *[F.lit(None).cast("double").alias(n) for n in names])
    pc = PCA(k=k, inputCol="x", outputCol="y").fit(known.select(array_to_vector("_v").alias("x"))).pc.toArray()
    width = len(pc)
    means = known.agg(*[F.avg(F.get("_v", F.lit(i))).alias(f"m{i}") for i in range(width)]).first()
    out = []
    for name, w in zip(names, pc.T):
        w = w if w[abs(w).argmax()] > 0 else -w
        along = F.aggregate(F.zip_with("_v", F.array(*map(F.lit, w.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        out.append((along - float(sum(m * x for m, x in zip(means, w)))).alias(name))
    return known.select(key, *out)


def _apart(a: Column, b: Column) -> Column:
    """The Euclidean distance of two vectors."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def pivots_of(rows: DataFrame, count: int) -> DataFrame:
    """One row, `pivots`: the vectors of `count` rows (id, v) chosen by a hash."""
    chosen = rows.where("v is not null").select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(count)
    return chosen.agg(F.collect_list("v").alias("pivots"))


def in_cells(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """rows with v, with `to`, their distances to the pivots, `cell`, the nearest pivot, and `off`, its distance. Rows without a
    vector have no cell."""
    to = F.transform("pivots", lambda p, i: F.struct(_apart(F.col("v"), p).alias("off"), i.alias("cell")))
    placed = rows.where("v is not null").crossJoin(F.broadcast(pivots)).withColumn("to", to).drop("pivots").withColumn("_n", F.array_min("to"))
    return placed.where("_n is not null").withColumn("cell", F.col("_n.cell")).withColumn("off", F.col("_n.off")).drop("_n")


def cell_pairs(queries: DataFrame, rows: DataFrame, k: int = 1, count: int = 64, slack: float = 1e-6) -> DataFrame:
    """(qid, id, q, v) of queries (qid, v) and rows (id, v) that must be compared for the k nearest rows of each query. The k
    nearest of its own cell bound what can still be nearer. By the triangle inequality a cell has nothing within the bound unless
    its pivot is within bound and radius, and a row of it is not within the bound unless its distance to the pivot is that near
    to the query's. The pivots, `count` vectors, are all that is broadcast."""
    pivots = pivots_of(rows, count)
    placed = in_cells(rows, pivots).select("id", "v", "cell", "off")
    radii = placed.groupBy("cell").agg(F.max("off").alias("radius"))
    asked = in_cells(queries, pivots).withColumnRenamed("v", "q")
    own = asked.select("qid", "q", "cell").join(placed, "cell").where("qid <> id").select("qid", _apart(F.col("q"), F.col("v")).alias("distance"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("distance"))
    bound = own.withColumn("n", nth).where(F.col("n") == k).select("qid", (F.col("distance") + slack).alias("bound"))
    each = asked.join(bound, "qid", "left").select("qid", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), F.explode("to").alias("t"))
    each = each.select("qid", "q", "bound", F.col("t.cell").alias("cell"), F.col("t.off").alias("away"))
    may = each.join(radii, "cell").where(F.col("away") - F.col("radius") <= F.col("bound"))
    near = may.join(placed, "cell").where((F.col("qid") != F.col("id")) & (F.abs(F.col("away") - F.col("off")) <= F.col("bound")))
    return near.select("qid", "id", "q", "v")


def nearest_in_cells(queries: DataFrame, rows: DataFrame, k: int = 1, count: int = 64) -> DataFrame:
    """As nearest(), comparing only what cell_pairs() leaves: (qid, id, distance, rank). Ties of distances, to 9 decimals, go to
    the smaller id."""
    w = Window.partitionBy("qid").orderBy(F.round("distance", 9), "id")
    pairs = cell_pairs(queries, rows, k, count).select("qid", "id", _apart(F.col("q"), F.col("v")).alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
