"""Hard negatives: for each anchor and positive, the highest scored rows of other labels within a band under the positive.

Rows are quantised to integers and dealt into blocks by a hash of their row number, anchors (a stated part of the rows) into
blocks of their own. Each cell, one block of anchors against one of rows, is one row of a join of packed blocks: a matrix
product gives the integer scores, and each anchor's scores are sorted whole by score and vec_id. The first pass reads the
first rows of the anchor's own label off the sorted scores, the second looks up each positive's upper limit by binary search
and reads the first rows of other labels from there, down to the lower limit. What the cells find is merged per anchor: the
first k of all rows are among the first k of each block, so the result is that of one sort over all rows, while a task holds
one cell, whatever the tables' size. Only two counts go through the driver.

A row takes part if it has a vec_id, a label and a vector whose components are all there and finite. Vectors of different
length are compared as if filled up with zeros. Repeated rows are rows of their own: each repeated anchor mines for itself,
and ties of equal score and vec_id are listed one by one. A vec_id divisible by `relabel` first takes the label (label + 1) %
10. An anchor without positives, and a positive without rows in its band, give no row; so do a positive of negative score,
whose band is empty, and an empty table. Quantised components beyond 2 ** 52 become that; a score beyond 64 bits is ranked
exactly and given as null. Further columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.llm.common import cut, drop_cut, table
from mailquarry.llm.vectors import complete, largest, quantised, unpacked

SCALE, EVERY, RELABEL, POSITIVES, NEGATIVES = 256, 50, 7, 5, 3
#: The band of a negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
#: Rows and anchors of a block, at most so many bytes of vectors, and anchors scored at a time.
ROWS, ANCHORS, BYTES, STRIP = 8192, 4096, 1 << 24, 128
_ROW = "rid long, vec_id long, label long, q binary"
_FOUND = "anchor long, anchor_id long, slot int, rid long, vec_id long, score decimal(38,0)"


def _pack(batches):
    for batch in batches:
        packed = [quantised(v, SCALE) for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "vec_id", "label")), pa.array(packed, pa.binary())], ["rid", "vec_id", "label", "q"])


def quantised_rows(vectors: DataFrame, relabel: int = RELABEL) -> DataFrame:
    """(rid, vec_id, label, q) of the rows that take part: a written table, so that row numbers stay as they are."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % 10).otherwise(label)
    kept = vectors.where(complete("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = kept.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return cut(rows.mapInArrow(_pack, _ROW), "vectors")


def _joined(key, rows):
    """A block as one row: numbers as bytes, vectors and lists of scores one behind the other. Rows are in the order of vec_id,
    so that a row's place decides ties."""
    rows = rows.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
    out = {"block": pa.array([key[0].as_py()], pa.int32())}
    for c in ("rid", "vec_id", "label"):
        out[c] = pa.array([rows.column(c).to_numpy().astype("<i8").tobytes()], pa.binary())
    packed = rows.column("q").to_pylist()
    out["lengths"] = pa.array([np.fromiter(map(len, packed), "<i4", len(packed)).tobytes()], pa.binary())
    out["q"] = pa.array([b"".join(packed)], pa.binary())
    if "wanted" in rows.column_names:
        out["wanted"] = pa.array(["\n".join(rows.column("wanted").to_pylist())], pa.string())
    return pa.table(out)


def _blocks(rows: DataFrame, count: int, size: int) -> tuple[DataFrame, int]:
    """The rows in blocks of about `size`, by a hash of their number, and how many blocks there are."""
    blocks = max(1, -(-count // size))
    schema = "block int, rid binary, vec_id binary, label binary, lengths binary, q binary" + ", wanted string" * ("wanted" in rows.columns)
    return rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_joined, schema), blocks


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of x and y: 64-bit integers, or Python's where those do not hold them."""
    dim = min(x.shape[1], y.shape[1])
    x, y = x[:, :dim], y[:, :dim]
    most = largest(x) * largest(y) * dim
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T if most < 1 << 62 else x.astype(object) @ y.T.astype(object)


def sorted_scores(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of scores in order, higher ones first and ties by place: the places, and the negated scores."""
    n = s.shape[1]
    if s.dtype != object and largest(s) < (1 << 62) // max(n, 1):
        key = np.sort(-s * n + np.arange(n), axis=1)
        return key % n, key // n
    order = np.argsort(-s, axis=1, kind="stable")
    return order, np.take_along_axis(-s, order, axis=1)


def _first_of_own_label(k: int):
    """The first k other rows of the anchor's label, as (slot, place among the sorted scores)."""

    def pick(label, wanted, negated, labels, own):
        return [(0, int(p)) for p in np.flatnonzero((labels == label) & ~own)[:k]]

    return pick


def _first_below(k: int, lowest: int, highest: int):
    """For each positive, a slot, the first k rows of another label from its upper limit down to its lower one."""

    def pick(label, wanted, negated, labels, own):
        other = np.flatnonzero(labels != label)
        limits = negated[other]
        for slot, score in enumerate(map(int, wanted.split())):
            at = int(np.searchsorted(limits, -(score * highest // 100), "left"))
            yield from ((slot, int(p)) for p in other[at : at + k] if -int(negated[p]) * 100 >= score * lowest)

    return pick


def _cells(pick):
    """Of each cell, what pick() reads off each anchor's sorted scores."""

    def side(cell, prefix):
        numbers = [np.frombuffer(cell[f"{prefix}{c}"], "<i8") for c in ("rid", "vec_id", "label")]
        ends = np.cumsum(np.frombuffer(cell[f"{prefix}lengths"], "<i4")).tolist()
        return *numbers, unpacked([cell[f"{prefix}q"][a:b] for a, b in zip([0, *ends], ends)])

    def run(batches):
        for batch in batches:
            for cell in batch.to_pylist():
                (rid, vec_id, label, y), (a_rid, a_id, a_label, x) = side(cell, ""), side(cell, "a_")
                wanted = cell["a_wanted"].split("\n") if "a_wanted" in cell else [""] * len(x)
                for at in range(0, len(x), STRIP):
                    order, negated = sorted_scores(scores(x[at : at + STRIP], y))
                    rows = []
                    for i, places in enumerate(order, at):
                        for slot, p in pick(a_label[i], wanted[i], negated[i - at], label[places], rid[places] == a_rid[i]):
                            r = places[p]
                            rows.append((a_rid[i], a_id[i], slot, rid[r], vec_id[r], Decimal(-int(negated[i - at][p]))))
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def _grid(anchors: DataFrame, anchor_blocks: int, rows: DataFrame, row_blocks: int, pick) -> DataFrame:
    """Every block of anchors meets every block of rows once: each side is given the numbers of the other's blocks, and the
    join by both numbers spreads the cells over all tasks."""
    left = anchors.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns[1:]], F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("r"))
    right = rows.select(F.col("block").alias("r"), *rows.columns[1:], F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("a"))
    return left.hint("merge").join(right, ["a", "r"]).mapInArrow(_cells(pick), _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each `by`, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, relabel: int = RELABEL) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the negatives of each anchor, a row whose
    vec_id is divisible by `every`, and each of its positives, its first other rows of the same label."""
    rows = quantised_rows(vectors, relabel)
    anchors = rows.where(F.col("vec_id") % every == 0)
    n, m, longest = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(F.length("q")), F.lit(1))).first()
    most = BYTES // longest or 1
    row_blocks, r = _blocks(rows, n, min(ROWS, most))
    row_blocks = cut(row_blocks, "row-blocks")
    anchor_blocks, a = _blocks(anchors, m, min(ANCHORS, most))
    near = _first(_grid(anchor_blocks, a, row_blocks, r, _first_of_own_label(positives)), ["anchor"], positives)
    near = cut(near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("w"))
    wanted = wanted.select(F.col("anchor").alias("rid"), F.concat_ws(" ", F.transform("w", lambda x: x["positive_score"].cast("string"))).alias("wanted"))
    with_wanted, a = _blocks(anchors.join(wanted, "rid"), m, min(ANCHORS, most))
    below = _first(_grid(with_wanted, a, row_blocks, r, _first_below(negatives, lowest, highest)), ["anchor", "slot"], negatives)
    found = below.select("anchor", "slot", "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["anchor", "slot"])
    out = cut(found.select("anchor_id", "positive_id", "rank", "negative_id", *[F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("positive_score", "negative_score")]), "negatives")
    drop_cut(rows, row_blocks, near)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = {
    "op11_hard_negatives": f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LOWEST} * p.score <= 100 * s.score AND 100 * s.score <= {HIGHEST} * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
}
QUERIES = {"op11_hard_negatives": op11_hard_negatives}
