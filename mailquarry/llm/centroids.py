"""Clusters of vectors by Lloyd's rounds on weighted distinct vectors.

Vectors are quantised to integers; equal ones are one row with its multiplicity, so the rounds read each different vector
once however often it is there. A round assigns the vectors in each task and sends one weighted integer sum a task, cluster
and dimension; sums, counts and so centroids are exact, whatever the order of tasks. Only sums reach the driver and only
centroids leave it: their number is that of clusters times dimensions. At the end the assignments are joined back to the
vec_ids: vectors that more than one in SHARE of the rows have, of which there are at most SHARE, by a broadcast join, so that
no task gets all rows of one vector; all others by a shuffled join.

A row takes part if its vector has exactly the given number of components, none null or not finite; others give no row. A row
without a vec_id counts in sums and is given back, but starts no centroid. Repeated rows stay repeated. Ties of distance go to
the smaller cluster. Fewer rows than clusters start fewer clusters, an empty table gives an empty result. Quantised
components beyond 2 ** 52 become that; a distance or an inertia beyond 64 bits is null. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm.common import cut, drop_cut, table
from mailquarry.llm.vectors import complete, largest, quantised, unpacked

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: A vector of more than one in SHARE of the rows is joined back by broadcast.
SHARE = 512
_LIMIT = 1 << 63


def _pack(scale: int):
    def run(batches):
        for batch in batches:
            packed = [quantised(v, scale) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "q"])

    return run


def quantised_rows(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the rows that take part: q is the packed quantised vector."""
    kept = vectors.where(complete("embedding") & (F.size("embedding") == dim))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_pack(scale), "vec_id long, q binary")


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row of x, and the squared distance, exactly."""
    c = np.array(centroids, object)
    most = max(largest(x), *(abs(v) for row in centroids for v in row))
    if 4 * x.shape[1] * most * most < 1 << 53:
        f, g = x.astype(np.float64), c.astype(np.float64)
        d = ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    else:
        d = np.stack([((x.astype(object) - row) ** 2).sum(1) for row in c], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _weighted(x: np.ndarray, w: np.ndarray) -> list[int]:
    """The sum of the rows of x, each w times."""
    if largest(x) * int(w.sum()) < 1 << 62:
        return (w[:, None] * x).sum(0).tolist()
    return (w.astype(object)[:, None] * x.astype(object)).sum(0).tolist()


def _sums(centroids: list[list[int]]):
    """(cluster, j, s): the weighted sum of component j, and of the weights as j = -1, over what a task has read."""

    def run(batches):
        total: dict[int, list[int]] = {}
        for batch in batches:
            x, w = unpacked(batch.column("q").to_pylist()), batch.column("w").to_numpy()
            at, _ = nearest(x, centroids)
            for k in np.unique(at).tolist():
                mine = at == k
                more = [int(w[mine].sum()), *_weighted(x[mine], w[mine])]
                total[k] = [a + b for a, b in zip(total[k], more)] if k in total else more
        rows = [(k, j - 1, Decimal(s)) for k, all_ in total.items() for j, s in enumerate(all_)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.decimal128(38, 0)))], ["cluster", "j", "s"])

    return run


def _assign(centroids: list[list[int]]):
    def run(batches):
        for batch in batches:
            at, d = nearest(unpacked(batch.column("q").to_pylist()), centroids)
            d = pa.array([Decimal(v) for v in d.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("w"), pa.array(at.astype(np.int32)), d], ["q", "w", "cluster", "d"])

    return run


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose vec_ids hash least under the seed, in that order: at most `clusters` rows reach the driver."""
    hashed = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    return unpacked([bytes(r.q) for r in hashed.orderBy("h", "q").limit(clusters).collect()]).tolist()


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after so many rounds over (q, w). Rounds end early once nothing moves."""
    for _ in range(rounds):
        found = distinct.mapInArrow(_sums(centroids), "cluster int, j int, s decimal(38,0)").groupBy("cluster", "j").agg(F.sum("s").alias("s")).collect()
        sums = {(r.cluster, r.j): int(r.s) for r in found}
        moved = [[sums[k, j] // sums[k, -1] for j in range(len(c))] if (k, -1) in sums else c for k, c in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def clusters_of(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of each row of vectors (vec_id, embedding) that takes part, and the
    centroids."""
    rows = cut(quantised_rows(vectors, dim, scale), "vectors")
    start = first_centroids(rows, clusters, seed)
    if not start:
        return rows.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia"), []
    distinct = cut(rows.groupBy("q").agg(F.count(F.lit(1)).alias("w")), "distinct-vectors")
    final = lloyd(distinct, start, rounds)
    assigned = cut(distinct.mapInArrow(_assign(final), "q binary, w long, cluster int, d decimal(38,0)"), "assigned")
    drop_cut(distinct)
    of = {r.cluster: (r.w, r.s) for r in assigned.groupBy("cluster").agg(F.sum("w").alias("w"), F.expr("try_sum(CAST(d * w AS decimal(38,0)))").alias("s")).collect()}
    n = sum(w for w, _ in of.values())
    known = {k: None if s is None or s >= _LIMIT else int(s) for k, (_, s) in of.items()}
    total = sum(known.values()) if None not in known.values() and sum(known.values()) < _LIMIT else None
    inertia = F.create_map(*[x for k, s in known.items() for x in (F.lit(k), F.lit(s).cast("long"))])
    named = assigned.select("q", "w", "cluster", F.expr("try_cast(d AS bigint)").alias("distance"))
    usual, frequent = (named.where((F.col("w") * SHARE > n) == hot).drop("w") for hot in (False, True))
    back = rows.join(F.broadcast(frequent), "q").unionByName(rows.join(F.broadcast(frequent.select("q")), "q", "left_anti").join(usual.hint("shuffle_merge"), "q"))
    return back.select("vec_id", "cluster", "distance", inertia[F.col("cluster")].alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia")), final


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters_of(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = F.element_at(F.array(*map(F.lit, digests or [""])), F.col("cluster") + 1)
    return found.withColumn("centroid_sha256", named)


def _sql() -> str:
    d2 = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS c FROM (SELECT q, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {CLUSTERS}))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, arg_min(k, d * {CLUSTERS} + k) AS k, min(d) AS d
  FROM (SELECT vec_id, q, k, CAST({d2} AS BIGINT) AS d FROM kept, c{r}) GROUP BY vec_id)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT k, list(m ORDER BY j) AS c FROM (
    SELECT k, j, CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) AS m
    FROM (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{r}) GROUP BY k, j)) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (k))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE_SQL = {"op13_centroid_clustering": _sql()}
