"""Ranked lexical search as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.operators import blocks as P

K1, B = 1.5, 0.75


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc, score) for each query and document that share a term. docs: (doc, tokens), queries: (qid, tokens). A term
    counts once in a query; a document's tokens are met by the queries' terms before they are grouped, so only postings that
    can score are shuffled. The partition of a term that is frequent on both sides is split by the adaptive skew join; dealing
    such terms into blocks by hand cost half the time again at sf0.1."""
    q = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    d = docs.select("doc", "tokens", F.size("tokens").alias("dl"))
    hit = d.select("doc", "dl", F.explode("tokens").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    postings = hit.groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("f"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    stats = d.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    length = F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    idf = F.log(1 + (F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * length))
    weights = postings.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "doc", weight.alias("w"))
    return q.join(weights, "term").groupBy("qid", "doc").agg(F.sum("w").alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "qid", order: str = "doc", score: str = "score") -> DataFrame:
    """The k best of each query with rank from 1; ties, to 9 decimals, go to the smaller document."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col(order))
    return scores.where(F.col(score) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best(docs: DataFrame, queries: DataFrame, k: int, without: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc, score, rank): as top_k() of bm25_scores(), with whole numbers for qid and doc, less the pairs without (qid, doc),
    in blocks: no pair is shuffled but k for each query and task. The documents are written once as blocks, while the plan is
    built. Where docs and queries have a column kin, those of one kin are packed together."""
    packed = P.packed(docs)
    count, tokens = P.sizes(packed)
    average = tokens / count if tokens else 1.0
    kin = [c for c in ("kin",) if c in queries.columns]
    q = queries.select("qid", *kin, F.explode(F.array_distinct("tokens")).alias("term"))
    weights = q.join(P.frequencies(packed), "term").select("qid", *kin, "term", P.idf(F.col("n"), count).alias("w"))
    found = P.best(packed, weights, k, lambda f, dl, norm: f * (k1 + 1) / (f + k1 * (1 - b + b * (dl / average))), without)
    kinds = {c: df.schema[c].dataType for c, df in (("qid", queries), ("doc", docs))}
    return top_k(found.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], "score"), k)


def by_document(docs: DataFrame, asks: DataFrame, k: int = 8) -> DataFrame:
    """Documents like each of asks (doc), itself left out: its own tokens are the query."""
    queries = docs.join(asks.select("doc"), "doc", "left_semi").withColumnRenamed("doc", "qid")
    return best(docs, queries, k, queries.select("qid", F.col("qid").alias("doc")))


def reciprocal_ranks(lists: DataFrame, k: int = 60, top: int = 30) -> DataFrame:
    """(gid, doc, score, rank) from lists (gid, qid, doc, rank from 1): sums of 1 / (k + rank); ties go to the list that
    comes first, then to the better rank."""
    fused = lists.groupBy("gid", "doc").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("qid").alias("q"), F.min("rank").alias("r"))
    w = Window.partitionBy("gid").orderBy(F.round("score", 9).desc(), "q", "r", "doc")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("q", "r")


def rerank(pool: DataFrame, relevance, show: int = 8) -> DataFrame:
    """The first `show` of each query's pool by another column, pool order where that is null or ties."""
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last(relevance), "rank")
    return pool.withColumn("shown", F.row_number().over(w)).where(F.col("shown") <= show)


def reranked(pool: DataFrame, said: str, show: int = 8, handle: str = "handle") -> DataFrame:
    """The messages of each query's pool that a model's text names, in the order in which it first names them, `show` at most; what
    it names beside the pool does not count. The first `show` of the pool where it names none (or is null), and where the pool
    has no more, for which no model need be asked. pool: (qid, rank, ...) with the handles e1, e2, ... and the text, one for a
    query; the result has `shown`, from 1."""
    named = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(said), F.lit("")), F.lit("e[0-9]+"), F.lit(0)))
    whole = Window.partitionBy("qid")
    asked = F.count(F.lit(1)).over(whole) > show
    place = F.nullif(F.array_position(named, F.col(handle)), F.lit(0))
    p = pool.withColumn("_asked", asked).withColumn("_place", F.when(F.col("_asked"), place))
    p = p.withColumn("_any", F.count("_place").over(whole) > 0)
    nth = F.row_number().over(whole.orderBy(F.asc_nulls_last("_place"), "rank"))
    return p.withColumn("shown", nth).where((F.col("shown") <= show) & (~F.col("_any") | F.col("_place").isNotNull())).drop("_asked", "_place", "_any")


def related(scores: DataFrame, top: int = 20, floor: float = 2.0, share: float = 0.15) -> DataFrame:
    """Of each query's top documents those at or above both the floor and a share of the best."""
    greatest = F.max("score").over(Window.partitionBy("qid"))
    return top_k(scores, top).withColumn("best", greatest).where((F.col("score") >= floor) & (F.col("score") >= share * F.col("best")))


def tfidf(docs: DataFrame, least_df: int = 2) -> DataFrame:
    """(doc, term, w): L2-normalised tf-idf of terms in at least least_df documents. Documents are written once as blocks, in which
    the terms get their frequencies, so no posting is shuffled."""
    w = P.tfidf(P.packed(docs), least_df)
    return w.select(F.col("doc").cast(docs.schema["doc"].dataType).alias("doc"), "term", "w")


def nearest_by_tfidf(docs: DataFrame, every: int, k: int, least_df: int = 2) -> DataFrame:
    """(qid, doc, score, rank): the k documents of the highest cosine with each document whose number `every` divides, itself left
    out, in blocks as best() has them."""
    packed = P.packed(docs)
    count, _ = P.sizes(packed)
    normed = P.with_norms(packed, least_df)
    idf = F.log(F.lit(float(count)) / F.col("n"))
    asks = P.own_terms(normed, every).join(P.frequencies(packed).where(F.col("n") >= least_df), "term")
    weights = asks.select(F.col("doc").alias("qid"), "kin", "term", (F.col("w") * idf * idf).alias("w"))
    own = weights.select("qid", F.col("qid").alias("doc")).distinct()
    return top_k(P.best(normed, weights, k, lambda f, dl, norm: f / dl / norm, own), k)
