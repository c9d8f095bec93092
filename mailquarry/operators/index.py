"""A stored inverted index with exact pruned top-k.

An index is a folder of tables. `blocks` has each term's postings in blocks of up to BLOCK, those with the greatest weight
first, and for each block the greatest frequency and the least length in it: the weight of a posting grows with the one and
falls with the other, so together they bound every weight in the block whatever documents are added later. `forward` has each
document's terms with their frequencies. Documents that are added become a segment of their own; a segment counts once its
line in `segments` is written, which is last, so a build that broke off leaves nothing visible.

A search reads three things. (1) The first block of each of a query's terms: the k-th best sum of what is found there is at
most the k-th best score. (2) The terms of a query in the order of their greatest weights, lightest first: a document whose
heaviest term is t scores at most that posting's weight plus the greatest weights of all lighter terms, so only blocks for
which this reaches the k-th best can hold a document's heaviest term, and all others are skipped. (3) For documents found there that
can still reach the k-th best with what they were not met with, their terms in `forward`, which give the exact scores. So
results are those of reading every posting.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.operators import retrieval as S

BLOCK = 64
#: What rounding may move a sum by.
SLACK = 1e-6
#: Lighter terms are left to `forward` while their weights come to at most this share of the k-th best score.
LIGHT = 0.5


@dataclass(frozen=True)
class Index:
    """A written index: its tables, and what a search needs to know of all documents."""

    spark: SparkSession
    folder: str
    #: Type of the documents' numbers or names.
    doc: str

    def table(self, name: str) -> DataFrame:
        schema = {
            "blocks": f"term string, part int, block int, n int, most int, least int, postings array<struct<doc: {self.doc}, f: int, dl: int>>, segment string",
            "forward": f"doc {self.doc}, dl int, terms array<struct<term: string, f: int>>, segment string",
            "segments": "segment string, docs long, tokens long",
        }[name]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def segments(self) -> list:
        return self.table("segments").collect()

    def live(self, name: str) -> DataFrame:
        """The rows of segments that are complete."""
        return self.table(name).where(F.col("segment").isin([r.segment for r in self.segments()]))

    def sizes(self) -> tuple[int, float]:
        """The number of documents and their average length."""
        rows = self.segments()
        docs = sum(r.docs for r in rows)
        return docs, sum(r.tokens for r in rows) / docs if docs else 0.0


def _share(f: Column, dl: Column, average: float, k1: float, b: float) -> Column:
    """A posting's weight without its term's."""
    length = dl / F.lit(average if average > 0 else 1.0)
    return f * (k1 + 1) / (f + k1 * (1 - b + b * length))


def add(index: Index, docs: DataFrame) -> Index:
    """Adds docs (doc, tokens) as a new segment. Documents with the id of an earlier one are documents of their own."""
    segment = uuid.uuid4().hex
    at = f"{index.folder}/{{}}"
    counted = docs.select("doc", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).groupBy("doc", "dl", "term").agg(F.count("term").alias("f"))
    forward = counted.groupBy("doc", "dl").agg(F.filter(F.collect_list(F.struct("term", F.col("f").cast("int").alias("f"))), lambda x: x["term"].isNotNull()).alias("terms"))
    forward.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(at.format("forward"))
    written = index.table("forward").where(F.col("segment") == segment)
    docs_, tokens = written.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    each = written.select("doc", "dl", F.explode("terms").alias("t")).select("t.term", "t.f", "doc", "dl")
    # a frequent term's postings are put in order in parts by a hash of the document, so that no task gets all of them
    sizes = each.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / F.lit(1 << 16)).cast("int").alias("parts"))
    dealt = each.join(sizes, "term").withColumn("part", F.pmod(F.xxhash64("doc"), "parts").cast("int"))
    weight = _share(F.col("f"), F.col("dl"), tokens / docs_ if docs_ else 0.0, S.K1, S.B)
    nth = F.row_number().over(Window.partitionBy("term", "part").orderBy(weight.desc(), "doc")) - 1
    posting = F.struct("doc", F.col("f").cast("int").alias("f"), "dl")
    blocks = dealt.withColumn("block", F.floor(nth / BLOCK).cast("int")).groupBy("term", "part", "block").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("f").cast("int").alias("most"), F.min("dl").alias("least"), F.collect_list(posting).alias("postings"))
    blocks.withColumn("segment", F.lit(segment)).sortWithinPartitions("term", "block").write.mode("append").partitionBy("segment").parquet(at.format("blocks"))
    index.spark.createDataFrame([(segment, docs_, tokens)], "segment string, docs long, tokens long").coalesce(1).write.mode("append").parquet(at.format("segments"))
    return index


def build(docs: DataFrame, folder: str) -> Index:
    """A new index of docs (doc, tokens) in an empty folder."""
    return add(Index(docs.sparkSession, folder, docs.schema["doc"].dataType.simpleString()), docs)


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(qid, name): the k-th greatest of each query's sums, where there are so many."""
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sum")))
    return sums.withColumn("nth", nth).where(F.col("nth") == k).select("qid", F.col("sum").alias(name))


def search(index: Index, queries: DataFrame, k: int, k1: float = S.K1, b: float = S.B, apart: bool = False, light: float = LIGHT) -> DataFrame:
    """(qid, doc, score, rank): the k best documents of each of queries (qid, tokens), as retrieval.top_k() of
    retrieval.bm25_scores() has them. apart: a query is a document's number, which is left out of its own results."""
    docs, average = index.sizes()
    blocks, forward = index.live("blocks"), index.live("forward")
    want = k + apart
    share = lambda f, dl: _share(F.col(f), F.col(dl), average, k1, b)
    asked = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    heads = blocks.select("segment", "term", "part", "block", "n", share("most", "least").alias("s")).join(asked.select("term").distinct(), "term", "left_semi")
    terms = heads.groupBy("term").agg(F.sum("n").alias("n"), F.max("s").alias("s"))
    idf = F.log(1 + (docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = asked.join(terms, "term").select("qid", "term", idf.alias("idf"), (idf * F.col("s")).alias("most"))
    lighter = Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = weighed.withColumn("upto", F.sum("most").over(lighter))
    # (1)
    posting = lambda rows: rows.select("qid", "term", "idf", "bound", F.explode("postings").alias("p")).select("qid", "term", "bound", "p.doc", (F.col("idf") * share("p.f", "p.dl")).alias("w"))
    first = posting(weighed.withColumn("bound", F.lit(0.0)).join(blocks.where("block = 0"), "term")).groupBy("qid", "doc").agg(F.sum("w").alias("sum"))
    floor = _kth(first, want, "floor")
    held = weighed.join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    # (2)
    light_ = F.col("upto") <= light * F.col("floor")
    reach = F.col("idf") * share("most_f", "least") + F.col("upto") - F.col("most") >= F.col("floor")
    named = blocks.withColumnRenamed("most", "most_f")
    # what is left of a term that is not read whole: at most the bound of the first block that is not
    rest = held.join(named.select("term", "segment", "part", "block", "most_f", "least"), "term").withColumn("open", light_ | ~reach)
    bounds = rest.groupBy("qid", "term").agg(F.max(F.when(F.col("open"), F.col("idf") * share("most_f", "least"))).alias("bound"))
    bounds = held.join(bounds, ["qid", "term"]).withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    total = bounds.groupBy("qid").agg(F.sum("bound").alias("total"), F.first("floor").alias("floor"))
    read = bounds.join(named, "term").where(~light_ & reach)
    met = posting(read).groupBy("qid", "doc").agg(F.sum("w").alias("sum"), F.sum("bound").alias("met"))
    better = _kth(met, want, "better")
    may = met.join(total, "qid").join(better, "qid", "left").where(F.col("sum") + F.col("total") - F.col("met") >= F.greatest("floor", F.coalesce("better", F.lit(0.0)) - SLACK))
    # (3)
    pairs = may.select("qid", "doc").join(forward, "doc").select("qid", "doc", "dl", F.explode("terms").alias("t")).select("qid", "doc", "dl", "t.term", "t.f")
    exact = pairs.join(weighed.select("qid", "term", "idf"), ["qid", "term"]).groupBy("qid", "doc").agg(F.sum(F.col("idf") * share("f", "dl")).alias("score"))
    return S.top_k(exact.where("qid <> doc") if apart else exact, k)


def scores(index: Index, queries: DataFrame, k1: float = S.K1, b: float = S.B) -> DataFrame:
    """(qid, doc, score) for each of queries (qid, tokens) and document that share a term, as retrieval.bm25_scores(): every
    posting of the queries' terms is read, but no text."""
    docs, average = index.sizes()
    blocks = index.live("blocks").select("term", "n", "postings")
    asked = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    held = blocks.join(asked.select("term").distinct(), "term", "left_semi")
    idf = F.log(1 + (docs - F.sum("n") + 0.5) / (F.sum("n") + 0.5))
    weighed = asked.join(held.groupBy("term").agg(idf.alias("idf")), "term")
    each = weighed.join(blocks, "term").select("qid", "idf", F.explode("postings").alias("p"))
    return each.groupBy("qid", F.col("p.doc").alias("doc")).agg(F.sum(F.col("idf") * _share(F.col("p.f"), F.col("p.dl"), average, k1, b)).alias("score"))
