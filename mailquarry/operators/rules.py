"""The rules of a session as columns of its log: what counts as investigation, when an answer is taken, what a log amounts to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.functions import text as T


def credits(events: Column, limit: float = 0.8) -> Column:
    """The investigation credit behind each of array<struct<tool,toks>>: every READ counts, repeated or not, and every SEARCH with
    words whose set is below the limit against all searches that counted before."""
    start = F.expr("cast(struct(array(), 0, array()) as struct<kept: array<array<string>>, n: int, out: array<int>>)")

    def step(s, e):
        new = F.coalesce((e["tool"] == "SEARCH") & (F.size(e["toks"]) > 0), F.lit(False)) & F.forall(s["kept"], lambda k: T.jaccard(k, e["toks"]) < limit)
        n = s["n"] + new.cast("int") + F.coalesce(e["tool"] == "READ", F.lit(False)).cast("int")
        return F.struct(F.when(new, F.concat(s["kept"], F.array(e["toks"]))).otherwise(s["kept"]).alias("kept"), n.alias("n"), F.concat(s["out"], F.array(n)).alias("out"))

    return F.aggregate(events, start, step)["out"]


def with_credit(log: DataFrame, session: str, order: str, tool: str, words: Column) -> DataFrame:
    """log with `credit` behind each of its events, in the order of a session; words is the set of a search's words. A session is
    one row while it is gone through: a budget bounds its length."""
    rest = [c for c in log.columns if c not in (session, order)]
    one = F.struct(order, *rest, F.coalesce(words, F.array().cast("array<string>")).alias("_toks"))
    g = log.groupBy(session).agg(F.array_sort(F.collect_list(one)).alias("_e"))
    each = F.transform("_e", lambda e: F.struct(e[tool].alias("tool"), e["_toks"].alias("toks")))
    zipped = F.explode(F.arrays_zip(F.col("_e"), credits(each).alias("credit"))).alias("_z")
    return g.select(session, zipped).select(session, *[F.col(f"_z._e.{c}").alias(c) for c in (order, *rest)], F.col("_z.credit").alias("credit"))


def too_early(used: Column, budget: int, credit: Column, least: int, last_tool: Column, last_hits: Column) -> Column:
    """Why an answer is refused while the budget lasts: too little investigation, or a search just before whose results are not
    read. Null where it is not."""
    free = used < budget
    unread = F.coalesce((last_tool == "SEARCH") & (last_hits > 0), F.lit(False))
    return F.when(free & (credit < least), "investigate").when(free & unread, "unread")


def candidates(said: Column) -> Column:
    """The entries of an answer's JSON, null if it is no list."""
    v = F.try_parse_json(said)
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    return F.when(is_list, F.try_variant_get(v, "$", "array<variant>"))


def secret_of(candidate: Column) -> Column:
    """The trimmed secret; null if it is no text."""
    kind = F.schema_of_variant(F.try_variant_get(candidate, "$.secret", "variant"))
    return F.when(kind == "STRING", F.trim(F.try_variant_get(candidate, "$.secret", "string")))


def misshapen(said: Column, limit: int, evidence: str = "evidence_email_ids") -> Column:
    """Why an answer cannot be read: it is no list, has neither no candidate nor `limit`, or, of the first candidate at fault, has
    no secret or evidence that is no list of texts. Null where it can."""
    entries = candidates(said)

    def fault(c):
        kind = F.schema_of_variant(F.try_variant_get(c, f"$.{evidence}", "variant"))
        listed = F.try_variant_get(c, f"$.{evidence}", "array<variant>")
        sound = kind.isNull() | (kind.startswith("ARRAY") & F.forall(listed, lambda x: F.schema_of_variant(x) == "STRING"))
        return F.when(F.coalesce(secret_of(c), F.lit("")) == "", "no secret").when(~F.coalesce(sound, F.lit(False)), "evidence")

    n = F.size(entries)
    first = F.get(F.filter(F.transform(entries, fault), lambda x: x.isNotNull()), 0)
    return F.when(entries.isNull(), "not a list").when((n > 0) & (n != limit), "count").when(n > 0, first)


def trajectory(log: DataFrame, session: str, tool: str, returned: str) -> DataFrame:
    """(session, n_tool_calls, n_search, n_read, n_emails_opened, n_redundant_reads) of a log whose `returned` lists the handles
    that a call showed."""
    shown = F.when(F.col(tool) == "READ", F.col(returned))
    g = log.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_tool_calls"), F.count_if(F.col(tool) == "SEARCH").alias("n_search"), F.count_if(F.col(tool) == "READ").alias("n_read"),
        F.sum(F.coalesce(F.size(shown), F.lit(0))).alias("_all"), F.size(F.array_distinct(F.flatten(F.collect_list(shown)))).cast("long").alias("n_emails_opened"),
    )
    return g.withColumn("n_redundant_reads", F.col("_all") - F.col("n_emails_opened")).drop("_all")
