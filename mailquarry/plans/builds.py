"""Queries of builds in rounds and of mailbox files, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from mailquarry.operators import models, rounds
from mailquarry.operators import retrieval as S
from mailquarry.plans.search import _Q, _SCORES, _TOP, _asks, _docs, read
from mailquarry.shared import scratch
from mailquarry.sources import mail as files
from mailquarry.sources import mbox

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _digit(c):
    return F.conv(F.substring(c, 1, 1), 16, 10).cast("int")


def _plan(df):
    """Two to four clues can be planned."""
    return df.withColumn("verdict", F.when(F.col("n") > 4, "drop").otherwise("ok"))


def _plot(df):
    drawn = df.withColumn("plot", F.sha2(F.concat_ws("|", "seed", "way", "tries", "feedback"), 256))
    bad = _digit(F.col("plot")) < 4
    return drawn.withColumn("verdict", F.when(bad, "plot").otherwise("ok")).withColumn("feedback", F.when(bad, "again").otherwise(F.col("feedback")))


def _email(df):
    """A leak goes back to the plot, a slip to the mail."""
    drawn = df.withColumn("email", F.sha2(F.concat_ws("|", "plot", "tries", "feedback"), 256))
    d = _digit(F.col("email"))
    said = F.when(d < 4, "leak").when(d < 8, "slip").otherwise("")
    return drawn.withColumn("verdict", F.when(d < 4, "plot").when(d < 8, "email").otherwise("ok")).withColumn("feedback", said)


_STAGES = [rounds.Stage("plan", _plan), rounds.Stage("plot", _plot), rounds.Stage("email", _email)]
_HEX = "('0x' || substr({0}, 1, 1))::INT"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, sha256(coalesce(text, '')) AS seed, CASE WHEN doc_id % 2 = 0 THEN ['commission', 'paltering'] ELSE ['paltering', 'commission'] END AS ways FROM documents),
f AS (SELECT doc_id, seed, 2 + {_HEX.format('seed')} % 4 AS n, 'OPEN' AS status, 0 AS stage, 0 AS tries, ways[1] AS way, ways[2:] AS ways, '' AS feedback, '' AS plot, '' AS email, 0 AS round, '' AS log FROM c
UNION ALL SELECT doc_id, seed, n,
 CASE WHEN v = 'ok' THEN CASE stage WHEN 2 THEN 'KEPT' ELSE 'OPEN' END WHEN v = 'drop' OR tries + 1 >= 2 AND len(ways) = 0 THEN 'DROP' ELSE 'OPEN' END,
 CASE WHEN v = 'ok' THEN least(stage + 1, 2) WHEN v = 'drop' OR tries + 1 >= 2 AND len(ways) = 0 THEN stage WHEN tries + 1 >= 2 THEN 0 WHEN v = 'plot' THEN 1 ELSE 2 END,
 CASE WHEN v IN ('ok', 'drop') THEN tries WHEN tries + 1 >= 2 AND len(ways) > 0 THEN 0 ELSE tries + 1 END,
 CASE WHEN v NOT IN ('ok', 'drop') AND tries + 1 >= 2 AND len(ways) > 0 THEN ways[1] ELSE way END,
 CASE WHEN v NOT IN ('ok', 'drop') AND tries + 1 >= 2 THEN ways[2:] ELSE ways END,
 CASE WHEN v NOT IN ('ok', 'drop') AND tries + 1 >= 2 AND len(ways) > 0 THEN '' ELSE said END,
 p, m, round + 1, log || '>' || ['plan', 'plot', 'email'][stage + 1] || ':' || v
 FROM (SELECT *, CASE stage WHEN 0 THEN CASE WHEN n > 4 THEN 'drop' ELSE 'ok' END WHEN 1 THEN CASE WHEN {_HEX.format('p')} < 4 THEN 'plot' ELSE 'ok' END ELSE CASE WHEN {_HEX.format('m')} < 4 THEN 'plot' WHEN {_HEX.format('m')} < 8 THEN 'email' ELSE 'ok' END END AS v,
 CASE stage WHEN 0 THEN feedback WHEN 1 THEN CASE WHEN {_HEX.format('p')} < 4 THEN 'again' ELSE feedback END ELSE CASE WHEN {_HEX.format('m')} < 4 THEN 'leak' WHEN {_HEX.format('m')} < 8 THEN 'slip' ELSE '' END END AS said
 FROM (SELECT *, CASE stage WHEN 1 THEN sha256(seed || '|' || way || '|' || tries || '|' || feedback) ELSE plot END AS p, CASE stage WHEN 2 THEN sha256(plot || '|' || tries || '|' || feedback) ELSE email END AS m FROM f WHERE status = 'OPEN')))
SELECT doc_id, n, status, way, tries, plot, email, round, substr(log, 2) AS log FROM f WHERE status <> 'OPEN'""")
def build_rounds(spark, d):
    """Cases of all documents built in rounds: planned, plotted and written with two tries for each of two ways. A part of them has
    begun when the others come in. The rounds run as the query is planned."""
    seed = F.sha2(F.coalesce("text", F.lit("")), 256)
    cases = read(spark, d, "documents").select("doc_id", seed.alias("seed"), (_digit(seed) % 4 + 2).alias("n"), F.lit("").alias("plot"), F.lit("").alias("email"))
    names = [F.lit("commission"), F.lit("paltering")]
    ways = F.when(F.col("doc_id") % 2 == 0, F.array(*names)).otherwise(F.array(*names[::-1]))
    at = scratch(spark, "rounds")
    rounds.begin(cases.where("doc_id % 3 = 0"), at, "doc_id", ways=ways)
    rounds.step(spark, at, _STAGES, 2)
    rounds.begin(cases, at, "doc_id", ways=ways)
    out = rounds.run(spark, at, _STAGES, 2)
    return out.select("doc_id", "n", "status", "way", "tries", "plot", "email", "round", F.array_join("log", ">").alias("log"))


@query("SELECT doc_id, 'ada@x.example' AS sender, coalesce(text, '') AS body FROM documents")
def mbox_scan(spark, d):
    """Whole documents as messages of mbox files, read back in ranges of 256 KB at least."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^(>*From )", ">$1")
    head = "From ada@x.example Thu Jan  1 00:00:00 1998\nFrom: ada@x.example\nSubject: %d\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n%s"
    at = scratch(spark, "mbox")
    read(spark, d, "documents").select(F.format_string(head, "doc_id", said).alias("value")).write.text(at)
    mail = mbox.read_mail(spark, at, schema="sender string, subject string, body string", split=1 << 18)
    return mail.select(F.col("subject").cast("long").alias("doc_id"), "sender", "body")


def _picks():
    """A stand-in for a model: names the even handles of a prompt from the last to the first, one twice and one that is none; says
    nothing to the point for every third query."""

    def answer(prompt: str) -> str:
        head, *lines = prompt.split("\n")
        even = [h for h in lines if int(h[1:]) % 2 == 0][::-1]
        return "no idea" if int(re.sub("[^0-9]", "", head)) % 3 == 0 else f"best: {', '.join(even[:1] + even)}, e999999999"

    return lambda prompts: [answer(p) for p in prompts]


@query(f"""WITH {_Q}{_SCORES},{_TOP}, pools AS (SELECT qid, doc, rank, count(*) OVER (PARTITION BY qid) AS n, doc % 2 = 0 AND qid % 3 <> 0 AS named FROM r WHERE rank <= 20),
asked AS (SELECT *, count(*) FILTER (named) OVER (PARTITION BY qid) > 0 AND n > 8 AS hit FROM pools)
SELECT qid, doc, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN hit THEN -rank ELSE rank END) AS INT) AS shown FROM asked WHERE NOT hit OR named
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN hit THEN -rank ELSE rank END) <= 8""")
def rerank_model(spark, d):
    """Pools of 20 documents of every passage, of which a model names up to eight; the pool's order where it names none."""
    pool = S.best(_docs(spark, d), _asks(spark, d), 20).withColumn("handle", F.concat(F.lit("e"), F.col("doc").cast("string")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "handle"))), lambda x: x["handle"])
    asks = pool.groupBy("qid").agg(listed.alias("h")).where(F.size("h") > 8)
    prompt = F.concat_ws("\n", F.concat(F.lit("passage "), F.col("qid").cast("string")), F.array_join("h", "\n"))
    said = asks.select("qid", models.generated(_picks, prompt).alias("said"))
    return S.reranked(pool.join(said, "qid", "left"), "said", 8).select("qid", "doc", "shown")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS plot, source AS secret, NULL::VARCHAR AS either_or, '2001-02-03' AS era FROM documents")
def topics_load(spark, d):
    """Topics of whole texts as JSON lines, each written twice; the later row of an id counts."""
    path = scratch(spark, "topics")
    t = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("plot"), F.col("source").alias("secret"), F.lit("2001-02-03T04:05").alias("era"))
    files.write_jsonl(t.withColumn("plot", F.lit("old")).union(t), path)
    return files.load_topics(spark, path)


@query("""SELECT CAST(user_id AS VARCHAR) AS sample, CAST(event_id % 3 AS INT) AS epoch, CAST(max_by(value, event_id) > 50 AS VARCHAR) AS found, max_by(event_type, event_id) AS secret FROM events GROUP BY user_id, event_id % 3""")
def log_rows(spark, d):
    """Evaluation rows of logs as JSON lines: the latest sample of each user and epoch."""
    path = scratch(spark, "logs")
    e = read(spark, d, "events")
    files.write_jsonl(e.select(F.col("user_id").cast("string").alias("sample"), (F.col("event_id") % 3).cast("int").alias("epoch"), F.format_string("%012d", "event_id").alias("logged"), F.to_json(F.struct((F.col("value") > 50).alias("found"))).alias("values"), F.col("event_type").alias("answer")), path)
    return files.rows_from_logs(spark, path).select("sample", "epoch", "found", "secret")
