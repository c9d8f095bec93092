"""Queries that write tables in the formats of the sources, read them back and load them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.plans.search import read
from mailquarry.shared import scratch
from mailquarry.sources import mail

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "jsonl")
    mail.write_jsonl(read(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return mail.read_jsonl(spark, path, "doc_id long, text string, lang string")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status, o_totalprice FROM orders")
def csv_round_trip(spark, d):
    """Results as CSV: a blank is what was not judged."""
    path = scratch(spark, "csv")
    mail.write_results(read(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("O"))), path, ["o_orderkey", "status", "o_totalprice"])
    return mail.read_results(spark, path, "o_orderkey long, status string, o_totalprice double")


def _threads(spark, d) -> DataFrame:
    c = read(spark, d, "conversations")
    message = F.struct(
        "turn", F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.concat("role", F.lit(".one@x.example")).alias("from_addr"), F.lit("Re").alias("subject"), F.lit("2001-02-03T04:05:06+00:00").alias("date"),
        F.concat_ws(" ", F.lit("body"), F.repeat(F.lit("x"), F.col("turn").cast("int") * 6)).alias("body"),
    )
    return c.groupBy(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("thread_id")).agg(F.array_sort(F.collect_list(message)).alias("messages"))


@query("""SELECT 't' || conv_id AS thread_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, conv_id || '-' || turn AS message_id,
CASE WHEN role = 'user' THEN 'The User' ELSE upper(substr(role, 1, 1)) || substr(role, 2) || ' One' END AS from_name, '2001-02-03T04:05:06' AS date FROM conversations
QUALIFY length('Re body ' || repeat('x', turn::INT * 6)) >= 25""")
def corpus_load(spark, d):
    """Threads as JSON lines, loaded as messages long enough, with names from the users' list or from addresses."""
    path = scratch(spark, "threads")
    mail.write_jsonl(_threads(spark, d), path)
    users = spark.createDataFrame([("USER.one@x.example", "The User")], "email string, display_name string")
    return mail.load_messages(mail.read_jsonl(spark, path, mail.THREAD), users).select("thread_id", "pos", "message_id", "from_name", "date")


@query("""WITH c AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'com' ELSE 'pal' END AS config, CASE WHEN item_id % 3 = 0 THEN 'C' ELSE 'W' END || printf('%03d', item_id) AS topic_id, item_id FROM benchmark WHERE item_id % 5 <> 0)
SELECT config, topic_id, item_id FROM c QUALIFY row_number() OVER (PARTITION BY config, topic_id LIKE 'W%' ORDER BY topic_id) <= CASE WHEN topic_id LIKE 'W%' THEN 2 ELSE 3 END""")
def cases_load(spark, d):
    """Kept cases of two files, five of each, two of them of work."""
    topic = F.concat(F.when(F.col("item_id") % 3 == 0, "C").otherwise("W"), F.format_string("%03d", "item_id"))
    cases = read(spark, d, "benchmark").select("item_id", topic.alias("topic_id"), F.when(F.col("item_id") % 5 != 0, "KEPT").otherwise("DROP").alias("status"))
    paths = {name: scratch(spark, name) for name in ("com", "pal")}
    for k, path in enumerate(paths.values()):
        mail.write_jsonl(cases.where(F.col("item_id") % 2 == k), path)
    return mail.load_cases(spark, paths, "item_id long, topic_id string, status string", 5).select("config", "topic_id", "item_id")


@query("SELECT DISTINCT 'm' || doc_id AS message_id FROM labels WHERE doc_id % 3 <> 0")
def exclusion_scan(spark, d):
    """Lists of ids with notes and comments."""
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# m"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit(" m"), F.col("doc_id").cast("string"), F.lit("  # personal")))
    path = scratch(spark, "exclusions")
    read(spark, d, "labels").select(line).write.text(path)
    return mail.exclusions(spark, path)


@query("SELECT item_id, 'ada@x.example' AS sender, trim(text, ' ' || chr(10)) AS body FROM benchmark")
def maildir_scan(spark, d):
    """Raw mail files, one a passage, read up to the quoted part."""
    path = scratch(spark, "maildir")
    raw = F.concat(F.lit("From: ada@x.example\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text", F.lit("\n> quoted\nmore"))
    read(spark, d, "benchmark").select("item_id", raw.alias("value")).write.partitionBy("item_id").text(path)
    return mail.read_maildir(spark, path).select(F.regexp_extract("path", "item_id=(\\d+)", 1).cast("long").alias("item_id"), "sender", "body")
