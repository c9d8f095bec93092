"""Queries of threads, keys, samples and session ends, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailquarry.operators import measures as M
from mailquarry.plans.evaluation import _LOG, _log
from mailquarry.plans.search import _SPACE, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- views of threads: conv_id is the thread, turn the position

_TURNS = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def _turns(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


@query(f"""WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM t)
SELECT conv_id, array_to_string(list(role ORDER BY n), ',') AS first_from, max(CASE WHEN n = 1 THEN trim(substr({_SPACE.format("text")}, 1, 280), ' ') END) AS snippet FROM n WHERE n <= 3 GROUP BY conv_id""")
def compact_views(spark, d):
    """The first three speakers and the first 280 characters of the first message."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    first = _turns(spark, d).withColumn("n", n).where("n <= 3")
    snippet = F.trim(F.substring(F.regexp_replace("text", "[ \\t\\r\\n\\f]+", " "), 1, 280))
    g = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "role"))).alias("m"), F.max(F.when(F.col("n") == 1, snippet)).alias("snippet"))
    return g.select("conv_id", F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("first_from"), "snippet")


@query(f"""WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS back FROM t)
SELECT conv_id, turn, role, CASE WHEN back <= 2 THEN text ELSE substr(text, 1, 120) END AS shown FROM n""")
def readable_window(spark, d):
    """The last two messages of a thread in full, stubs of 120 characters before them."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")))
    shown = F.when(F.col("back") <= 2, F.col("text")).otherwise(F.substring("text", 1, 120))
    return _turns(spark, d).withColumn("back", back).select("conv_id", "turn", "role", shown.alias("shown"))


@query("""WITH a AS (SELECT DISTINCT conv_id FROM conversations JOIN benchmark ON conv_id * 8 + turn = item_id * 5)
SELECT conv_id, count(*) AS n_messages FROM conversations WHERE conv_id IN (SELECT conv_id FROM a) GROUP BY conv_id""")
def anchor_threads(spark, d):
    """The threads that hold an anchor message."""
    anchors = read(spark, d, "benchmark").select((F.col("item_id") * 5).alias("message"))
    c = read(spark, d, "conversations").select("conv_id", "turn")
    held = c.withColumn("message", F.col("conv_id") * 8 + F.col("turn")).join(anchors, "message", "left_semi").select("conv_id")
    return c.join(held, "conv_id", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS pos FROM conversations GROUP BY ALL)
SELECT conv_id, array_to_string(list(role ORDER BY role), ',') AS by_name, array_to_string(list(role ORDER BY pos, role), ',') AS by_place FROM f GROUP BY conv_id""")
def thread_participants(spark, d):
    """Distinct speakers, sorted and in the order in which they first speak; a speaker's messages are reduced before any list."""
    first = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    g = first.groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("names"), F.array_sort(F.collect_list(F.struct("at", "role"))).alias("m"))
    return g.select("conv_id", F.array_join("names", ",").alias("by_name"), F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("by_place"))


@query("""SELECT o_custkey, arg_min(CAST(o_orderdate AS VARCHAR)[:10], o_orderkey) AS date_first, arg_max(CAST(o_orderdate AS VARCHAR)[:10], o_orderkey) AS date_last,
min(CAST(o_orderdate AS VARCHAR)[:10]) AS thread_date FROM orders GROUP BY o_custkey""")
def thread_dates(spark, d):
    """First and last date by position, and the least date."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min_by(day, "o_orderkey").alias("date_first"), F.max_by(day, "o_orderkey").alias("date_last"), F.min(day).alias("thread_date"))


@query("""WITH m AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_orderdate AS VARCHAR)[:10] END AS day FROM orders)
SELECT o_custkey, o_orderkey, day, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS INT) AS place FROM m""")
def date_sorted(spark, d):
    """Messages of a set by date, those without one first, then in their own order."""
    day = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(""))
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("day")).withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")))


# ---- keys and lookups


@query("""WITH k AS (SELECT c_custkey, '{"segment": "' || c_mktsegment || '"}' AS answer FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey, coalesce(answer, '{}') AS answer FROM orders LEFT JOIN k ON o_custkey = c_custkey""")
def answer_key_rows(spark, d):
    """Evaluation rows with their key, an empty object where there is none."""
    key = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit('{"segment": "'), "c_mktsegment", F.lit('"}')).alias("answer"))
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(key, "o_custkey", "left").select("o_orderkey", F.coalesce("answer", F.lit("{}")).alias("answer"))


@query("SELECT l_orderkey, l_linenumber, p_name AS fact FROM (SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey]) AS atom FROM lineitem) JOIN part ON atom = p_partkey")
def clue_atoms(spark, d):
    """The facts that a clue carries."""
    carries = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array("l_partkey", "l_suppkey")).alias("p_partkey"))
    return carries.join(read(spark, d, "part").select("p_partkey", F.col("p_name").alias("fact")), "p_partkey").select("l_orderkey", "l_linenumber", "fact")


@query("""SELECT c_custkey, c_name AS label, split_part(c_name, '#', 1) AS first_name, coalesce(card, '') AS card FROM customer LEFT JOIN
(SELECT lower(n_name) AS file, 'from ' || r_name AS card, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 0) ON c_nationkey = n_nationkey""")
def persona_cards(spark, d):
    """People with first name and card, an empty one where none is on file."""
    region = read(spark, d, "region").where("r_regionkey <> 0").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    cards = read(spark, d, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("from "), "r_name").alias("card"))
    people = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(cards, "c_nationkey", "left")
    return people.select("c_custkey", F.col("c_name").alias("label"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"), F.coalesce("card", F.lit("")).alias("card"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN '{"control": true}' ELSE '{"secret": "' || quality || '"}' END AS answer FROM labels""")
def case_answer(spark, d):
    """A stub for a control, else the case's answer."""
    secret = F.concat(F.lit('{"secret": "'), F.col("quality").cast("string"), F.lit('"}'))
    return read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, '{"control": true}').otherwise(secret).alias("answer"))


@query("SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'KEPT' WHEN toxic = 1 THEN 'CHECK_FAIL' ELSE 'DROP' END AS status, count(*) AS n FROM labels GROUP BY ALL")
def discard_reasons(spark, d):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "KEPT").when(F.col("toxic") == 1, "CHECK_FAIL").otherwise("DROP")
    return read(spark, d, "labels").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT o_orderpriority AS mechanism, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL)
SELECT mechanism, n, CAST(row_number() OVER (ORDER BY n, mechanism) AS INT) AS turn FROM c""")
def minority_first(spark, d):
    """Distinct ids of each mechanism, and the order in which they get new ones: fewest first. One row a mechanism is ordered."""
    n = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("mechanism")).agg(F.countDistinct("o_custkey").alias("n"))
    return n.withColumn("turn", F.row_number().over(Window.orderBy("n", "mechanism")))


@query("""WITH c AS (SELECT item_id AS topic, false AS control FROM benchmark UNION ALL SELECT item_id, true FROM benchmark WHERE length(text) > 200)
SELECT topic, control, noise, 'n' || noise || '-' || CASE WHEN control THEN 'C' ELSE 'W' END || topic AS sample FROM c, (SELECT unnest([0, 200, 1000]) AS noise)""")
def build_samples(spark, d):
    """A sample for each setting of each case and control."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("topic"), F.length("text").alias("n"))
    every = items.select("topic", F.lit(False).alias("control")).union(items.where("n > 200").select("topic", F.lit(True).alias("control")))
    each = every.withColumn("noise", F.explode(F.array(F.lit(0), F.lit(200), F.lit(1000))))
    return each.withColumn("sample", F.concat(F.lit("n"), F.col("noise").cast("string"), F.lit("-"), F.when(F.col("control"), "C").otherwise("W"), F.col("topic").cast("string")))


# ---- texts


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'order ' || o_orderkey ELSE concat_ws(' ', CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, o_orderstatus) END AS asked FROM orders""")
def secret_query(spark, d):
    """What is said of the secret, the anchor's own text where nothing is."""
    said = F.concat_ws(" ", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    anchor = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif(said, F.lit("")), anchor).alias("asked"))


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS digest, concat_ws(' | ', 'd' || doc_id, substr(source, 1, 60), substr({_SPACE.format('text')}, 1, 150)) AS note FROM documents")
def content_digest(spark, d):
    """The digest of each text and a one-line note of it."""
    note = F.concat_ws(" | ", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.substring("source", 1, 60), F.substring(F.regexp_replace("text", "[ \\t\\r\\n\\f]+", " "), 1, 150))
    return read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), note.alias("note"))


# ---- ends of sessions


@query(f"""WITH {_LOG} SELECT user_id, count(*) FILTER (tool <> 'SEGMENT') AS turns, count(DISTINCT CASE WHEN tool = 'SEGMENT' THEN k END) AS segments,
count(*) FILTER (tool <> 'SEGMENT') >= 30 + count(DISTINCT CASE WHEN tool = 'SEGMENT' THEN k END) + 8 AS forced_empty FROM log GROUP BY user_id""")
def turn_limit(spark, d):
    """A session whose turns reach the budget, its segments and 8 more ends without an answer."""
    turns, segments = F.count(F.when(F.col("tool") != "SEGMENT", 1)), F.countDistinct(F.when(F.col("tool") == "SEGMENT", F.col("k")))
    g = _log(spark, d).groupBy("user_id").agg(turns.alias("turns"), segments.alias("segments"))
    return g.withColumn("forced_empty", F.col("turns") >= 30 + F.col("segments") + 8)


@query(f"""WITH {_LOG} SELECT user_id, count(*) FILTER (tool = 'ANSWER') AS attempts, arg_max(k, event_id) FILTER (tool = 'ANSWER') AS kept FROM log GROUP BY user_id""")
def terminal_state(spark, d):
    """However often a session answers, its last attempt is the one kept."""
    answer = F.col("tool") == "ANSWER"
    return _log(spark, d).groupBy("user_id").agg(F.count(F.when(answer, 1)).alias("attempts"), F.max_by("k", F.when(answer, F.col("event_id"))).alias("kept"))


@query(None)
def pca_two(spark, d):
    """The two directions of most variance, each with its largest weight positive, of all vectors."""
    return M.principal(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 2)
