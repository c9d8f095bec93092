"""Queries of validation, sessions, scores, reports and statistics, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import measures as M
from mailquarry.operators import rules as U
from mailquarry.plans.search import _ASCII, _STOP, read, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- validation

_VOTES = "SELECT l_orderkey AS k, l_linenumber AS subset, count(*) AS probers, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS votes FROM lineitem GROUP BY ALL"


@query(f"SELECT k, count(*) AS subsets, CAST(sum(CASE WHEN votes >= probers // 2 + 1 THEN 1 ELSE 0 END) AS BIGINT) AS leaks, max(CASE WHEN votes >= probers // 2 + 1 THEN 1 ELSE 0 END) = 0 AS ok FROM ({_VOTES}) GROUP BY k")
def and_gate_quorum(spark, d):
    votes = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("subset")).agg(F.count(F.lit(1)).alias("probers"), F.sum((F.col("l_discount") > 0.05).cast("int")).alias("votes"))
    leaked = (F.col("votes") >= F.floor(F.col("probers") / 2) + 1).cast("int")
    return votes.groupBy("k").agg(F.count(F.lit(1)).alias("subsets"), F.sum(leaked).alias("leaks"), (F.max(leaked) == 0).alias("ok"))


@query("""WITH p AS (SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS plan FROM lineitem GROUP BY ALL), c AS (SELECT l_orderkey AS k, list_sort(list(l_linenumber)) AS got FROM lineitem WHERE l_quantity > 5 GROUP BY ALL)
SELECT k, CASE WHEN got IS NULL THEN 'no clue' WHEN got <> plan THEN 'atoms differ' ELSE '' END AS violation FROM p LEFT JOIN c USING (k)""")
def plan_conformance(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    both = lines.groupBy("k").agg(F.array_sort(F.collect_list("l_linenumber")).alias("plan"), F.array_sort(F.collect_list(F.when(F.col("l_quantity") > 5, F.col("l_linenumber")))).alias("got"))
    return both.select("k", F.when(F.size("got") == 0, "no clue").when(F.col("got") != F.col("plan"), "atoms differ").otherwise("").alias("violation"))


# ---- sessions: user_id is the session, event_id its step; view reads, click searches, signup lists, purchase answers

_TOOL = "CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'SEARCH' WHEN 'signup' THEN 'LIST' WHEN 'purchase' THEN 'ANSWER' ELSE 'SEGMENT' END"


def _log(spark, d):
    tool = F.when(F.col("event_type") == "view", "READ").when(F.col("event_type") == "click", "SEARCH").when(F.col("event_type") == "signup", "LIST").when(F.col("event_type") == "purchase", "ANSWER").otherwise("SEGMENT")
    return read(spark, d, "events").select("user_id", "event_id", tool.alias("tool"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


_LOG = f"log AS (SELECT user_id, event_id, {_TOOL} AS tool, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events)"


@query(f"""WITH {_LOG} SELECT user_id, count(*) AS n_tool_calls, count(*) FILTER (tool = 'READ') AS reads, count(*) FILTER (tool = 'SEARCH') AS searches,
count(DISTINCT CASE WHEN tool = 'READ' THEN k END) AS opened, count(k) FILTER (tool = 'READ') - count(DISTINCT CASE WHEN tool = 'READ' THEN k END) AS redundant FROM log GROUP BY user_id""")
def trajectory_metrics(spark, d):
    k = F.when(F.col("tool") == "READ", F.col("k"))
    return _log(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_tool_calls"), F.count_if(F.col("tool") == "READ").alias("reads"), F.count_if(F.col("tool") == "SEARCH").alias("searches"), F.countDistinct(k).alias("opened"), (F.count(k) - F.countDistinct(k)).alias("redundant"))


@query(f"""WITH {_LOG}, r AS (SELECT *, sum(CASE WHEN tool IN ('LIST', 'SEARCH', 'READ') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM log)
SELECT user_id, event_id, CAST(used AS BIGINT) AS used, used >= 40 AS exhausted FROM r""")
def running_budget(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.col("tool").isin("LIST", "SEARCH", "READ").cast("int")).over(w)
    return _log(spark, d).select("user_id", "event_id", used.alias("used"), (used >= 40).alias("exhausted"))


@query(f"""WITH {_LOG}, r AS (SELECT *, lag(tool) OVER w AS last, lag(k) OVER w AS hits FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, coalesce(last = 'SEARCH' AND hits > 0, false) AS unread FROM r WHERE tool = 'ANSWER'""")
def unread_search_gate(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    log = _log(spark, d).withColumn("last", F.lag("tool").over(w)).withColumn("hits", F.lag("k").over(w)).where("tool = 'ANSWER'")
    return log.select("user_id", "event_id", F.coalesce((F.col("last") == "SEARCH") & (F.col("hits") > 0), F.lit(False)).alias("unread"))


@query(f"WITH {_LOG} SELECT user_id, 10 - count(DISTINCT CASE WHEN tool = 'SEGMENT' THEN k % 10 END) AS left_over FROM log GROUP BY user_id")
def coverage_remaining(spark, d):
    return _log(spark, d).groupBy("user_id").agg((10 - F.countDistinct(F.when(F.col("tool") == "SEGMENT", F.col("k") % 10))).alias("left_over"))


@query(f"""WITH {_LOG}, w AS (SELECT *, sum(CASE WHEN tool IN ('LIST', 'SEARCH', 'READ') THEN 1 ELSE 0 END) OVER p AS used, sum(CASE WHEN tool = 'READ' THEN 1 ELSE 0 END) OVER p + count(DISTINCT CASE WHEN tool = 'SEARCH' THEN k END) OVER p AS credit,
lag(tool) OVER q AS last, lag(k) OVER q AS hits FROM log WINDOW q AS (PARTITION BY user_id ORDER BY event_id), p AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CASE WHEN used < 40 AND credit < 3 THEN 'investigate' WHEN used < 40 AND coalesce(last = 'SEARCH' AND hits > 0, false) THEN 'unread' WHEN value < 5 THEN 'scan' ELSE 'accepted' END AS verdict FROM w WHERE tool = 'ANSWER'""")
def answer_gate(spark, d):
    """When an answer is taken; a search's only word is its number."""
    q = Window.partitionBy("user_id").orderBy("event_id")
    p = q.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = _log(spark, d).withColumn("used", F.sum(F.col("tool").isin("LIST", "SEARCH", "READ").cast("int")).over(p)).withColumn("last", F.lag("tool").over(q)).withColumn("hits", F.lag("k").over(q))
    log = U.with_credit(log, "user_id", "event_id", "tool", F.when(F.col("k").isNotNull(), F.array(F.col("k").cast("string"))))
    verdict = F.coalesce(U.too_early(F.col("used"), 40, F.col("credit"), 3, F.col("last"), F.col("hits")), F.when(F.col("value") < 5, "scan"), F.lit("accepted"))
    return log.where("tool = 'ANSWER'").select("user_id", "event_id", verdict.alias("verdict"))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS toks FROM conversations),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS reads, []::VARCHAR[][] AS kept FROM t
UNION ALL SELECT f.conv_id, t.k, reads + (role = 'assistant')::INT, CASE WHEN role = 'user' AND len(toks) > 0 AND len(list_filter(kept, lambda o: len(list_intersect(o, toks))::DOUBLE / (len(o) + len(toks) - len(list_intersect(o, toks))) >= 0.8)) = 0 THEN list_append(kept, toks) ELSE kept END FROM f JOIN t ON f.conv_id = t.conv_id AND t.k = f.k + 1)
SELECT conv_id, CAST(reads + len(kept) AS INT) AS credit FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1""")
def greedy_credit(spark, d):
    """Credit of dialogues as sessions: a user's turn is a search for it, an assistant's a read."""
    tool = F.when(F.col("role") == "user", "SEARCH").when(F.col("role") == "assistant", "READ")
    log = read(spark, d, "conversations").select("conv_id", "turn", tool.alias("tool"), T.query_tokens("text").alias("toks"))
    return U.with_credit(log, "conv_id", "turn", "tool", F.col("toks")).groupBy("conv_id").agg(F.max_by("credit", "turn").alias("credit"))


# ---- scores

_CITED = "SELECT l_orderkey AS key, CASE WHEN l_linenumber % 4 > 0 THEN l_suppkey % 7 END AS thread FROM lineitem"
_WANTED = "SELECT o_orderkey AS key, unnest([o_custkey % 7, (o_custkey + 3) % 7]) AS thread FROM orders"


@query(f"""WITH c AS (SELECT DISTINCT * FROM ({_CITED}) WHERE thread IS NOT NULL), w AS (SELECT DISTINCT * FROM ({_WANTED})),
h AS (SELECT key, count(*) AS hits FROM c JOIN w USING (key, thread) GROUP BY key), n AS (SELECT key, count(*) AS n FROM c GROUP BY key), m AS (SELECT key, count(*) AS need FROM w GROUP BY key),
k AS (SELECT key FROM ({_CITED}) UNION SELECT key FROM ({_WANTED}))
SELECT key, CASE WHEN n > 0 THEN round_even(coalesce(hits, 0) / n, 3) ELSE 0.0 END AS precision, CASE WHEN n > 0 THEN round_even(coalesce(hits, 0) / greatest(need, 1), 3) ELSE 0.0 END AS recall
FROM k LEFT JOIN n USING (key) LEFT JOIN h USING (key) LEFT JOIN m USING (key)""")
def evidence_pr_thread(spark, d):
    cited = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_suppkey") % 7).alias("thread"))
    wanted = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.explode(F.array(F.col("o_custkey") % 7, (F.col("o_custkey") + 3) % 7)).alias("thread"))
    return M.thread_evidence(cited, wanted)


@query("""WITH c AS (SELECT l_orderkey AS key, l_suppkey % 7 AS message FROM lineitem), w AS (SELECT o_orderkey AS key, unnest([o_custkey % 7, o_custkey % 7 + 7]) AS message, o_custkey % 3 AS clue FROM orders),
n AS (SELECT key, count(DISTINCT clue) AS need FROM w GROUP BY key), e AS (SELECT c.key, count(*) AS n, count(w.clue) AS valid, count(DISTINCT clue) AS clues FROM c LEFT JOIN w ON c.key = w.key AND c.message = w.message GROUP BY c.key)
SELECT key, round(valid / n, 6) AS precision, round(clues / greatest(coalesce(need, 0), 1), 6) AS recall FROM e LEFT JOIN n USING (key)""")
def evidence_pr_message(spark, d):
    cited = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_suppkey") % 7).alias("message"))
    wanted = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.explode(F.array(F.col("o_custkey") % 7, F.col("o_custkey") % 7 + 7)).alias("message"), (F.col("o_custkey") % 3).alias("clue"))
    return M.message_evidence(cited, wanted).select("key", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT l_orderkey, l_linenumber, round_even(CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * round(l_discount, 3) * round(l_tax, 3), 3) AS final FROM lineitem")
def product_gate_score(spark, d):
    final = M.product_gate(F.col("l_returnflag") != "N", F.col("l_linestatus") == "F", F.round("l_discount", 3), F.round("l_tax", 3))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", final.alias("final"))


@query("""WITH r AS (SELECT l_orderkey AS k, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS first FROM lineitem GROUP BY l_orderkey)
SELECT k, CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END AS hit, CASE WHEN first = 1 THEN 1 ELSE 0 END AS top1, coalesce(round(1.0::DOUBLE / first, 3), 0.0) AS mrr FROM r""")
def ranked_hit_mrr(spark, d):
    r = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("first"))
    return r.select("k", F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("top1"), F.coalesce(F.round(1 / F.col("first"), 3), F.lit(0.0)).alias("mrr"))


@query("SELECT o_orderpriority AS config, count(*) AS controls, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS fp_rate FROM orders WHERE o_custkey % 10 = 0 GROUP BY ALL")
def control_fp_rate(spark, d):
    return read(spark, d, "orders").where("o_custkey % 10 = 0").groupBy(F.col("o_orderpriority").alias("config")).agg(F.count(F.lit(1)).alias("controls"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("fp_rate"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS found, CASE WHEN o_orderstatus = 'F' THEN c_mktsegment END AS verdict FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def deferred_judge(spark, d):
    found = F.col("o_orderstatus") == "F"
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return read(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", found.alias("found"), F.when(found, F.col("c_mktsegment")).alias("verdict"))


# ---- reports: config is return flag x line status, noise a quantity bucket

_ROWS = "SELECT l_returnflag || l_linestatus AS config, CAST(floor(l_quantity / 10) AS INT) AS noise, l_discount AS final, l_tax AS match, l_linenumber AS n, l_suppkey FROM lineitem"


def _rows(spark, d):
    return read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("config"), F.floor(F.col("l_quantity") / 10).cast("int").alias("noise"), F.col("l_discount").alias("final"), F.col("l_tax").alias("match"), F.col("l_linenumber").alias("n"), "l_suppkey")


@query(f"SELECT config, noise, count(*) AS n_cells, round(avg(final), 6) AS final, round(avg(match), 6) AS match FROM ({_ROWS}) GROUP BY ALL")
def summary_by_cell(spark, d):
    return _rows(spark, d).groupBy("config", "noise").agg(F.count(F.lit(1)).alias("n_cells"), M.safe_mean("final").alias("final"), M.safe_mean("match").alias("match"))


@query(f"SELECT config, noise, round(avg(final), 6) AS mean, round(CASE WHEN count(final) > 1 THEN stddev_pop(final) / sqrt(count(final)) ELSE 0 END, 6) AS sem FROM ({_ROWS}) GROUP BY ALL")
def cell_sem(spark, d):
    return _rows(spark, d).groupBy("config", "noise").agg(F.round(F.avg("final"), 6).alias("mean"), F.round(M.sem("final"), 6).alias("sem"))


@query(f"SELECT config, noise, round(avg(final), 6) AS final, count(*) AS n FROM ({_ROWS}) GROUP BY ROLLUP (config, noise)")
def mechanism_rollup(spark, d):
    return _rows(spark, d).rollup("config", "noise").agg(F.round(F.avg("final"), 6).alias("final"), F.count(F.lit(1)).alias("n"))


@query("SELECT config, noise, " + ", ".join(f"round(100.0 * count(*) FILTER (n = {k}) / count(*), 6) AS s{k}" for k in range(1, 6)) + f" FROM ({_ROWS}) GROUP BY ALL")
def score_composition_pivot(spark, d):
    p = _rows(spark, d).groupBy("config", "noise").pivot("n", [1, 2, 3, 4, 5, 6, 7]).count().na.fill(0)
    total = sum((F.col(str(k)) for k in range(1, 8)), F.lit(0))
    return p.select("config", "noise", *[F.round(100.0 * F.col(str(k)) / total, 6).alias(f"s{k}") for k in range(1, 6)])


@query(f"SELECT config, round(avg(final), 6) AS recovered, round(avg(match) - avg(final), 6) AS weak, round(0.5 - avg(match), 6) AS wrong, 0.5 AS none FROM ({_ROWS}) GROUP BY config")
def score_breakdown(spark, d):
    return _rows(spark, d).groupBy("config").agg(F.round(F.avg("final"), 6).alias("recovered"), F.round(F.avg("match") - F.avg("final"), 6).alias("weak"), F.round(0.5 - F.avg("match"), 6).alias("wrong"), F.lit(0.5).alias("none"))


@query("SELECT event_type AS model, count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY ROLLUP (event_type)")
def usage_rollup(spark, d):
    return read(spark, d, "events").rollup(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("props")).alias("tokens"), F.round(F.sum("value"), 4).alias("cost"))


# ---- statistics


def _n(p: str) -> str:
    return f"len(regexp_extract_all(s, '{p}'))::DOUBLE"


_STYLE_SQL = {
    "log_chars": "ln(1 + length(s))", "log_words": "ln(1 + n)", "word_chars": "CASE WHEN n > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / n ELSE 0 END", "lines": _n("\\n") + " + 1",
    "line_chars": f"length(s) / ({_n(chr(92) + 'n')} + 1)", "punctuation": _n("[^A-Za-z0-9 \\t\\r\\n\\f]") + " / greatest(length(s), 1)", "digits": _n("[0-9]") + " / greatest(length(s), 1)",
    "capitals": _n("[A-Z]") + " / greatest(" + _n("[A-Za-z]") + ", 1)", "commas": _n(",") + " / greatest(n, 1)", "enders": "greatest(" + _n("[.!?]+") + ", 1) / greatest(n, 1)",
    "caps_words": "len(list_filter(regexp_extract_all(s, '[A-Za-z]{2,}'), lambda x: x = upper(x)))::DOUBLE / greatest(n, 1)", "function_words": f"len(list_filter(w, lambda x: x IN ({_STOP})))::DOUBLE / greatest(n, 1)",
    "header": "CASE WHEN regexp_matches(s, 'Forwarded by|-----|Original Message|@ECT|cc:') THEN 1.0 ELSE 0.0 END", "sentence_words": "n / greatest(" + _n("[.!?]+") + ", 1)", "types": "len(list_distinct(w))::DOUBLE / greatest(n, 1)",
}


@query(f"WITH a AS (SELECT doc_id, {_ASCII} AS s FROM documents), b AS (SELECT doc_id, s, regexp_extract_all(lower(s), '[a-z0-9]{{2,}}') AS w FROM a), c AS (SELECT *, len(w)::DOUBLE AS n FROM b) SELECT doc_id, "
       + ", ".join(f"round({v}, 6) AS {k}" for k, v in _STYLE_SQL.items()) + " FROM c")
def stylometrics(spark, d):
    docs = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F]", "x").alias("s"))
    return T.stylometrics(docs, "s").select("doc_id", *[F.round(c, 6).alias(c) for c in T.STYLE])


@query("WITH m AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) + 1e-9 AS s FROM documents) SELECT doc_id, round((n_chars - m) / s, 6) AS z FROM documents, m")
def zscore_real(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return docs.crossJoin(F.broadcast(docs.agg(F.avg("n_chars").alias("m"), (F.stddev_pop("n_chars") + 1e-9).alias("s")))).select("doc_id", F.round((F.col("n_chars") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("""WITH p AS (SELECT q.vec_id AS qid, r.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS distance FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT qid, id, round(distance, 5) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) = 1""")
def knn_distance(spark, d):
    """Queries: the rows whose id 50 divides, against all."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return M.nearest(rows.where("id % 50 = 0").withColumnRenamed("id", "qid"), rows).select("qid", "id", F.round("distance", 5).alias("distance"))


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS s, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS p FROM lineitem), m AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY s) + (count(*) OVER (PARTITION BY l_returnflag, s) - 1) / 2.0::DOUBLE AS mid FROM r)
SELECT l_returnflag, round((sum(mid * p) - sum(p) * (sum(p) + 1) / 2.0::DOUBLE) / (sum(p)::DOUBLE * sum(1 - p)), 6) AS auc FROM m GROUP BY ALL""")
def auc_midrank(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("s"), (F.col("l_linestatus") == "F").cast("int").alias("p"))
    return M.auc(rows, "s", "p", ["l_returnflag"]).select("l_returnflag", F.round("auc", 6).alias("auc"))


@query("SELECT lang, round(median(n_chars), 6) AS median FROM documents GROUP BY lang")
def median_exact(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.round(F.median("n_chars"), 6).alias("median"))
