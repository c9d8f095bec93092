"""Queries of parsing, assembly, banks, exports and the model seam, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailquarry.functions import parse as P
from mailquarry.functions import text as T
from mailquarry.functions import udf as U
from mailquarry.operators import assembly as A
from mailquarry.operators import models
from mailquarry.operators import records as R
from mailquarry.plans.evaluation import _LOG, _ROWS, _log, _rows
from mailquarry.plans.search import ORACLE_SQL as _SEARCH
from mailquarry.plans.search import planted, planted_sql, read
from mailquarry.plans.sources import scratch
from mailquarry.sources import mail
from mailquarry.streaming import sessions

ORACLE_PROSE = _SEARCH["clean_prose_filter"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(None)
def ascii_wrap(spark, d):
    return read(spark, d, "documents").select("doc_id", U.ascii_wrap("text").alias("wrapped"))


_FOLDED = "text"
for _a, _b in U.PUNCTUATION.items():
    _FOLDED = f"replace({_FOLDED}, chr({ord(_a)}), '{_b.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT doc_id, regexp_replace(strip_accents({_FOLDED.replace('text', 'said')}), '[^\\x00-\\x7F]', '', 'g') AS folded FROM (SELECT doc_id, chr(8212) || replace(replace(text, '. ', chr(8230) || chr(160) || chr(8226)), 'e ', 'e' || chr(8217) || chr(8203)) AS said FROM documents)")
def ascii_fold(spark, d):
    """Whole texts with typographic marks planted in them."""
    said = F.concat(F.lit("\u2014"), F.replace(F.replace("text", F.lit(". "), F.lit("\u2026\u00a0\u2022")), F.lit("e "), F.lit("e\u2019\u200b")))
    return read(spark, d, "documents").select("doc_id", U.to_ascii(said).alias("folded"))


@query("""SELECT doc_id, '{"doc_id": ' || doc_id || ', "source": "' || source || '"}' AS found FROM documents""")
def json_in_prose(spark, d):
    """The object in whole texts, behind braces that are none."""
    said = F.concat("text", F.lit(" {not json} {"), F.to_json(F.struct("source", "doc_id")), F.lit(" and {more}"))
    return read(spark, d, "documents").select("doc_id", U.extract_json(said).alias("found"))


_QUOTED = f"CAST(coalesce(nullif(list_position(list_transform(a, lambda x: regexp_matches(x, '^\\s*(?:{T.QUOTE_MARKS})', 'i')), true), 0), len(a) + 1) AS INT)"


@query(f"""WITH l AS (SELECT doc_id, string_split(' ' || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)) AS a FROM documents), k AS (SELECT doc_id, array_to_string(a[:{_QUOTED} - 1], chr(10)) AS s FROM l)
SELECT doc_id, CASE WHEN regexp_matches(s, '[^ \\t\\n]') THEN regexp_replace(regexp_replace(s, '^(?:[ \\t]*\\n)+', ''), '(?:\\n[ \\t]*)+$', '') ELSE '' END AS body FROM k""")
def header_skip(spark, d):
    """Mails of whole texts, a sentence a line, without header and quoted part."""
    said = F.concat(F.lit("From: ada@x.example\nTo: bo@x.example\n\n \n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")), F.lit("\n\n> quoted\nmore"))
    return read(spark, d, "documents").select("doc_id", F.array_join(T.mail_lines(said), "\n").alias("body"))


_FOUND = "CASE WHEN doc_id % 4 IN ({}) THEN doc_id END"


@query(f"""SELECT doc_id, {_FOUND.format('1, 2, 3')} AS first_balanced, {_FOUND.format('0, 1, 2, 3')} AS first_list, {_FOUND.format('1, 3')} AS fenced, {_FOUND.format('0, 1, 2')} AS quoted, {_FOUND.format('1, 2')} AS braced FROM documents""")
def json_variants(spark, d):
    """What each rule finds in whole texts: behind braces that are none, in a fence, before other braces, with escaped quotes."""
    k, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    plain = F.to_json(F.struct("doc_id", "source"))
    odd = F.to_json(F.struct("doc_id", F.lit("a } b").alias("t")))
    said = F.when(k == 0, F.concat(text, F.lit(" {not json} "), odd)).when(k == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct("doc_id", text.alias("text"))), F.lit("\n```")))
    said = said.when(k == 2, F.concat(text, plain, F.lit(" and {more}"))).otherwise(F.concat(text, F.to_json(F.struct("doc_id", F.lit('say "{').alias("t")))))
    said = F.concat(said, F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))
    rules = {"first_balanced": U.balanced_json, "fenced": U.fenced_json, "quoted": U.counted_json, "braced": lambda x: U.counted_json(x, False)}
    told = {name: F.get_json_object(U.json_by(rule)("said"), "$.doc_id").cast("long") for name, rule in rules.items()}
    listed = F.get_json_object(U.json_by(lambda x: U.balanced_json(x, "["))("said"), "$[0]").cast("long")
    return read(spark, d, "documents").select("doc_id", said.alias("said")).select("doc_id", listed.alias("first_list"), *[c.alias(name) for name, c in told.items()])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'READ' WHEN 1 THEN 'ANSWER' WHEN 2 THEN 'READ' END AS tool,
CASE doc_id % 4 WHEN 0 THEN 'e' || doc_id WHEN 1 THEN trim('{"found": true} ' || text, ' ') WHEN 2 THEN 'e5' END AS arg FROM documents""")
def parse_step(spark, d):
    """Steps whose thoughts are whole texts."""
    k, text = F.col("doc_id") % 4, F.col("text")
    said = F.when(k == 0, F.concat(F.lit("THOUGHT: "), text, F.lit("\nACTION: READ e"), F.col("doc_id").cast("string"), F.lit(" \nmore"))).when(k == 1, F.concat(F.lit('ACTION: ANSWER {"found": true} '), text))
    said = said.when(k == 2, F.concat(text, F.lit("\nACTION: ANSWER READ e5"))).otherwise(text)
    tool, arg = P.step("said")
    return read(spark, d, "documents").select("doc_id", said.alias("said")).select("doc_id", tool.alias("tool"), arg.alias("arg"))


@query("SELECT doc_id, doc_id % 2 = 0 AS found, CASE WHEN doc_id % 3 = 0 THEN trim(text, ' ') ELSE '' END AS secret, '<a@b>,<c@d>' AS ids FROM documents")
def parse_solve(spark, d):
    """Answers of whole texts, as JSON or in prose."""
    yes, text = F.col("doc_id") % 2 == 0, F.col("text")
    good = F.to_json(F.struct(yes.alias("found"), text.alias("secret"), F.array(F.lit("<a@b>"), F.lit("<c@d>"), F.lit("<a@b>")).alias("evidence_email_ids")))
    prose = F.concat(text, F.lit(" Found: "), yes.cast("string"), F.lit(" by <a@b> and <c@d>, <a@b>"))
    said = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, good).otherwise(prose).alias("raw")).withColumn("json", P.whole_object("raw"))
    return said.select("doc_id", *P.solution(F.col("json"), F.col("raw"))).select("doc_id", "found", "secret", F.array_join("evidence_ids", ",").alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(text, chr(10) || ' ') ELSE 'kept' END AS said FROM documents")
def clean_output(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think>hm</think>\n"), F.trim(F.col("text"), F.lit("\n ")))).otherwise(F.lit("kept<think>open"))
    return read(spark, d, "documents").select("doc_id", T.output_after(raw, "</think>", "<think>").alias("said"))


@query("SELECT user_id, CAST(hash_pick AS VARCHAR) AS pick, count(*) AS n FROM (SELECT user_id, CAST(('0x' || substr(sha256('9:' || event_id), 1, 7))::INT % 5 AS INT) AS hash_pick FROM events) GROUP BY ALL")
def hash_pick(spark, d):
    pick = F.conv(F.substring(R.hash_order(F.col("event_id"), 9), 1, 7), 16, 10).cast("int") % 5
    return read(spark, d, "events").groupBy("user_id", pick.cast("string").alias("pick")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT doc_id, sha256('5:' || doc_id) AS h FROM documents), c AS (SELECT DISTINCT item_id AS "case", item_id * 3 AS thread FROM benchmark),
t AS (SELECT item_id AS "case", unnest([item_id, item_id + 1, item_id * 2]) AS thread FROM benchmark),
k AS (SELECT "case", doc_id AS thread, row_number() OVER (PARTITION BY "case" ORDER BY h, doc_id) AS n FROM c, p
 WHERE NOT EXISTS (SELECT 1 FROM t WHERE t."case" = c."case" AND t.thread = doc_id) AND NOT EXISTS (SELECT 1 FROM c c2 WHERE c2."case" = c."case" AND c2.thread = doc_id)),
b AS (SELECT "case", thread, true AS clue FROM c UNION ALL SELECT "case", thread, false FROM k WHERE n <= 50)
SELECT "case", thread, clue, CAST(row_number() OVER (PARTITION BY "case" ORDER BY sha256('5:' || "case" || ':' || thread), thread) AS INT) AS place FROM b""")
def haystack_build(spark, d):
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("case"))
    clues = items.withColumn("thread", F.col("case") * 3)
    near = items.select("case", F.explode(F.array(F.col("case"), F.col("case") + 1, F.col("case") * 2)).alias("thread"))
    return A.haystacks(clues, read(spark, d, "documents").select(F.col("doc_id").alias("thread")), near, 50, 5)


@query(f"WITH {_LOG}, s AS (SELECT user_id, list(DISTINCT k % 10) AS seen FROM log WHERE tool = 'SEGMENT' GROUP BY user_id) SELECT user_id AS session, (SELECT min(x) FROM (SELECT unnest(range(10)) AS x) WHERE NOT list_contains(seen, x) AND x >= 4) AS a, (SELECT min(x) FROM (SELECT unnest(range(10)) AS x) WHERE NOT list_contains(seen, x)) AS b FROM s")
def next_segment(spark, d):
    seen = _log(spark, d).where("tool = 'SEGMENT'").groupBy(F.col("user_id").alias("session")).agg(F.collect_set(F.col("k") % 10).alias("segments"))
    ahead = A.next_segment(seen.withColumn("cursor", F.lit(4)), 10)
    first = A.next_segment(seen.withColumn("cursor", F.lit(0)), 10)
    both = ahead.withColumnRenamed("segment", "n").join(first.withColumnRenamed("segment", "b"), "session")
    return both.select("session", F.when(F.col("n") >= 4, F.col("n")).cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("""WITH m AS (SELECT n, unnest(range(1, (1 << n) - 1)) AS mask FROM (SELECT unnest([2, 3]) AS n)), c AS (SELECT item_id, 2 + item_id % 2 AS n FROM benchmark)
SELECT item_id, c.n, CAST(mask AS INT) AS mask, '' AS verdict FROM c JOIN m ON c.n = m.n""")
def audit_packet(spark, d):
    c = read(spark, d, "benchmark").select("item_id", (2 + F.col("item_id") % 2).cast("int").alias("n"))
    masks = F.when(F.col("n") == 2, R.proper_subsets(2)).otherwise(R.proper_subsets(3))
    return c.select("item_id", "n", F.explode(masks).alias("mask")).withColumn("verdict", F.lit(""))


@query("SELECT 'T' || printf('%02d', row_number() OVER (ORDER BY doc_id)) AS id, doc_id, CASE WHEN toxic = 1 THEN 'work' ELSE 'casual' END AS register FROM labels WHERE quality = 1")
def promote_candidates(spark, d):
    kept = read(spark, d, "labels").where("quality is null or quality = 1")
    b = kept.withColumn("b", F.floor(F.col("doc_id") / 65536))
    base = b.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("base"))
    n = F.row_number().over(Window.partitionBy("b").orderBy("doc_id")) + F.col("base")
    return b.join(base, "b").select(F.concat(F.lit("T"), F.format_string("%02d", n)).alias("id"), "doc_id", F.when(F.col("toxic") == 1, "work").otherwise("casual").alias("register"))


@query("SELECT l_orderkey, count(*) AS checks, count(*) FILTER (l_returnflag = 'R') = 0 AS passed FROM lineitem GROUP BY ALL")
def verdict_gate(spark, d):
    v = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "WEAK").otherwise("PASS")
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(v).alias("v"))
    return g.select("l_orderkey", F.size("v").cast("long").alias("checks"), ((F.size("v") > 0) & ~F.exists("v", lambda x: x == "FAIL")).alias("passed"))


@query("SELECT o_orderkey, CASE WHEN lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') THEN lower(trim(o_orderpriority)) ELSE 'regenerate' END AS decision FROM orders")
def decision_normaliser(spark, d):
    v = F.lower(F.trim("o_orderpriority"))
    return read(spark, d, "orders").select("o_orderkey", F.when(v.isin("1-urgent", "2-high"), v).otherwise("regenerate").alias("decision"))


@query("SELECT conv_id, string_agg('From: ' || role || chr(10) || 'Turn: ' || turn || chr(10) || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY turn) AS pile FROM conversations GROUP BY conv_id")
def render_messages(spark, d):
    one = F.concat_ws("\n", F.concat(F.lit("From: "), "role"), F.concat(F.lit("Turn: "), F.col("turn").cast("string")), F.lit(""), "text")
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))).alias("m"))
    return c.select("conv_id", F.array_join(F.transform("m", lambda m: m["x"]), "\n---\n").alias("pile"))


@query(f"SELECT noise, round(avg(final), 6) AS mean FROM ({_ROWS}) GROUP BY noise")
def noise_curve(spark, d):
    return _rows(spark, d).groupBy("noise").agg(F.round(F.avg("final"), 6).alias("mean"))


@query(f"SELECT config, count(*) >= 2 AND sum(CASE WHEN final > 0.09 THEN 1 ELSE 0 END) >= 1 AS smoke_ok FROM ({_ROWS}) GROUP BY config")
def smoke_gate(spark, d):
    return _rows(spark, d).groupBy("config").agg(((F.count(F.lit(1)) >= 2) & (F.sum((F.col("final") > 0.09).cast("int")) >= 1)).alias("smoke_ok"))


@query(f"""WITH r AS (SELECT config, count(*) AS total, count(CASE WHEN n < 7 THEN 1 END) AS completed, round(avg(final), 6) AS final FROM ({_ROWS}) GROUP BY config)
SELECT *, completed = total AS valid FROM r""")
def release_table(spark, d):
    r = _rows(spark, d).groupBy("config").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("n") < 7, 1)).alias("completed"), F.round(F.avg("final"), 6).alias("final"))
    return r.withColumn("valid", F.col("completed") == F.col("total"))


@query("SELECT lang || '-' || (CASE WHEN doc_id % 2 = 0 THEN 'W' ELSE 'C' END || doc_id) AS id, lang AS config, CASE WHEN doc_id % 2 = 0 THEN 'W' ELSE 'C' END || doc_id AS topic_id, CASE WHEN doc_id % 2 = 0 THEN 'work' ELSE 'casual' END AS register, n_chars FROM documents")
def export_dataset(spark, d):
    topic = F.concat(F.when(F.col("doc_id") % 2 == 0, "W").otherwise("C"), F.col("doc_id").cast("string"))
    return mail.dataset(read(spark, d, "documents").select(F.col("lang").alias("config"), topic.alias("topic_id"), "n_chars"))


@query("SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def token_counts(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("lang").alias("langs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, 'Msg ' || substr(CAST(doc_id AS VARCHAR), 1, 1) || ' to ' || upper(substr(source, 1, 1)) || substr(source, 2) AS label FROM documents")
def address_fallback(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("Msg "), F.substring(F.col("doc_id").cast("string"), 1, 1), F.lit(" to "), mail.display_name(F.concat("source", F.lit("@x.example")))).alias("label"))


@query("SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('Is order ' || o_orderkey || ' a match?'), 1, 2))::INT % 2 = 1 THEN true ELSE false END AS verdict FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus <> 'F'")
def model_judge(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    prompt = F.concat(F.lit("Is order "), F.col("o_orderkey").cast("string"), F.lit(" a match?"))
    return models.judged(orders, models.echo, prompt, F.col("o_orderstatus") == "F").select("o_orderkey", "verdict")


@query(f"""WITH {_LOG} SELECT user_id, count(*) AS n_tool_calls, count(*) FILTER (tool = 'READ') AS reads, count(*) FILTER (tool = 'SEARCH') AS searches,
count(DISTINCT CASE WHEN tool = 'READ' THEN k END) AS opened, count(k) FILTER (tool = 'READ') - count(DISTINCT CASE WHEN tool = 'READ' THEN k END) AS redundant FROM log GROUP BY user_id""")
def stream_session_metrics(spark, d):
    return sessions.replay(spark, _log(spark, d), scratch(spark, "sessions"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END * (o_custkey % 5) / 4, 6) AS final FROM orders")
def deferred_final(spark, d):
    found = (F.col("o_orderstatus") == "F").cast("double")
    return read(spark, d, "orders").select("o_orderkey", F.round(found * (F.col("o_custkey") % 5) / 4, 6).alias("final"))



_FILES = [("Audit_H.pdf ", "Audit.pdf "), ("Med_PersonC_Oct.pdf ", "Med_Oct.pdf "), ("H_Status__x ", "Status_x "), ("PersonCx ", "PersonCx ")]


@query(f"SELECT doc_id, {planted_sql(_FILES, 1, text="regexp_replace(text, '[_-]{2,}', '_', 'g')")} AS text FROM documents")
def scrub_labels(spark, d):
    """Whole texts with names of files planted in them, without labels."""
    return read(spark, d, "documents").select("doc_id", T.scrub_labels(planted(_FILES, 0)).alias("text"))


@query("SELECT conv_id, turn, array_to_string(list_filter(['The', 'Onth', 'Is'], lambda n: regexp_matches(text, '(^|[^A-Za-z0-9])' || n || '([^A-Za-z0-9]|$)')), ',') AS leaks FROM conversations")
def anonymisation_leaks(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.leaks("text", ["The", "Onth", "Is"]), ",").alias("leaks"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'work' WHEN l_returnflag = 'A' THEN 'work' ELSE 'casual' END AS register,
CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'omission' WHEN l_linenumber = 2 THEN 'paltering' ELSE 'commission' END AS mechanism FROM lineitem""")
def type_resolution(spark, d):
    kind = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "old").when(F.col("l_linenumber") == 2, "paltering").otherwise("?")
    register = F.when(F.col("l_returnflag") == "A", "work").otherwise("unknown")
    t = T.resolve_type(register, kind, {"old": ("work", "omission")}, ["work", "casual"], ["commission", "paltering"])
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t")).select("l_orderkey", "l_linenumber", "t.register", "t.mechanism")


@query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j FROM conversations)
SELECT conv_id, count(*) AS n_messages, 'clue-' || conv_id || '-0' AS first_id, max_by(replace(role, '.', ' '), j) AS last_from, array_to_string(list_sort(list_distinct(list(role))), ',') AS participants,
'2001-10-13T09:00:00' AS date_first, '2001-10-13T' || printf('%02d', 9 + 4 * (count(*) - 1)) || ':00:00' AS date_last FROM m GROUP BY conv_id""")
def clue_threads(spark, d):
    """A dialogue as a thread: dates in order on one clamped day, ids that reply to one another. The hour counts on past the
    day's end, so that longer threads keep their order."""
    one = F.struct("turn", "role")
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    day = T.clamp_era(F.lit("2024-10-13"))
    at = lambda j: F.concat(day, F.lit("T"), F.format_string("%02d", 9 + 4 * j), F.lit(":00:00"))
    n = F.size("m")
    return c.select(
        "conv_id", n.cast("long").alias("n_messages"), F.concat_ws("-", F.lit("clue"), "conv_id", F.lit("0")).alias("first_id"), F.replace(F.element_at("m", -1)["role"], F.lit("."), F.lit(" ")).alias("last_from"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: m["role"]))), ",").alias("participants"), at(F.lit(0)).alias("date_first"), at(n - 1).alias("date_last"),
    )


@query("""WITH e AS (SELECT source, doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS words, lower(substr(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'), 1, 40)) AS sig FROM documents
 WHERE doc_id IN ("""
    + ORACLE_PROSE
    + """)),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source, sig ORDER BY doc_id) = 1), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 14)
SELECT source, doc_id FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(words - 55), doc_id) <= 2""")
def style_bank(spark, d):
    """For each source the first 14 texts of clean prose with different openings, of which the two nearest to 55 words."""
    docs = read(spark, d, "documents").where(T.is_clean_prose("text"))
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    sig = F.lower(F.substring(F.regexp_replace("text", "[ \\t\\r\\n\\f]+", " "), 1, 40))
    first = docs.groupBy("source", sig.alias("sig")).agg(F.min_by(F.struct("doc_id", words.alias("words")), "doc_id").alias("r")).select("source", "r.*")
    some = first.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 14")
    near = F.row_number().over(Window.partitionBy("source").orderBy(F.abs(F.col("words") - 55), "doc_id"))
    return some.withColumn("k", near).where("k <= 2").select("source", "doc_id")
