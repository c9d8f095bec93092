"""Queries of the mailbox, its sessions and its records, over whole tables, with their SQL. conv_id is the thread, turn the
position, conv_id * 8 + turn the message's id; user_id is the session, event_id its step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import choices as C
from mailquarry.operators import mailbox as X
from mailquarry.operators import models
from mailquarry.operators import records as R
from mailquarry.operators import retrieval as S
from mailquarry.operators import rules as U
from mailquarry.plans.evaluation import _LOG, _log
from mailquarry.plans.search import _Q, _SCORES, _SPACE, _TOKENS, _TOP, _kin_docs, _token_sets, planted, planted_sql, read
from mailquarry.sources import mail

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_BOX = "box AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (ORDER BY conv_id, turn) AS n, dense_rank() OVER (ORDER BY conv_id) AS t, conv_id * 8 + turn AS id FROM conversations)"
_SEEN = "seen AS (SELECT DISTINCT user_id, b.conv_id FROM log JOIN box b ON n = k WHERE tool = 'READ')"
_MAIL_SCORES = _SCORES.replace("doc_id AS doc", "conv_id * 8 + turn AS doc").replace("FROM documents", "FROM conversations")


def _box(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return X.mailbox(c.withColumn("id", F.col("conv_id") * 8 + F.col("turn")), "conv_id", "turn")


def _clues(spark, d):
    return read(spark, d, "benchmark").select((F.col("item_id") * 5).alias("id"))


def _reads(spark, d, box):
    """(user_id, event_id, conv_id): the thread that each READ opens."""
    asks = _log(spark, d).where("tool = 'READ'").select("user_id", "event_id", F.concat(F.lit("e"), F.col("k").cast("string")).alias("asked"))
    return X.asked_threads(asks, box, "conv_id", "asked")


@query(f"WITH {_BOX} SELECT conv_id, turn, 'e' || n AS handle, 't' || t AS thread_handle, id IN (SELECT item_id * 5 FROM benchmark) AS clue FROM box")
def mailbox_handles(spark, d):
    """The mailbox: each message with its handles, and whether it is a clue."""
    clue = _clues(spark, d).withColumn("clue", F.lit(True))
    return _box(spark, d).join(clue, "id", "left").select("conv_id", "turn", "handle", "thread_handle", F.coalesce("clue", F.lit(False)).alias("clue"))


@query(f"""WITH {_BOX}, h AS (SELECT conv_id, t, count(*) AS n_messages, max(CASE WHEN turn = m THEN substr(trim({_SPACE.format('text')}), 1, 60) END) AS subject, max(CASE WHEN turn = m THEN length(text) END) AS day
 FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS m FROM box) GROUP BY ALL),
p AS (SELECT DISTINCT CAST(floor(i * (total / 40.0::DOUBLE)) AS BIGINT) + 1 AS t FROM (SELECT unnest(range(40)) AS i), (SELECT count(*) AS total FROM h))
SELECT 't' || t AS thread_handle, n_messages, subject, CAST(row_number() OVER (ORDER BY day, t) AS INT) AS place FROM h WHERE (SELECT count(*) FROM h) <= 40 OR t IN (SELECT t FROM p)""")
def mailbox_list(spark, d):
    """LIST: an even stride of 40 threads, in the order of their first messages (here of their length)."""
    box = _box(spark, d)
    first = F.min_by(F.struct(T.oneline("text", 60).alias("subject"), F.length("text").alias("day")), "turn")
    threads = box.groupBy("conv_id", "thread_handle").agg(F.count(F.lit(1)).alias("n_messages"), first.alias("f")).withColumn("at", X.number("thread_handle") - 1)
    shown = X.stride(threads, "at", 40)
    return shown.select("thread_handle", "n_messages", "f.subject", F.row_number().over(Window.orderBy("f.day", "at")).alias("place"))


@query(f"""WITH {_LOG}, {_BOX}, c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS size, trim({_SPACE.format('text')}) AS one FROM box),
chain AS (SELECT conv_id, t, count(*) AS n, 'thread t' || t || ' (' || count(*) || CASE WHEN count(*) = 1 THEN ' message):' ELSE ' messages):' END
 || string_agg(chr(10) || chr(10) || '[e' || n || '] From: ' || role || chr(10) || substr(one, 1, CASE WHEN size = 1 THEN 1500 ELSE 700 END), '' ORDER BY n) AS shown FROM c GROUP BY conv_id, t),
a AS (SELECT user_id, event_id, CASE WHEN k % 2 = 0 THEN 'e' ELSE 't' END || k AS asked, CASE WHEN k % 2 = 0 THEN (SELECT conv_id FROM box WHERE n = k) ELSE (SELECT max(conv_id) FROM box WHERE t = k) END AS conv_id FROM log WHERE tool = 'READ')
SELECT user_id, event_id, asked, coalesce(CAST(n AS INT), 0) AS n, coalesce(shown, '(no email with handle ''' || asked || ''')') AS shown FROM a LEFT JOIN chain USING (conv_id)""")
def mailbox_read(spark, d):
    """READ of a message or a thread shows the whole chain."""
    box = _box(spark, d)
    asks = _log(spark, d).where("tool = 'READ'").select("user_id", "event_id", F.concat(F.when(F.col("k") % 2 == 0, "e").otherwise("t"), F.col("k").cast("string")).alias("asked"))
    shown = X.asked_threads(asks, box, "conv_id", "asked").join(X.chains(box, "conv_id", "turn", "role", "text"), "conv_id", "left")
    none = F.concat(F.lit("(no email with handle '"), "asked", F.lit("')"))
    return shown.select("user_id", "event_id", "asked", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("shown", none).alias("shown"))


@query(f"""WITH {_Q}{_MAIL_SCORES}, {_TOP}, {_LOG}, {_BOX}, {_SEEN}
SELECT r.qid, 'e' || n AS handle, round(score, 6) AS score, CAST(rank AS INT) AS rank, EXISTS (SELECT 1 FROM seen s WHERE s.user_id = r.qid AND s.conv_id = b.conv_id) AS is_read FROM r JOIN box b ON b.id = r.doc WHERE rank <= 12""")
def mailbox_search(spark, d):
    """SEARCH of each session for the passage of its number: the 12 best messages, those opened before marked."""
    box = _box(spark, d)
    hits = S.best(box.select(F.col("id").alias("doc"), T.tokenize("text").alias("tokens")), read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.tokenize("text").alias("tokens")), 12)
    seen = X.opened(_reads(spark, d, box), box, "user_id", "conv_id", "id").select(F.col("user_id").alias("qid"), F.col("id").alias("doc"), F.lit(True).alias("r"))
    named = hits.join(box.select(F.col("id").alias("doc"), "handle"), "doc").join(seen, ["qid", "doc"], "left")
    return named.select("qid", "handle", F.round("score", 6).alias("score"), "rank", F.coalesce("r", F.lit(False)).alias("is_read"))


@query(f"""WITH {_LOG}, {_BOX}, {_SEEN}, ask AS (SELECT user_id AS qid, b.id AS doc, text FROM (SELECT user_id, arg_max(k, event_id) AS k FROM log WHERE tool = 'READ' AND user_id % 50 = 0 GROUP BY user_id) JOIN box b ON n = k),
q AS (SELECT DISTINCT qid, unnest({_TOKENS}) AS term FROM ask), {_MAIL_SCORES},
left_over AS (SELECT s.* FROM s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM seen JOIN box USING (conv_id) WHERE user_id = s.qid AND id = s.doc) AND NOT EXISTS (SELECT 1 FROM ask WHERE ask.qid = s.qid AND ask.doc = s.doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM left_over)
SELECT qid, 'e' || n AS handle, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r JOIN box b ON b.id = r.doc WHERE rank <= 8""")
def mailbox_expand(spark, d):
    """EXPAND of the message that a session read last: what is most like it and not opened yet. Queries: the sessions whose
    number 50 divides, against all messages."""
    box = _box(spark, d)
    reads = _reads(spark, d, box).where("user_id % 50 = 0")
    last = reads.groupBy(F.col("user_id").alias("qid")).agg(F.max_by("asked", "event_id").alias("handle")).join(box.select("handle", F.col("id").alias("doc")), "handle").select("qid", "doc")
    seen = X.opened(reads, box, "user_id", "conv_id", "id").select(F.col("user_id").alias("qid"), F.col("id").alias("doc"))
    hits = X.expand(box.select(F.col("id").alias("doc"), T.tokenize("text").alias("tokens")), last, seen)
    return hits.join(box.select(F.col("id").alias("doc"), "handle"), "doc").select("qid", "handle", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_LOG}, {_BOX}, {_SEEN}, c AS (SELECT DISTINCT conv_id FROM box WHERE id IN (SELECT item_id * 5 FROM benchmark)), u AS (SELECT DISTINCT user_id FROM log), t AS (SELECT count(*) AS n FROM c)
SELECT user_id, n AS n_clues_total, count(c.conv_id) AS n_clues_read, round(count(c.conv_id)::DOUBLE / n, 3) AS clue_recall FROM u CROSS JOIN t LEFT JOIN seen USING (user_id) LEFT JOIN c ON c.conv_id = seen.conv_id GROUP BY user_id, n""")
def clue_recall(spark, d):
    box = _box(spark, d)
    clues = box.join(_clues(spark, d), "id", "left_semi").select("conv_id")
    every = _log(spark, d).select("user_id", F.lit(None).cast("long").alias("conv_id")).distinct()
    return X.clue_recall(every.union(_reads(spark, d, box).select("user_id", "conv_id")), clues, "user_id", "conv_id")


@query(f"WITH {_BOX}, t AS (SELECT DISTINCT t FROM box) SELECT 't' || t AS thread_handle, (t - 1) // 20 AS segment, CAST((t - 1) // 20 * 20 + 1 AS BIGINT) AS first, least((t - 1) // 20 * 20 + 20, (SELECT count(*) FROM t)) AS last FROM t")
def segment_blocks(spark, d):
    """Blocks of 20 threads in the mailbox's own order, with the first and last number of each."""
    t = _box(spark, d).select("thread_handle").distinct().withColumn("segment", F.floor((X.number("thread_handle") - 1) / 20))
    total = t.agg(F.count(F.lit(1)).alias("n"))
    return t.crossJoin(F.broadcast(total)).select("thread_handle", "segment", (F.col("segment") * 20 + 1).alias("first"), F.least(F.col("segment") * 20 + 20, "n").alias("last"))


@query(f"""WITH {_LOG}, {_BOX}, f AS (SELECT user_id, conv_id, min(event_id) AS event_id FROM log JOIN box ON n = k WHERE tool = 'READ' GROUP BY ALL),
p AS (SELECT conv_id, substr(string_agg('[e' || n || '] ' || role || ': ' || text, chr(10) || chr(10) ORDER BY n), 1, 4000) AS prompt, string_agg('e' || n, ' ' ORDER BY n) AS handles FROM box GROUP BY conv_id)
SELECT user_id, event_id, handles || ' -- ' || '{{"match": ' || CASE WHEN ('0x' || substr(sha256(prompt), 1, 2))::INT % 2 = 1 THEN 'true' ELSE 'false' END || '}}' AS note FROM f JOIN p USING (conv_id)""".replace("{{", "{").replace("}}", "}"))
def thread_notes(spark, d):
    """A line of notes when a session first reads a thread, by a generator (here a deterministic one); each thread's is made once.
    The prompt has the first 4,000 characters of a thread, which is the size that the note is defined on."""
    box = _box(spark, d)
    first = _reads(spark, d, box).where("conv_id is not null").groupBy("user_id", "conv_id").agg(F.min("event_id").alias("event_id"))
    one = F.struct("turn", "handle", F.concat(F.lit("["), "handle", F.lit("] "), "role", F.lit(": "), "text").alias("x"))
    g = box.join(first.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    prompt = F.substring(F.array_join(F.transform("m", lambda m: m["x"]), "\n\n"), 1, 4000)
    said = g.select("conv_id", F.array_join(F.transform("m", lambda m: m["handle"]), " ").alias("handles"), T.oneline(models.generated(models.echo, prompt), 240).alias("line"))
    return first.join(said.where("line <> ''"), "conv_id").select("user_id", "event_id", F.concat_ws(" -- ", "handles", "line").alias("note"))


@query(f"""WITH {_LOG}, w AS (SELECT *, sum(CASE WHEN tool IN ('LIST', 'SEARCH', 'READ') THEN 1 ELSE 0 END) OVER p AS used, count(*) OVER p AS turns, max(CASE WHEN tool = 'ANSWER' THEN 1 ELSE 0 END) OVER p AS answered,
 10 - len(list_distinct(list(CASE WHEN tool = 'SEGMENT' THEN k % 10 END) OVER p)) AS left_over FROM log WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CASE WHEN answered = 1 THEN 'end' WHEN turns >= 40 + 10 + 8 THEN 'turn_limit' WHEN used >= 40 AND left_over > 0 THEN 'scan ' || left_over WHEN used >= 40 THEN 'answer now' WHEN k IS NULL THEN 'call a tool' ELSE 'go on' END AS next FROM w""")
def next_message(spark, d):
    """What a session is told after each step."""
    p = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = _log(spark, d).withColumn("used", F.sum(F.col("tool").isin("LIST", "SEARCH", "READ").cast("int")).over(p)).withColumn("turns", F.count(F.lit(1)).over(p))
    log = log.withColumn("answered", F.max(F.col("tool") == "ANSWER").over(p)).withColumn("left_over", 10 - F.size(F.collect_set(F.when(F.col("tool") == "SEGMENT", F.col("k") % 10)).over(p)))
    told = F.when(F.col("answered"), "end").when(F.col("turns") >= 40 + 10 + 8, "turn_limit").when((F.col("used") >= 40) & (F.col("left_over") > 0), F.concat(F.lit("scan "), F.col("left_over").cast("string")))
    return log.select("user_id", "event_id", told.when(F.col("used") >= 40, "answer now").when(F.col("k").isNull(), "call a tool").otherwise("go on").alias("next"))


_CANDIDATES = """CASE event_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN '[{"secret": " s' || k || ' ", "evidence_email_ids": ["e' || k || '"]}]' WHEN 2 THEN '[{"secret": "a", "evidence_email_ids": []}, {"secret": "b", "evidence_email_ids": []}]'
 WHEN 3 THEN '[{"secret": " ", "evidence_email_ids": []}]' WHEN 4 THEN '[{"secret": "s", "evidence_email_ids": [' || k || ']}]' ELSE '{"secret": "s"}' END"""


@query(f"""WITH {_LOG}, w AS (SELECT *, sum(CASE WHEN tool IN ('LIST', 'SEARCH', 'READ') THEN 1 ELSE 0 END) OVER p AS used, sum(CASE WHEN tool = 'READ' THEN 1 ELSE 0 END) OVER p + count(DISTINCT CASE WHEN tool = 'SEARCH' THEN k END) OVER p AS credit, lag(tool) OVER q AS last, lag(k) OVER q AS hits,
 10 - len(list_distinct(list(CASE WHEN tool = 'SEGMENT' THEN k % 10 END) OVER p)) AS left_over FROM log WINDOW q AS (PARTITION BY user_id ORDER BY event_id), p AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CASE event_id % 6 WHEN 5 THEN 'not a list' WHEN 2 THEN 'count' WHEN 3 THEN 'no secret' WHEN 4 THEN 'evidence' ELSE
 CASE WHEN used < 40 AND credit < 3 THEN 'investigate' WHEN used < 40 AND coalesce(last = 'SEARCH' AND hits > 0, false) THEN 'unread' WHEN event_id % 6 = 0 AND left_over > 0 THEN 'scan ' || left_over ELSE 'accepted' END END AS verdict,
 CASE WHEN event_id % 6 = 1 THEN 's' || k ELSE '' END AS secret FROM w WHERE tool = 'ANSWER'""")
def submit_candidates(spark, d):
    """The whole gate of an answer: a list, as many candidates as asked or none, each with a secret and a list of handles; then
    investigation and unread results unless the budget is spent; and for an empty answer, forced or not, the whole scan."""
    q = Window.partitionBy("user_id").orderBy("event_id")
    p = q.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = _log(spark, d).withColumn("used", F.sum(F.col("tool").isin("LIST", "SEARCH", "READ").cast("int")).over(p)).withColumn("last", F.lag("tool").over(q)).withColumn("hits", F.lag("k").over(q))
    log = log.withColumn("left_over", 10 - F.size(F.collect_set(F.when(F.col("tool") == "SEGMENT", F.col("k") % 10)).over(p)))
    log = U.with_credit(log, "user_id", "event_id", "tool", F.when(F.col("k").isNotNull(), F.array(F.col("k").cast("string"))))
    log = log.where("tool = 'ANSWER'").withColumn("said", F.expr(_CANDIDATES.replace("|| k ||", "|| cast(k as string) ||"))).withColumn("fault", U.misshapen(F.col("said"), 1))
    said = U.candidates(F.col("said"))
    scan = F.when((F.size(said) == 0) & (F.col("left_over") > 0), F.concat(F.lit("scan "), F.col("left_over").cast("string")))
    verdict = F.coalesce("fault", U.too_early(F.col("used"), 40, F.col("credit"), 3, F.col("last"), F.col("hits")), scan, F.lit("accepted"))
    secret = F.when(F.col("fault").isNull(), U.secret_of(F.get(said, 0)))
    return log.select("user_id", "event_id", verdict.alias("verdict"), F.coalesce(secret, F.lit("")).alias("secret"))


# ---- assembly


@query("""WITH corpus AS (SELECT conv_id AS thread, turn AS position, 'm' || conv_id || '-' || turn AS message_id, printf('2001-%02d-%02dT%02d', 1 + conv_id % 12, 1 + conv_id % 28, 9 + turn) AS date FROM conversations),
clues AS (SELECT item_id AS "case", -1 - item_id * 2 - (p > 0)::INT AS thread, greatest(p - 1, 0) AS position, 'c' || item_id || '-' || p AS message_id, CASE WHEN p = 2 THEN 'c' || item_id || '-1' END AS in_reply_to, printf('2001-%02d-15T%02d', 1 + item_id % 12, 9 + p) AS date FROM benchmark, (SELECT unnest([0, 1, 2]) AS p)),
cluster AS (SELECT DISTINCT item_id AS "case", item_id * 3 AS thread FROM benchmark), need AS (SELECT "case", count(*) AS need FROM clues GROUP BY ALL),
pool AS (SELECT thread, count(*) AS n FROM corpus WHERE thread % 17 <> 0 GROUP BY thread),
own AS (SELECT "case", message_id, row_number() OVER (PARTITION BY "case" ORDER BY sha256('11:' || message_id), message_id) AS k FROM cluster JOIN corpus USING (thread)),
have AS (SELECT "case", need, (SELECT count(*) FROM own o WHERE o."case" = need."case" AND k <= need) AS have FROM need),
may AS (SELECT h.*, p.thread, n, sum(n) OVER (PARTITION BY h."case" ORDER BY sha256('11:' || p.thread), p.thread) - n AS before FROM have h, pool p WHERE NOT EXISTS (SELECT 1 FROM cluster c WHERE c."case" = h."case" AND c.thread = p.thread)),
lent AS (SELECT "case", k, message_id FROM own JOIN need USING ("case") WHERE k <= need
 UNION ALL SELECT "case", have + row_number() OVER (PARTITION BY "case" ORDER BY before, thread, position), message_id FROM may JOIN corpus USING (thread) WHERE before < need - have),
given AS (SELECT c.*, l.message_id AS new FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY thread, position) AS k FROM clues) c JOIN lent l USING ("case", k)),
noise AS (SELECT "case", thread FROM may WHERE before >= need - have QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY sha256('11:' || thread), thread) <= 20),
rows AS (SELECT g."case", g.thread, g.position, g.new AS message_id, coalesce(r.new, g.in_reply_to) AS in_reply_to, g.date, true AS clue FROM given g LEFT JOIN given r ON r."case" = g."case" AND r.message_id = g.in_reply_to
 UNION ALL SELECT "case", thread, position, message_id, NULL, date, false FROM noise JOIN corpus USING (thread)),
f AS (SELECT *, min(date) OVER (PARTITION BY "case", thread) AS first FROM rows)
SELECT "case", CAST(row_number() OVER (PARTITION BY "case" ORDER BY first, thread, position) AS INT) AS place, thread, position, message_id, in_reply_to, clue FROM f""")
def haystack_full(spark, d):
    """Archives with the event's threads left out, clue messages under borrowed ids, replies linked anew, by date. The smallest
    tables have fewer threads than an archive's noise; then it takes all there are."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("position"), F.concat(F.lit("m"), F.concat_ws("-", "conv_id", "turn")).alias("message_id"), F.format_string("2001-%02d-%02dT%02d", 1 + F.col("conv_id") % 12, 1 + F.col("conv_id") % 28, 9 + F.col("turn")).alias("date"))
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("case"))
    name = lambda p: F.concat(F.lit("c"), F.concat_ws("-", "case", p.cast("string")))
    clues = items.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    clues = clues.select("case", (-1 - F.col("case") * 2 - (F.col("p") > 0).cast("int")).alias("thread"), F.greatest(F.col("p") - 1, F.lit(0)).cast("long").alias("position"), name(F.col("p")).alias("message_id"), F.when(F.col("p") == 2, name(F.lit(1))).alias("in_reply_to"), F.format_string("2001-%02d-15T%02d", 1 + F.col("case") % 12, 9 + F.col("p")).alias("date"))
    cluster = items.distinct().withColumn("thread", F.col("case") * 3)
    return X.full_haystack(clues, c, cluster, c.where("thread % 17 = 0").select("thread"), 20, 11, short_ok=True)


@query(f"""WITH {_Q}{_MAIL_SCORES}, t AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE score > 0),
r AS (SELECT qid AS "case", doc AS id FROM t WHERE rank <= 20 AND score >= 2 AND score >= 0.15 * best UNION SELECT item_id, item_id * 5 FROM benchmark)
SELECT DISTINCT "case", conv_id AS thread FROM r JOIN conversations ON conv_id * 8 + turn = id""")
def event_clusters(spark, d):
    """The threads to leave out of a case's archive: the anchor's, and those much like what is asked."""
    b = read(spark, d, "benchmark")
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("thread"), (F.col("conv_id") * 8 + F.col("turn")).alias("id"), T.tokenize("text").alias("tokens"))
    best = S.best(c.withColumnRenamed("id", "doc"), b.select(F.col("item_id").alias("qid"), T.tokenize("text").alias("tokens")), 20)
    near = S.related(best).select(F.col("qid").alias("case"), F.col("doc").alias("id"))
    return X.event_cluster(b.select(F.col("item_id").alias("case"), (F.col("item_id") * 5).alias("id")), near, c)


_BANK = ["Q3_plan.xls", "memo.doc", "notes.txt"]


@query(f"""SELECT doc_id, replace(replace(text, '. ', '. ' || ({_BANK})[('0x' || substr(sha256(doc_id || ':<<F1>>'), 1, 7))::INT % 3 + 1] || ' '), ', ', ', ' || ({_BANK})[('0x' || substr(sha256(doc_id || ':<<F2>>'), 1, 7))::INT % 3 + 1] || ' ') AS text FROM documents""")
def realized_refs(spark, d):
    """Whole texts with marks of files planted in them, and names from a bank in their places."""
    said = F.replace(F.replace("text", F.lit(". "), F.lit(". <<F1>> ")), F.lit(", "), F.lit(", <<F2>> "))
    return read(spark, d, "documents").select("doc_id", X.realized(said, ["<<F1>>", "<<F2>>"], _BANK, F.col("doc_id")).alias("text"))


@query("SELECT conv_id, substr(string_agg(role || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn), 1, 900) AS text FROM conversations GROUP BY conv_id")
def thread_dumps(spark, d):
    """Threads as plain text of at most 900 characters."""
    c = read(spark, d, "conversations")
    return X.dump(c, "conv_id", "turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))), 900)


@query(f"""WITH RECURSIVE t AS (SELECT item_id % 4 AS category, item_id, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS k, list_distinct({_TOKENS}) AS toks FROM benchmark),
f AS (SELECT DISTINCT category, 0::BIGINT AS k, []::BIGINT[] AS ids, []::VARCHAR[][] AS kept FROM t
UNION ALL SELECT category, tk, CASE WHEN ok THEN list_append(ids, item_id) ELSE ids END, CASE WHEN ok THEN list_append(kept, toks) ELSE kept END
FROM (SELECT f.*, t.item_id, t.k AS tk, t.toks, len(toks) > 0 AND len(ids) < 6 AND len(list_filter(kept, lambda o: len(list_intersect(o, toks))::DOUBLE / (len(o) + len(toks) - len(list_intersect(o, toks))) >= 0.06)) = 0 AS ok FROM f JOIN t ON f.category = t.category AND t.k = f.k + 1))
SELECT category, array_to_string(ids, ',') AS accepted FROM f QUALIFY row_number() OVER (PARTITION BY category ORDER BY k DESC) = 1""")
def accepted_topics(spark, d):
    """Up to six topics of each category, in order, none too like one taken before."""
    topics = read(spark, d, "benchmark").select((F.col("item_id") % 4).alias("category"), F.col("item_id").alias("id"), F.array_distinct(T.tokenize("text")).alias("toks"))
    ids = C.accepted(topics, 6, 0.06).groupBy("category").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    every = topics.select("category").distinct().join(ids, "category", "left")
    return every.select("category", F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<bigint>")), lambda x: x.cast("string")), ",").alias("accepted"))


@query(f"""WITH x AS (SELECT doc_id, list_distinct({_TOKENS}) AS toks FROM documents), y AS (SELECT DISTINCT list_sort(list_distinct({_TOKENS})) AS toks, min(item_id) AS id FROM benchmark GROUP BY ALL),
e AS (SELECT doc_id, unnest(toks) AS t FROM x), f AS (SELECT id, unnest(toks) AS t FROM y), p AS (SELECT doc_id, id, count(*) AS shared FROM e JOIN f USING (t) GROUP BY ALL)
SELECT doc_id, len(toks) = 0 OR EXISTS (SELECT 1 FROM p JOIN y USING (id) WHERE p.doc_id = x.doc_id AND shared::DOUBLE / (len(x.toks) + len(y.toks) - shared) >= 0.5) AS duplicate FROM x""")
def duplicate_of_accepted(spark, d):
    """Whether a topic's words are too like those of an accepted one."""
    accepted = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(T.tokenize("text")).alias("toks"))
    return X.like_any(_token_sets(spark, d), accepted, 0.5).select(F.col("id").alias("doc_id"), "duplicate")


_VOTES2 = "SELECT l_orderkey AS k, l_linenumber AS s, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS whole, count(*) AS probers, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS votes FROM lineitem GROUP BY ALL"


@query(f"""SELECT k, count(CASE WHEN NOT whole AND votes >= probers // 2 + 1 THEN 1 END) AS leaks, max(CASE WHEN whole THEN votes >= 1 END) AS joint_ok,
count(CASE WHEN NOT whole AND votes >= probers // 2 + 1 THEN 1 END) = 0 AND max(CASE WHEN whole THEN votes >= 1 END) AS valid FROM ({_VOTES2.replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber")}) GROUP BY k""")
def and_gate_joint(spark, d):
    """A clue set is valid if no proper subset leaks to a majority of its probers and the whole set, the last, is recovered by
    at least one."""
    votes = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("s")).agg(F.count(F.lit(1)).alias("probers"), F.sum((F.col("l_discount") > 0.05).cast("int")).alias("votes"))
    one = F.struct(F.col("s"), (F.col("votes") >= F.floor(F.col("probers") / 2) + 1).alias("leak"), (F.col("votes") >= 1).alias("found"))
    g = votes.groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("v"))
    leaks = F.size(F.filter(F.slice("v", F.lit(1), F.size("v") - 1), lambda x: x["leak"])).cast("long")
    return g.select("k", leaks.alias("leaks"), F.element_at("v", -1)["found"].alias("joint_ok")).withColumn("valid", (F.col("leaks") == 0) & F.col("joint_ok"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'box' || c_custkey || '@y.example' WHEN c_custkey % 3 = 1 THEN lower(replace(c_name, ' ', '.')) || '@x.example' ELSE 'unknown@x.example' END AS address FROM customer""")
def name_address(spark, d):
    """A name's address: the one on file, else made of the name, unknown for an empty one."""
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 2, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("name"))
    known = read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("box"), F.col("c_custkey").cast("string"), F.lit("@y.example")).alias("address"))
    return mail.with_address(c, known, "name", "x.example").select("c_custkey", "address")


@query("SELECT l_orderkey, l_linenumber, p_name AS plot FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey")
def plot_carry(spark, d):
    """Clues with the plot that their number has, if any."""
    plots = read(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("plot"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(plots, "l_partkey", "left").select("l_orderkey", "l_linenumber", "plot")


@query("SELECT printf('T%02d', row_number() OVER (ORDER BY s_suppkey)) AS id, s_name AS secret, CASE WHEN s_acctbal > 0 THEN 'work' ELSE 'casual' END AS register, '' AS carrier FROM supplier")
def topic_entry(spark, d):
    """Topics as they are written, with defaults and ids; numbered in blocks."""
    s = read(spark, d, "supplier").withColumn("b", F.floor(F.col("s_suppkey") / 65536))
    base = s.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("base"))
    n = F.row_number().over(Window.partitionBy("b").orderBy("s_suppkey")) + F.col("base")
    return s.join(base, "b").select(F.format_string("T%02d", n).alias("id"), F.col("s_name").alias("secret"), F.when(F.col("s_acctbal") > 0, "work").otherwise("casual").alias("register"), F.lit("").alias("carrier"))


@query("""SELECT l_orderkey, l_linenumber, unnest(['a1', 'a2', 'a3']) AS atom, unnest([CASE WHEN l_returnflag = 'N' THEN 'true_state' ELSE l_returnflag END, 'knew', 'false_statement']) AS role, unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS fact FROM lineitem""")
def atom_index(spark, d):
    """A record's three facts as rows, with the usual roles where none is given."""
    roles = [F.coalesce(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.lit("true_state")), F.lit("knew"), F.lit("false_statement")]
    facts = [F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber").cast("string")]
    atoms = F.array(*[F.struct(F.lit(f"a{i + 1}").alias("atom"), r.alias("role"), f.alias("fact")) for i, (r, f) in enumerate(zip(roles, facts))])
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(atoms).alias("a")).select("l_orderkey", "l_linenumber", "a.*")


@query("SELECT o_orderkey, o_orderpriority AS secret, 'order ' || o_orderkey AS actor, coalesce(nullif(o_orderstatus, 'O'), 'open') AS victim FROM orders")
def answer_projection(spark, d):
    """The intended answer of a record: secret, actor, victim."""
    given = F.struct(F.col("o_orderpriority").alias("secret"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("actor"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("victim"))
    return read(spark, d, "orders").select("o_orderkey", given.alias("answer")).select("o_orderkey", "answer.*")


# ---- labels in whole texts

_PEOPLE = {"Person A": "Ada Reed", "Person B": "Bo Ek", "Person C": "Cy Dahl"}
_LABELS = [("Person A ", "Ada Reed "), ("person_b ", "Bo Ek "), ("PersonC@x.example ", "cy.dahl@x.example "), ("Plan A's ", "Plan A's "), ("A's ", "Ada Reed's ")]


@query(f"SELECT doc_id, {planted_sql(_LABELS, 1)} AS text FROM documents")
def reground_texts(spark, d):
    """Whole texts with labels planted in them, and names put in their places."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", T.reground(planted(_LABELS, 0), _PEOPLE).alias("text"))


@query(f"""SELECT conv_id, list(CASE WHEN turn % 2 = 0 THEN 'Ada Reed' ELSE 'Bo Ek' END ORDER BY turn)[1] AS first_from, string_agg('Ada: ' || coalesce(text, ''), chr(10) ORDER BY turn) AS bodies FROM conversations GROUP BY conv_id""")
def reground_records(spark, d):
    """Messages of records: full names in the heads, first names in the bodies."""
    first = {k: v.split()[0] for k, v in _PEOPLE.items()}
    c = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "Person A").otherwise("person-B").alias("sender"), F.concat(F.lit("PERSON A: "), F.coalesce("text", F.lit(""))).alias("body"))
    done = c.select("conv_id", "turn", T.reground("sender", _PEOPLE).alias("sender"), T.reground("body", first).alias("body"))
    g = done.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "sender", "body"))).alias("m"))
    return g.select("conv_id", F.element_at("m", 1)["sender"].alias("first_from"), F.array_join(F.transform("m", lambda m: m["body"]), "\n").alias("bodies"))


@query("""SELECT doc_id, 'Ada Reed knew' AS plot, 'Ada Reed' AS sender, 'bo.ek@x.example;Cy Dahl' AS receivers, 'Ada: ' || coalesce(text, '') AS body, 'Bo Ek' AS second_from, 'Bo: ' || coalesce(text, '') AS second_body,
'Cy: ' || coalesce(text, '') AS third_body, 'Cy Dahl filed it' AS fact, 'Bo Ek hid it' AS secret FROM documents""")
def reground_forwards(spark, d):
    """Records of whole texts, whose messages forward others that forward others."""
    said = lambda who: F.concat(F.lit(f"{who}: "), F.coalesce("text", F.lit("")))
    third = F.struct(F.lit("personC").alias("from"), said("Person-C").alias("body"))
    second = F.struct(F.lit("Person B").alias("from"), said("person_b").alias("body"), third.alias("forward"))
    top = F.struct(F.lit("PERSON A").alias("from"), F.array(F.lit("personB@x.example"), F.lit("Person C")).alias("to"), said("Person A").alias("body"), second.alias("forward"))
    clue = F.struct(F.lit("Person A knew").alias("plot"), F.array(top).alias("messages"))
    records = read(spark, d, "documents").select("doc_id", F.array(clue).alias("clues"), F.array(F.struct(F.lit("Person C filed it").alias("fact"))).alias("atoms"), F.lit("person b hid it").alias("secret"))
    out = R.regrounded(records, _PEOPLE, texts=["secret"]).select("doc_id", "secret", F.col("clues")[0].alias("c"), F.col("atoms")[0]["fact"].alias("fact"))
    m = out.select("doc_id", "secret", "fact", "c.plot", F.col("c.messages")[0].alias("m"))
    return m.select(
        "doc_id", "plot", F.col("m.from").alias("sender"), F.array_join("m.to", ";").alias("receivers"), "m.body", F.col("m.forward.from").alias("second_from"), F.col("m.forward.body").alias("second_body"),
        F.col("m.forward.forward.body").alias("third_body"), "fact", "secret",
    )


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({planted_sql(_LABELS, 0)}, '\\bPerson [A-J]\\b'))), ',') AS labels FROM documents")
def label_roster(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(T.labels_in(planted(_LABELS, 0)), ",").alias("labels"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(replace({planted_sql(_LABELS, 0)}, 'Plan A''s', ''), '\\bA''s\\b')) AS INT) AS before, 0 AS after FROM documents")
def label_leaks(spark, d):
    """Bare labels in a person's place, before and after regrounding."""
    said = planted(_LABELS, 0)
    return read(spark, d, "documents").select("doc_id", F.size(T.labels_left(said)).alias("before"), F.size(T.labels_left(T.reground(said, _PEOPLE))).alias("after"))


@query(f"""WITH q AS (SELECT doc_id AS doc, {_TOKENS} AS tokens FROM documents), e AS (SELECT doc, len(tokens) AS dl, unnest(tokens) AS term FROM q), tf AS (SELECT doc, dl, term, count(*) AS c FROM e GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY term HAVING count(*) >= 2), x AS (SELECT doc, term, c::DOUBLE / dl * ln((SELECT count(*) FROM q)::DOUBLE / n) AS x FROM tf JOIN df USING (term)),
nn AS (SELECT doc, sqrt(sum(x * x)) + 1e-9 AS norm FROM x GROUP BY doc), w AS (SELECT doc, term, x / norm AS w FROM x JOIN nn USING (doc)),
s AS (SELECT a.doc AS qid, b.doc, sum(a.w * b.w) AS cosine FROM w a JOIN w b USING (term) WHERE a.doc % 50 = 0 AND a.doc <> b.doc GROUP BY ALL)
SELECT qid, doc, round(cosine, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, doc) <= 5""")
def tfidf_nearest(spark, d):
    """The five documents of the highest cosine with each whose id 50 divides."""
    return S.nearest_by_tfidf(_kin_docs(spark, d), 50, 5).select("qid", "doc", F.round("score", 6).alias("cosine"))


_OLD = [("Quilla Vorst", "quilla.vorst@old.example", "Mara Thorn", "mara.thorn@new.example")]
_ANON = [("Quilla Vorst wrote ", "Mara Thorn wrote "), ("quilla.vorst@OLD.example ", "mara.thorn@new.example "), ("Vorst and Quilla, jyx@old.example ", "Thorn and Mara, jyx@new.example "), ("Zwickcorp, Zwickcorps ", "Oakcorp, Zwickcorps ")]


@query(f"SELECT doc_id, 'Mara Thorn' AS sender, 'mara.thorn@new.example;jyx@new.example' AS receivers, CASE WHEN doc_id % 2 = 0 THEN 'Re: Oakcorp' END AS subject, {planted_sql(_ANON, 1, (". ",))} AS body FROM documents")
def anonymize_records(spark, d):
    """Messages with new names in all their fields: bodies are whole texts with names planted in them."""
    rules = T.substitutions(_OLD, [("@old.example", "@new.example")], [("Zwickcorp", "Oakcorp")])
    m = read(spark, d, "documents").select("doc_id", F.lit("Quilla Vorst").alias("sender"), F.array(F.lit("quilla.vorst@old.example"), F.lit("jyx@old.example")).alias("receivers"), F.when(F.col("doc_id") % 2 == 0, "Re: Zwickcorp").alias("subject"), planted(_ANON, 0, (". ",)).alias("body"))
    done = R.rewritten(m, rules, ("sender", "subject", "body"), ("receivers",))
    return done.withColumn("receivers", F.array_join("receivers", ";"))


# ---- evaluation rows

#: Log samples made of orders, in expressions that both engines read.
_SAMPLE = {
    "values": "CASE WHEN o_orderkey % 3 = 0 THEN '{\"final\": ' || o_custkey || ', \"clue_recall\": 0.5}' END",
    "details": "CASE WHEN o_orderkey % 5 <> 0 THEN '{\"budget\": 7, \"n_search\": ' || (o_orderkey % 9) || ', \"n_clues_total\": 3, \"budget_hit\": 1, \"clue_recall\": 0.25, \"secret\": \"' || o_orderpriority || '\"}' ELSE '{}' END",
    "metadata": "CASE WHEN o_orderkey % 2 = 0 THEN '{\"config\": \"com\", \"budget\": 9, \"topic\": \"W1\", \"rep\": 2, \"n_clues\": 4}' ELSE '{}' END",
    "store": "'{\"config\": \"stored\", \"budget\": 11, \"tester_chars\": 5, \"budget_hit\": ' || CASE WHEN o_orderkey % 7 = 0 THEN 'true' ELSE 'false' END || ', \"turns\": ' || (o_orderkey % 4) || '}'",
    "answer": "o_orderstatus",
    "total_time": "CASE WHEN o_orderkey % 4 <> 1 THEN CAST(o_custkey % 1000 AS DOUBLE) / 8 END",
}
_SAMPLE_SQL = f"SELECT o_orderkey, {', '.join(f'{x} AS {chr(34)}{name}{chr(34)}' for name, x in _SAMPLE.items())} FROM orders"


def _rows_sql() -> str:
    place = lambda p, name: f"{chr(34)}{p.partition(':')[0]}{chr(34)} ->> '$.{p.partition(':')[2] or name}'"
    columns = {name: f"coalesce({', '.join([*[place(p, name) for p in places], repr(mail.WITHOUT.get(name, ''))])})" for name, places in mail.LADDER.items()}
    columns["budget_hit"] = "coalesce(details ->> '$.budget_hit', CASE WHEN store ->> '$.budget_hit' = 'true' THEN '1' ELSE '0' END)"
    columns["latency_s"] = "coalesce(CAST(round(total_time, 3) AS VARCHAR), '')"
    columns["secret"] = "substr(coalesce(details ->> '$.secret', answer, ''), 1, 400)"
    return f"SELECT o_orderkey, {', '.join(f'{x} AS {name}' for name, x in columns.items())} FROM ({_SAMPLE_SQL})"


@query(_rows_sql())
def evaluation_rows(spark, d):
    """Log samples as flat rows of all 25 columns: each from the first place that has it, scores, their details, the sample, the
    store."""
    samples = read(spark, d, "orders").select("o_orderkey", *[F.expr(x).alias(name) for name, x in _SAMPLE.items()])
    return mail.flat_rows(samples, "o_orderkey")


@query("""SELECT event_type AS score, event_id, unnest(['k', 'value']) AS metric, unnest([CAST(json_extract_string(props, '$.k') AS DOUBLE), value]) AS amount FROM events""")
def metric_values(spark, d):
    """Nested metrics as rows; those that are no numbers are left out."""
    e = read(spark, d, "events").select("event_type", "event_id", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("note"), F.lit("none"))).alias("m"))
    return mail.metrics(e, "m").select(F.col("event_type").alias("score"), "event_id", "metric", "amount")


@query("""WITH r AS (SELECT o_custkey, count(*) AS total, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS completed, count(CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 64 = 0 THEN 1 END) AS csv_rows, CASE WHEN min(o_orderkey) % 10 = 0 THEN 'error' ELSE 'success' END AS status FROM orders GROUP BY ALL)
SELECT o_custkey, total, completed, CASE WHEN o_custkey % 7 = 0 AND total <> 10 THEN 'expected 10 samples' WHEN status <> 'success' THEN 'status' WHEN total = 0 OR completed <> total THEN 'incomplete' WHEN csv_rows <> completed THEN 'rows' ELSE '' END AS fault FROM r""")
def run_validation(spark, d):
    """Why a run is not fit for release, empty if it is."""
    done, also = F.col("o_orderstatus") != "P", F.col("o_orderkey") % 64 == 0
    r = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(done | also).alias("csv_rows"), F.when(F.min("o_orderkey") % 10 == 0, "error").otherwise("success").alias("status"))
    expected = F.when(F.col("o_custkey") % 7 == 0, 10)
    return r.select("o_custkey", "total", "completed", mail.run_fault("total", "completed", "csv_rows", "status", expected).alias("fault"))


@query("""SELECT item_id, CAST(least(tries, 6) AS INT) AS tries, tries < 6 AS certified FROM (SELECT item_id, coalesce((SELECT min(i) FROM (SELECT unnest(range(7)) AS i) WHERE ('0x' || substr(sha256((5 + 1000 * i) || ':' || item_id), 1, 2))::INT >= 128), 6) AS tries FROM benchmark)""")
def certify_controls(spark, d):
    """How often a control was drawn anew, with another seed each time, until it was clean; not certified after six."""
    draw = lambda i: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{5 + 1000 * i}:"), F.col("item_id").cast("string")), 256), 1, 2), 16, 10).cast("int")
    tries = F.coalesce(*[F.when(draw(i) >= 128, i) for i in range(6)], F.lit(6))
    return read(spark, d, "benchmark").select("item_id", tries.alias("tries")).withColumn("certified", F.col("tries") < 6)


@query(f"""WITH {_LOG}, {_BOX}, rd AS (SELECT user_id, event_id, b.conv_id FROM log JOIN box b ON n = k WHERE tool = 'READ' AND user_id % 50 = 0),
fm AS (SELECT conv_id, id, text FROM box QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1), ask AS (SELECT event_id AS qid, fm.id AS doc, text FROM rd JOIN fm USING (conv_id)),
q AS (SELECT DISTINCT qid, unnest({_TOKENS}) AS term FROM ask), {_MAIL_SCORES},
shut AS (SELECT DISTINCT a.event_id AS qid, b.id AS doc FROM rd a JOIN rd o ON o.user_id = a.user_id AND o.event_id <= a.event_id JOIN box b ON b.conv_id = o.conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM shut WHERE shut.qid = s.qid AND shut.doc = s.doc))
SELECT qid AS event_id, 'e' || n AS handle, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r JOIN box b ON b.id = r.doc WHERE rank <= 8""")
def read_related(spark, d):
    """What each READ shows beside the chain: the messages most like its first one that the session has not opened by then. Queries:
    the reads of sessions whose number 50 divides, against all messages."""
    box = _box(spark, d)
    reads = _reads(spark, d, box).where("user_id % 50 = 0 and conv_id is not null")
    first = box.groupBy("conv_id").agg(F.min_by("id", "turn").alias("doc"))
    asks = reads.join(first, "conv_id").select(F.col("event_id").alias("qid"), "doc")
    before = reads.select("user_id", F.col("event_id").alias("_at"), "conv_id")
    opened = reads.select("user_id", F.col("event_id").alias("qid")).join(before, "user_id").where("_at <= qid").select("qid", "conv_id").distinct()
    seen = X.opened(opened, box, "qid", "conv_id", "id").select("qid", F.col("id").alias("doc"))
    hits = X.expand(box.select(F.col("id").alias("doc"), T.tokenize("text").alias("tokens")), asks, seen)
    return hits.join(box.select(F.col("id").alias("doc"), "handle"), "doc").select(F.col("qid").alias("event_id"), "handle", F.round("score", 6).alias("score"), "rank")


@query(f"""SELECT min(doc_id) AS doc_id, count(*) AS topics, CAST(len(sig) AS INT) AS words, sha256(array_to_string(sig, ' ')) AS digest
FROM (SELECT doc_id, list_sort(list_distinct({_TOKENS.replace("coalesce(text, '')", "concat_ws(' ', source, text, lang)")})) AS sig FROM documents) GROUP BY sig""")
def topic_signatures(spark, d):
    """Topics that have the same words in their fields are one: the first stays. Here the fields are source, text and language."""
    sig = T.topic_signature("source", "text", "lang")
    g = read(spark, d, "documents").groupBy(sig.alias("sig")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("topics"))
    return g.select("doc_id", "topics", F.size("sig").alias("words"), F.sha2(F.array_join("sig", " "), 256).alias("digest"))
