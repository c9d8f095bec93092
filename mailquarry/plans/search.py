"""Queries of search, text and records, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import blocks as P
from mailquarry.operators import records as R
from mailquarry.operators import retrieval as S
from mailquarry.shared import bound_batches

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if the scan has fewer: one small file would keep all but one idle. Large
    inputs have more and are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')"
_TOKENS = f"list_filter({_WORDS}, lambda x: x NOT IN ({_STOP}))"
_SPACE = "regexp_replace({}, '[ \\t\\r\\n\\f]+', ' ', 'g')"


def planted(labels, k, marks=(". ", ", ")):
    """Whole texts with labels behind their full stops and commas: what is planted (k = 0), or what becomes of it (k = 1)."""
    c = F.col("text")
    for i, mark in enumerate(marks):
        label = F.element_at(F.array(*[F.lit(x[k]) for x in labels]), ((F.col("doc_id") + i) % len(labels) + 1).cast("int"))
        c = F.replace(c, F.lit(mark), F.concat(F.lit(mark), label))
    return c


def planted_sql(labels, k, marks=(". ", ", "), text="text"):
    for i, mark in enumerate(marks):
        names = ", ".join("'" + x[k].replace("'", "''") + "'" for x in labels)
        text = f"replace({text}, '{mark}', '{mark}' || [{names}][(doc_id + {i}) % {len(labels)} + 1])"
    return text


def _docs(spark, d):
    return spread(read(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("doc"), T.tokenize("text").alias("tokens"))


def _kin_docs(spark, d):
    """Documents that are searched by documents: those of a language share their frequent words, so they are packed together."""
    rows = spread(read(spark, d, "documents").select("doc_id", "lang", "text"))
    return rows.select(F.col("doc_id").alias("doc"), F.col("lang").alias("kin"), T.tokenize("text").alias("tokens"))


def _asks(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.tokenize("text").alias("tokens"))


def _token_sets(spark, d):
    rows = spread(read(spark, d, "documents").select("doc_id", "text"))
    return rows.select(F.col("doc_id").alias("id"), F.array_distinct(T.tokenize("text")).alias("toks"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE n_chars >= 25 GROUP BY ALL")
def scan_documents(spark, d):
    return read(spark, d, "documents").where("n_chars >= 25").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT d.doc_id, d.lang, coalesce(CASE WHEN l.quality = 1 THEN 'KEPT' WHEN l.quality = 0 THEN 'DROP' END, 'KEPT') AS status FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = 1")
def status_filter(spark, d):
    status = F.when(F.col("quality") == 1, "KEPT").when(F.col("quality") == 0, "DROP")
    joined = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").withColumn("status", F.coalesce(status, F.lit("KEPT")))
    return joined.where("status = 'KEPT'").select("doc_id", "lang", "status")


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n, sha256(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def tokenize_docs(spark, d):
    t = T.tokenize("text")
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def term_stats(spark, d):
    return P.term_counts(_docs(spark, d))


_SCORES = f"""
d AS (SELECT doc_id AS doc, {_TOKENS} AS tokens FROM documents),
stats AS (SELECT count(*) AS docs, avg(len(tokens)) AS avgdl FROM d),
p AS (SELECT term, doc, dl, count(*) AS f FROM (SELECT doc, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM p GROUP BY term),
w AS (SELECT term, doc, ln(1 + (docs - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM p JOIN df USING (term), stats),
s AS (SELECT qid, doc, sum(w) AS score FROM q JOIN w USING (term) GROUP BY ALL)"""
_Q = f"q AS (SELECT DISTINCT item_id AS qid, unnest({_TOKENS}) AS term FROM benchmark),"
_TOP = "r AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE score > 0)"


@query(f"WITH {_Q}{_SCORES},{_TOP} SELECT qid, doc, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 12")
def bm25_topk(spark, d):
    return S.best(_docs(spark, d), _asks(spark, d), 12).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"WITH q AS (SELECT DISTINCT doc_id AS qid, unnest({_TOKENS}) AS term FROM documents WHERE doc_id % 50 = 0),{_SCORES},"
       "r AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE score > 0 AND qid <> doc) SELECT qid, doc, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8")  # fmt: skip
def bm25_by_document(spark, d):
    """Queries: the rows whose id 50 divides, against all."""
    docs = _kin_docs(spark, d)
    return S.by_document(docs, docs.where("doc % 50 = 0"), 8).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_Q}{_SCORES},{_TOP}, b AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM r WHERE rank <= 20) SELECT qid, doc, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM b WHERE score >= 2.0 AND score >= 0.15 * best")
def relevance_floor_cluster(spark, d):
    return S.related(S.best(_docs(spark, d), _asks(spark, d), 20)).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_Q}{_SCORES},{_TOP},
f AS (SELECT qid // 4 AS gid, doc, sum(1.0::DOUBLE / (60 + rank)) AS score, min(qid) AS q, min(rank) AS r FROM r WHERE rank <= 60 GROUP BY ALL),
o AS (SELECT gid, doc, score, row_number() OVER (PARTITION BY gid ORDER BY round(score, 9) DESC, q, r, doc) AS rank FROM f)
SELECT gid, doc, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM o WHERE rank <= 30""")
def rrf_fusion(spark, d):
    lists = S.best(_docs(spark, d), _asks(spark, d), 60).withColumn("gid", F.floor(F.col("qid") / 4))
    return S.reciprocal_ranks(lists).select("gid", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_Q}{_SCORES},{_TOP},
o AS (SELECT qid, doc, rank, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN doc % 3 > 0 THEN doc % 97 END DESC NULLS LAST, rank) AS shown FROM r WHERE rank <= 40)
SELECT qid, doc, CAST(rank AS INT) AS rank, CAST(shown AS INT) AS shown FROM o WHERE shown <= 8""")
def rerank_fixed(spark, d):
    pool = S.best(_docs(spark, d), _asks(spark, d), 40)
    return S.rerank(pool, F.when(F.col("doc") % 3 > 0, F.col("doc") % 97)).select("qid", "doc", "rank", "shown")


@query(f"""WITH {_Q}d AS (SELECT doc_id AS doc, {_TOKENS} AS tokens FROM documents),
e AS (SELECT doc, len(tokens) AS dl, unnest(tokens) AS term FROM d), tf AS (SELECT doc, dl, term, count(*) AS c FROM e GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY term HAVING count(*) >= 2),
x AS (SELECT doc, term, c::DOUBLE / dl * ln((SELECT count(*) FROM d)::DOUBLE / n) AS x FROM tf JOIN df USING (term)),
nn AS (SELECT doc, sqrt(sum(x * x)) + 1e-9 AS norm FROM x GROUP BY doc)
SELECT doc, count(*) AS terms, round(sum(x / norm), 6) AS mass FROM x JOIN nn USING (doc) GROUP BY doc""")
def tfidf_cosine(spark, d):
    return S.tfidf(_docs(spark, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("w"), 6).alias("mass"))


# ---- text


def _duck_rules(rules, column):
    out = column
    for p, r in rules:
        flags = "gi" if p.startswith("(?i)") else "g"
        q = p.removeprefix("(?i)").replace("'", "''")
        out = f"regexp_replace({out}, '{q}', '{r}', '{flags}')"
    return out


_ROUTING = "\\b/?(HOU|ECT|NA|LON|Corp)\\b(/\\w+)*"
_CLEAN = f"trim({_duck_rules([(_ROUTING if p == '{routing}' else p, r) for p, r in T.BODY_RULES], '{0}')})"
# accented letters make \b and \w differ between engines, so these queries fold text to ASCII first
_ASCII = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', 'x', 'g')"


@query(f"SELECT conv_id, turn, sha256(b) AS body_sha256, CAST(length(b) AS BIGINT) AS chars FROM (SELECT conv_id, turn, {_CLEAN.replace('{0}', _ASCII)} AS b FROM conversations) WHERE length(b) >= 25")
def clean_body(spark, d):
    b = T.clean_body(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F]", "x"))
    return read(spark, d, "conversations").select("conv_id", "turn", b.alias("b")).where("length(b) >= 25").select("conv_id", "turn", F.sha2("b", 256).alias("body_sha256"), F.length("b").cast("long").alias("chars"))


_SCRUB = [("(?i)\\bthonon line\\b", "[platform]"), ("\\bTion\\b", "[firm]"), ("(?i)\\bthe ering\\b", "[firm]"), ("(?i)\\bth(e|a) firm\\b", "[firm]"), ("\\bIn\\b", "[desk]")]


@query(f"SELECT conv_id, turn, sha256({_duck_rules(_SCRUB, _ASCII)}) AS scrubbed_sha256 FROM conversations")
def scrub_terms(spark, d):
    t = T.replace_all(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F]", "x"), _SCRUB)
    return read(spark, d, "conversations").select("conv_id", "turn", F.sha2(t, 256).alias("scrubbed_sha256"))


_PEOPLE = [("Customer#000000001", "", "Ada Reed", ""), ("Erin Thon", "erin@a.example", "Bo Lund", "bo@b.example")]
_SUBS = T.substitutions(_PEOPLE, [("@a.example", "@b.example")], [("Of", "Oz"), ("Th", "Qu")])
_DUCK_SUBS = [(p.replace("\\Q", "").replace("\\E", "").replace("#", "[#]"), r) for p, r in _SUBS]


@query(f"SELECT conv_id, turn, sha256({_duck_rules(_DUCK_SUBS, _ASCII)}) AS digest FROM conversations")
def anonymize_ordered(spark, d):
    t = T.replace_all(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F]", "x"), _SUBS)
    return read(spark, d, "conversations").select("conv_id", "turn", F.sha2(t, 256).alias("digest"))


@query("SELECT o_orderkey, CASE WHEN CAST(y AS INT) BETWEEN 1999 AND 2002 THEN s ELSE '2001' || substr(s, 5) END AS date FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s, strftime(o_orderdate, '%Y') AS y FROM orders)")
def era_clamp(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.clamp_era(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))


@query(f"SELECT doc_id, substr(trim({_SPACE.format('text')}), 1, 280) AS snippet FROM documents")
def oneline_snippet(spark, d):
    return read(spark, d, "documents").select("doc_id", T.oneline("text", 280).alias("snippet"))


@query("""SELECT doc_id FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents)
WHERE len(list_filter(regexp_split_to_array(s, '[ \\t\\r\\n\\f]+'), lambda x: x <> '')) BETWEEN 25 AND 140
AND len(regexp_extract_all(s, '\\t')) <= 2 AND len(regexp_extract_all(s, '=')) <= 3
AND NOT (len(regexp_extract_all(s, '[A-Za-z]')) > 0 AND len(regexp_extract_all(s, '[A-Z]'))::DOUBLE / greatest(len(regexp_extract_all(s, '[A-Za-z]')), 1) > 0.4)
AND contains(s, '.') AND regexp_matches(s, '[a-z]')""")
def clean_prose_filter(spark, d):
    return read(spark, d, "documents").where(T.is_clean_prose("text")).select("doc_id")


_ACKS = "WITH s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Thank you' || chr(10) || 'Ada Reed' WHEN 1 THEN 'Thanks, noted. ' || text WHEN 2 THEN 'Got it ' || chr(10) || chr(10) || substr(text, 1, 30) WHEN 3 THEN chr(9) || 'Received and   filed.' || chr(13) || chr(10) || upper(substr(source, 1, 1)) || lower(substr(source, 2)) WHEN 4 THEN 'Noted noted, noted' ELSE text END AS said FROM documents), "
_ACKS += "l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(said, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\r\\f]', ' ', 'g'))), lambda x: x <> '') AS lines FROM s), "
_ACKS += f"k AS (SELECT doc_id, CASE WHEN len(lines) >= 2 AND regexp_matches(lines[-1], '{T.BARE_NAME}') AND NOT regexp_matches(lines[-1], '{T.RECEIPT_START}') THEN lines[1:len(lines) - 1] ELSE lines END AS kept FROM l), "
_ACKS += "n AS (SELECT doc_id, len(kept) AS n, trim(regexp_replace(array_to_string(kept, ' '), '[ \\t]{2,}', ' ', 'g')) AS line FROM k), w AS (SELECT *, regexp_extract_all(lower(line), '[a-z]+') AS words FROM n) "
_ACKS += f"SELECT doc_id, line FROM w WHERE n BETWEEN 1 AND 2 AND regexp_matches(line, '{T.RECEIPT_START}') AND NOT regexp_matches(line, '{T.RECEIPT_DROP}') AND NOT regexp_matches(line, '(?i)http|@|www\\.') AND NOT regexp_matches(line, '[0-9]') AND length(line) BETWEEN 6 AND 40 "
_ACKS += f"AND len(words) > 0 AND len(list_filter(words, lambda x: x NOT IN ({', '.join(repr(x) for x in sorted(set(T.RECEIPT_WORDS)))}))) = 0 AND len(list_filter(words, lambda x: len(list_filter(words, lambda y: y = x)) >= 3)) = 0"


@query(_ACKS)
def ack_mining(spark, d):
    """Receipts among whole bodies: real texts, some behind a receipt's start, and some receipts."""
    k, text = F.col("doc_id") % 6, F.col("text")
    signed = F.concat(F.upper(F.substring("source", 1, 1)), F.lower(F.substring("source", 2, 1 << 20)))
    said = F.when(k == 0, "Thank you\nAda Reed").when(k == 1, F.concat(F.lit("Thanks, noted. "), text)).when(k == 2, F.concat(F.lit("Got it \n\n"), F.substring(text, 1, 30)))
    said = said.when(k == 3, F.concat(F.lit("\tReceived and   filed.\r\n"), signed)).when(k == 4, "Noted noted, noted").otherwise(text)
    return read(spark, d, "documents").select("doc_id", T.receipt(said).alias("line")).where("line is not null")


@query("SELECT n_nationkey, 'Dear ' || n_name || ' of ' || r_name || ', ' || n_name || '.' AS body FROM nation JOIN region ON n_regionkey = r_regionkey")
def template_fill(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", T.fill(F.lit("Dear <<WHO>>, <<NAME>>."), {"WHO": F.concat(F.lit("<<NAME>> of "), "r_name"), "NAME": F.col("n_name")}).alias("body"))


_NAMED = [("Quilla Vorst met ", "Person A met "), ("Quilla Stone met Jyx then ", "Quilla Stone met Person B then "), ("Quilla, Vorst Jyx Zwick said ", "Person A, Person A Person B said "), ("Old Vorst and Vorst went ", "Old Vorst and Person A went ")]


@query(f"SELECT doc_id, {planted_sql(_NAMED, 1)} AS body FROM documents")
def relabel_lookahead(spark, d):
    """Whole texts with names planted in them, and labels put in their places."""
    return read(spark, d, "documents").select("doc_id", T.relabel(planted(_NAMED, 0), [("Quilla Vorst", "Person A"), ("Jyx Zwick", "Person B")]).alias("body"))


# ---- records


_SIG = "trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {_SIG}")
def signature_dedup(spark, d):
    """Documents of one text in small letters and single spaces, by a hash of all of it."""
    return read(spark, d, "documents").groupBy(F.sha2(R.signature("text", None), 256).alias("s")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("s")


@query(f"""WITH s AS (SELECT min(doc_id) AS id, toks FROM (SELECT doc_id, list_sort(list_distinct({_TOKENS})) AS toks FROM documents) WHERE len(toks) > 0 GROUP BY toks),
e AS (SELECT id, unnest(toks) AS t FROM s), p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(shared::DOUBLE / (len(s1.toks) + len(s2.toks) - shared), 6) AS jaccard FROM p JOIN s s1 ON s1.id = a JOIN s s2 ON s2.id = b
WHERE shared::DOUBLE / (len(s1.toks) + len(s2.toks) - shared) >= 0.8""")
def jaccard_pairs(spark, d):
    return R.similar_sets(_token_sets(spark, d), 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY toks) AS class_id FROM (SELECT doc_id, list_sort(list_distinct({_TOKENS})) AS toks FROM documents) WHERE len(toks) > 0""")
def jaccard_members(spark, d):
    """The documents that each id of jaccard_pairs stands for."""
    return R.set_classes(_token_sets(spark, d)).select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"))


@query("""WITH c AS (SELECT conv_id, CAST(least(count(*), 4) AS INT) AS n FROM conversations GROUP BY conv_id), m AS (SELECT conv_id, n, unnest(range(1, (1 << n) - 1)) AS mask FROM c WHERE n >= 2)
SELECT conv_id, n, CAST(mask AS INT) AS mask, CAST(bit_count(CAST(mask AS INT)) AS INT) AS size, array_to_string(list_filter(range(1, n + 1), lambda i: (mask >> (i - 1)) & 1 = 1), ',') AS members FROM m""")
def subset_enumeration(spark, d):
    """The proper subsets of the two to four clues of every conversation, as many as it has turns and four at most."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.least(F.count(F.lit(1)), F.lit(4)).cast("int").alias("n"))
    subsets = F.when(F.col("n") == 2, R.proper_subsets(2)).when(F.col("n") == 3, R.proper_subsets(3)).otherwise(R.proper_subsets(4))
    masks = c.where("n >= 2").select("conv_id", "n", F.explode(subsets).alias("mask"))
    return masks.select("conv_id", "n", "mask", F.bit_count("mask").alias("size"), F.array_join(F.transform(R.members(F.col("mask")), lambda i: i.cast("string")), ",").alias("members"))


@query(f"""WITH c AS (SELECT doc_id, {_TOKENS} AS have FROM documents), b AS (SELECT item_id, list_filter({_TOKENS}, lambda x: x NOT IN ({", ".join(f"'{w}'" for w in T.CARRIER_STOPWORDS)}) AND length(x) > 2) AS w FROM benchmark),
p AS (SELECT doc_id, item_id, w, list_filter(w, lambda x: NOT list_contains(have, x)) AS absent FROM c JOIN b ON doc_id % (SELECT count(*) FROM benchmark) = item_id)
SELECT doc_id, item_id, CAST(len(absent) AS INT) AS absent, len(w) > 0 AND len(absent) <= 0.5 * len(w) AS ok FROM p""")
def carrier_presence(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.col("text").alias("carrier"))
    n = b.agg(F.count(F.lit(1)).alias("n"))
    p = read(spark, d, "documents").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(b, "item_id")
    return p.select("doc_id", "item_id", F.size(T.absent_words("carrier", "text")).alias("absent"), T.carrier_absent("carrier", "text").isNull().alias("ok"))


@query("SELECT c_custkey, coalesce(n.status, o.status) AS status FROM (SELECT c_custkey, 'old' AS status FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN (SELECT c_custkey, 'new' AS status FROM customer WHERE c_custkey % 3 = 0) n USING (c_custkey)")
def keyed_upsert(spark, d):
    c = read(spark, d, "customer").select("c_custkey")
    return R.upsert(c.where("c_custkey % 2 = 0").withColumn("status", F.lit("old")), c.where("c_custkey % 3 = 0").withColumn("status", F.lit("new")), ["c_custkey"])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_row(spark, d):
    return R.latest(read(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def noise_pool_anti(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    toxic = read(spark, d, "labels").where("toxic = 1").select("doc_id")
    planted = R.holding(docs, read(spark, d, "benchmark").select(F.col("text").alias("passage")))
    return docs.select("doc_id").join(toxic, "doc_id", "left_anti").join(planted, "doc_id", "left_anti")


@query("SELECT doc_id FROM documents ORDER BY sha256('20260624:' || doc_id), doc_id LIMIT 200")
def hash_sample_haystack(spark, d):
    return R.sample(read(spark, d, "documents").select("doc_id"), "doc_id", 200, 20260624)


@query("""WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark), b AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS k FROM documents)
SELECT item_id, doc_id AS borrowed FROM a JOIN b USING (k)""")
def borrow_ids(spark, d):
    items = R.numbered(read(spark, d, "benchmark").select("item_id"), ["item_id"], F.floor(F.col("item_id") / 65536), "k")
    pool = read(spark, d, "documents").select(F.col("doc_id").alias("borrowed")).withColumn("h", R.hash_order(F.col("borrowed"), 7))
    pool = R.numbered(pool, ["h", "borrowed"], F.substring("h", 1, 3), "k")
    return items.join(pool, "k").select("item_id", "borrowed")


@query("SELECT conv_id, turn, 'e' || row_number() OVER (ORDER BY conv_id, turn) AS handle FROM conversations")
def assign_handles(spark, d):
    return R.handles(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn").select("conv_id", "turn", "handle")


@query("SELECT conv_id, turn, lag(conv_id || '-' || turn) OVER w AS in_reply_to, printf('T%02d:00:00', 9 + 4 * (row_number() OVER w - 1)) AS clock FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def reply_chain_lag(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"))
    return c.select("conv_id", "turn", F.lag("id").over(w).alias("in_reply_to"), F.format_string("T%02d:00:00", 9 + 4 * (F.row_number().over(w) - 1)).alias("clock"))


@query(f"""SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn, array_to_string(list_sort(list_distinct(list(role))), ', ') AS participants,
max_by(substr(trim({_SPACE.format('text')}), 1, 70), -turn) AS subject FROM conversations GROUP BY conv_id""")
def thread_card(spark, d):
    c = read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("participants"), F.min_by(T.oneline("text", 70), "turn").alias("subject"))


@query("WITH t AS (SELECT DISTINCT conv_id FROM conversations), o AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('3:' || conv_id), conv_id) AS n FROM t) SELECT conv_id, CAST((n - 1) // 50 AS BIGINT) AS segment FROM o")
def segment_pages(spark, d):
    t = read(spark, d, "conversations").select("conv_id").distinct().withColumn("h", R.hash_order(F.col("conv_id"), 3)).withColumn("b", F.substring("h", 1, 2))
    base = t.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("base"))
    n = F.row_number().over(Window.partitionBy("b").orderBy("h", "conv_id")) - 1
    return t.withColumn("n", n).join(base, "b").select("conv_id", F.floor((F.col("base") + F.col("n")) / 50).alias("segment"))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY lang) AS total, lang FROM documents)
SELECT lang, doc_id FROM o WHERE (n - 1) % greatest(1, total // 25) = 0 AND (n - 1) // greatest(1, total // 25) < 25""")
def stride_sample(spark, d):
    o = R.numbered(read(spark, d, "documents").select("lang", "doc_id"), ["doc_id"], F.floor(F.col("doc_id") / 65536), "n", ("lang",))
    total = o.groupBy(F.col("lang").alias("of")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 25)).alias("step"))
    o = o.join(total, F.col("lang").eqNullSafe(F.col("of"))).withColumn("n", F.col("n") - 1)
    return o.where("n % step = 0 and floor(n / step) < 25").select("lang", "doc_id")


@query("SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 5")
def balanced_quota(spark, d):
    n = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return read(spark, d, "documents").select("source", "lang", "doc_id").withColumn("n", n).where("n <= 5").drop("n")


@query("WITH o AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS total FROM benchmark) SELECT item_id, 0 AS control FROM benchmark UNION ALL SELECT item_id, 1 FROM o WHERE n % greatest(1, total // 10) = 0 AND n // greatest(1, total // 10) < 10")
def paired_controls(spark, d):
    b = read(spark, d, "benchmark").select("item_id")
    step = b.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("step"))
    o = R.numbered(b, ["item_id"], F.floor(F.col("item_id") / 65536), "n").withColumn("n", F.col("n") - 1).crossJoin(F.broadcast(step)).where("n % step = 0 and floor(n / step) < 10")
    return b.withColumn("control", F.lit(0)).union(o.select("item_id", F.lit(1)))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS size, role = 'system' AS must, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS kept FROM t WHERE k = 1
UNION ALL SELECT f.conv_id, t.k, CASE WHEN t.must OR used + t.size <= 1200 THEN used + t.size ELSE used END, CASE WHEN t.must OR used + t.size <= 1200 THEN list_append(kept, t.turn) ELSE kept END
FROM f JOIN t ON f.conv_id = t.conv_id AND t.k = f.k + 1)
SELECT conv_id, array_to_string(kept, ',') AS kept FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1""")
def fit_budget_greedy(spark, d):
    item = F.struct(F.col("turn").alias("pos"), F.length("text").cast("long").alias("size"), (F.col("role") == "system").alias("must"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return c.select("conv_id", F.array_join(F.transform(R.fit_budget(F.col("items"), 1200), lambda x: x.cast("string")), ",").alias("kept"))
