"""A mailbox over message tables: handles, what its tools show, and archives with borrowed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import records as R
from mailquarry.operators import retrieval as S


def mailbox(messages: DataFrame, thread: str, position: str) -> DataFrame:
    """messages with `handle`, e1, e2, ..., and `thread_handle`, t1, t2, ..., in the order of threads and positions."""
    threads = R.handles(messages.select(thread).distinct().withColumn("_zero", F.lit(0)), thread, "_zero")
    threads = threads.select(F.col(thread).alias("_kt"), F.concat(F.lit("t"), F.substring("handle", 2, 20)).alias("thread_handle"))
    return R.handles(messages, thread, position).join(threads, F.col(thread).eqNullSafe(F.col("_kt"))).drop("_kt")


def number(handle: str) -> Column:
    return F.substring(handle, 2, 20).cast("long")


def stride(threads: DataFrame, at: str, cap: int) -> DataFrame:
    """Of threads numbered from 0 in `at` the int(i * total / cap)-th for i below cap, all if there are no more than cap. Only
    the places are built, cap of them."""
    total = threads.agg(F.count(F.lit(1)).alias("_total"))
    places = total.select("_total", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("_i"))
    places = places.select(F.floor(F.col("_i") * (F.col("_total") / F.lit(float(cap)))).alias(at)).distinct()
    few = threads.crossJoin(F.broadcast(total)).where(F.col("_total") <= cap).drop("_total")
    many = threads.crossJoin(F.broadcast(total)).where(F.col("_total") > cap).drop("_total").join(F.broadcast(places), at, "left_semi")
    return few.unionByName(many)


def chains(box: DataFrame, thread: str, position: str, sender: str, body: str) -> DataFrame:
    """(thread, n, shown): each thread as READ shows it: bodies on one line, 1,500 characters of a single message, 700 of each
    message of a chain."""
    one = F.struct(F.col(position).alias("p"), F.col("handle").alias("h"), F.col(sender).alias("s"), T.oneline(body, 1500).alias("b"))
    g = box.groupBy(thread, "thread_handle").agg(F.array_sort(F.collect_list(one)).alias("m")).withColumn("n", F.size("m"))
    part = lambda m: F.concat(F.lit("\n\n["), m["h"], F.lit("] From: "), m["s"], F.lit("\n"), F.substring(m["b"], F.lit(1), F.when(F.col("n") == 1, 1500).otherwise(700)))
    head = F.concat(F.lit("thread "), "thread_handle", F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " message):").otherwise(" messages):"))
    return g.select(thread, "n", F.concat(head, F.array_join(F.transform("m", part), "")).alias("shown"))


def asked_threads(asks: DataFrame, box: DataFrame, thread: str, asked: str) -> DataFrame:
    """asks with the thread that their handle, of a message or a thread, belongs to; null if there is none."""
    known = box.select(F.col("handle").alias(asked), thread).union(box.select("thread_handle", thread).distinct())
    return asks.join(known, asked, "left")


def opened(reads: DataFrame, box: DataFrame, session: str, thread: str, message: str) -> DataFrame:
    """(session, message) of all messages in threads that a session has read: reading one opens its whole chain."""
    return reads.select(session, thread).where(F.col(thread).isNotNull()).distinct().join(box.select(thread, message), thread).select(session, message)


def expand(docs: DataFrame, asks: DataFrame, seen: DataFrame, k: int = 8) -> DataFrame:
    """(qid, doc, score, rank): for each of asks (qid, doc) the k messages most like that message, without itself and those that
    seen (qid, doc) has."""
    return S.best(docs, asks.join(docs, "doc").select("qid", "tokens"), k, seen.unionByName(asks))


def clue_recall(reads: DataFrame, clues: DataFrame, session: str, thread: str) -> DataFrame:
    """(session, n_clues_total, n_clues_read, clue_recall): by threads. reads (session, thread) has each session, with a null
    thread where it read none; clues (thread) are those that hold a clue."""
    each = clues.select(thread).distinct()
    total = each.agg(F.count(F.lit(1)).alias("n_clues_total"))
    read = reads.select(session, thread).distinct().join(each.withColumn("_clue", F.lit(1)), thread, "left")
    g = read.groupBy(session).agg(F.count("_clue").alias("n_clues_read")).crossJoin(F.broadcast(total))
    return g.select(session, "n_clues_total", "n_clues_read", F.when(F.col("n_clues_total") > 0, F.round(F.col("n_clues_read") / F.col("n_clues_total"), 3)).alias("clue_recall"))


def like_any(rows: DataFrame, accepted: DataFrame, least: float) -> DataFrame:
    """(id, duplicate) of each of rows (id, toks): whether its set is empty or has that similarity with a set of accepted (id,
    toks). Sets meet on their first tokens in the order of rarity among the accepted, as many as must share one."""
    df = accepted.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def prefix(sets, name):
        each = sets.select(F.col("id").alias(name), F.explode("toks").alias("t")).join(df, "t", "left")
        g = each.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("r"))
        return g.select(name, F.explode(F.slice("r", F.lit(1), (F.size("r") - F.ceil(least * F.size("r")) + 1).cast("int"))).alias("x")).select(name, F.col("x.t").alias("t"))

    pairs = prefix(rows, "a").join(prefix(accepted, "b"), "t").select("a", "b").distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("toks").alias("x")), "a").join(accepted.select(F.col("id").alias("b"), F.col("toks").alias("y")), "b")
    hits = both.where(T.jaccard(F.col("x"), F.col("y")) >= least).select(F.col("a").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, "id", "left").select("id", ((F.size("toks") == 0) | F.coalesce("_hit", F.lit(False))).alias("duplicate"))


def full_haystack(clues: DataFrame, corpus: DataFrame, cluster: DataFrame, excluded: DataFrame, noise: int, seed: int, short_ok: bool = False) -> DataFrame:
    """(case, place, thread, position, message_id, in_reply_to, clue): each case's archive, by date.

    clues (case, thread, position, message_id, in_reply_to, date) and corpus (thread, position, message_id, date) are messages.
    The threads of cluster (case, thread) and excluded (thread) stay out. Clue messages borrow real ids: those of the cluster
    first, then those of whole threads that are pulled from the pool, which leave it; replies are linked anew. A thread without
    ids has none to lend and stays in the pool. Too few ids are an error, and so are too few threads of noise unless short_ok.
    The pool is one seeded order of the corpus without the excluded threads, of which only as many threads are met with a case
    as it may need: the first ones, and the first of those that can lend."""
    h = lambda c: R.hash_order(c, seed)
    own = clues.select("case", "thread").distinct()
    shut = cluster.select("case", "thread").union(own).distinct()
    need = clues.groupBy("case").agg(F.count(F.lit(1)).alias("need"))
    most = shut.groupBy("case").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("m")).first()["m"]
    wanted = need.agg(F.coalesce(F.max("need"), F.lit(0)).alias("m")).first()["m"]
    sizes = corpus.join(excluded.select("thread"), "thread", "left_anti").groupBy("thread").agg(F.count("message_id").alias("n"))
    ordered = lambda x: x.orderBy(h(F.col("thread")), "thread")
    pool = ordered(sizes).limit(noise + int(most) + int(wanted)).union(ordered(sizes.where("n > 0")).limit(int(most) + int(wanted))).distinct()
    from_cluster = cluster.join(corpus, "thread").where("message_id is not null")
    nth = F.row_number().over(Window.partitionBy("case").orderBy(h(F.col("message_id")), "message_id"))
    lent = from_cluster.withColumn("k", nth).join(need, "case").where("k <= need").select("case", "k", "message_id")
    short = need.join(lent.groupBy("case").agg(F.count(F.lit(1)).alias("have")), "case", "left").select("case", "need", F.coalesce("have", F.lit(0)).alias("have"))
    w = Window.partitionBy("case").orderBy(h(F.col("thread")), "thread")
    may = short.crossJoin(pool).join(shut, ["case", "thread"], "left_anti").withColumn("before", F.sum("n").over(w) - F.col("n"))
    may = may.withColumn("pulled", (F.col("n") > 0) & (F.col("before") < F.col("need") - F.col("have")))
    more = may.where("pulled").join(corpus.where("message_id is not null"), "thread")
    nth = F.row_number().over(Window.partitionBy("case").orderBy("before", h(F.col("thread")), "thread", "position")) + F.col("have")
    lent = lent.union(more.select("case", nth.alias("k"), "message_id"))
    nth = F.row_number().over(Window.partitionBy("case").orderBy("thread", "position"))
    given = clues.withColumn("k", nth).join(lent.withColumnRenamed("message_id", "new"), ["case", "k"], "left")
    given = given.withColumn("new", F.coalesce("new", F.raise_error(F.concat(F.lit("the corpus is too small to borrow ids for case "), F.col("case").cast("string")))))
    links = given.select("case", F.col("message_id").alias("in_reply_to"), F.col("new").alias("to"))
    given = given.join(links, ["case", "in_reply_to"], "left")
    clue_rows = given.select("case", "thread", "position", F.col("new").alias("message_id"), F.coalesce("to", "in_reply_to").alias("in_reply_to"), "date", F.lit(True).alias("clue"))
    nth = F.row_number().over(w)
    kept = may.where("not pulled").withColumn("k", nth).where(F.col("k") <= noise).select("case", "thread")
    if not short_ok:
        there = need.join(kept.groupBy("case").agg(F.count(F.lit(1)).alias("there")), "case", "left").select("case", F.coalesce("there", F.lit(0)).alias("there"))
        lack = F.raise_error(F.concat(F.lit("the corpus is too small for the noise of case "), F.col("case").cast("string")))
        clue_rows = clue_rows.join(there, "case").withColumn("clue", F.when(F.col("there") < noise, lack.cast("boolean")).otherwise(F.col("clue"))).drop("there")
    noise_rows = kept.join(corpus, "thread").select("case", "thread", "position", "message_id", F.lit(None).cast("string").alias("in_reply_to"), "date", F.lit(False).alias("clue"))
    both = clue_rows.union(noise_rows)
    first = F.min("date").over(Window.partitionBy("case", "thread"))
    place = F.row_number().over(Window.partitionBy("case").orderBy("first", "thread", "position"))
    return both.withColumn("first", first).withColumn("place", place).select("case", "place", "thread", "position", "message_id", "in_reply_to", "clue")


def event_cluster(anchors: DataFrame, related: DataFrame, corpus: DataFrame) -> DataFrame:
    """(case, thread): the threads that tell of a case: its anchor's own and those of related messages. anchors and related
    (case, id), corpus (thread, id)."""
    return anchors.select("case", "id").union(related.select("case", "id")).join(corpus.select("thread", "id"), "id").select("case", "thread").distinct()


def realized(text: Column, marks: list[str], bank: list[str], key: Column) -> Column:
    """The text with each mark by an entry of the bank, chosen by a hash of key and mark, that any engine repeats."""
    for m in marks:
        at = F.conv(F.substring(F.sha2(F.concat_ws(":", key.cast("string"), F.lit(m)), 256), 1, 7), 16, 10).cast("int") % len(bank) + 1
        text = F.replace(text, F.lit(m), F.element_at(F.array(*map(F.lit, bank)), at))
    return text


def dump(messages: DataFrame, group: str, position: str, shown: Column, most: int) -> DataFrame:
    """(group, text): each group's messages in order, cut at `most` characters. Messages behind the cut are dropped before any
    list is made, by running sums."""
    w = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = messages.select(group, position, shown.alias("_s")).withColumn("_upto", F.sum(F.length("_s") + 2).over(w))
    kept = m.where(F.col("_upto") - F.length("_s") - 4 < most)  # the blank line before it may still show
    g = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(position, "_s"))).alias("m"))
    return g.select(group, F.substring(F.array_join(F.transform("m", lambda x: x["_s"]), "\n\n"), 1, most).alias("text"))
