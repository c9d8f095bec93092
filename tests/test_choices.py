"""The stored index, choices in order, archives and mailboxes, against plain sequences."""

import random

import pytest

from mailquarry.operators import choices as C
from mailquarry.operators import index as I
from mailquarry.operators import mailbox as X
from mailquarry.operators import retrieval as S
from mailquarry.shared import scratch


def made_docs(seed, n, at=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(at + i, rnd.choices(words, weights, k=rnd.choice([0, 1, 3, 8, 40]))) for i in range(n)]


@pytest.mark.parametrize("light", [0.5, 1.0])
def test_index_search_reads_what_matters_and_gives_all(spark, monkeypatch, light):
    monkeypatch.setattr(I, "BLOCK", 4)
    schema, rnd = "doc long, tokens array<string>", random.Random(3)
    first, more = (spark.createDataFrame(made_docs(s, n, at), schema) for s, n, at in ((1, 250, 0), (2, 90, 1000)))
    index = I.build(first, scratch(spark, "index"))
    asks = spark.createDataFrame([(q, [f"w{rnd.randrange(70)}" for _ in range(rnd.choice([0, 1, 2, 5, 12]))]) for q in range(25)], "qid long, tokens array<string>")
    want = lambda docs, asks, k: sorted((r.qid, r["rank"], r.doc, round(r.score, 6)) for r in S.top_k(S.bm25_scores(docs, asks), k).collect())
    got = lambda k, **how: sorted((r.qid, r["rank"], r.doc, round(r.score, 6)) for r in I.search(index, asks, k, light=light, **how).collect())
    before = index.table("blocks").inputFiles()
    I.add(index, more)
    assert set(before) < set(index.table("blocks").inputFiles())
    docs = first.union(more)
    assert got(5) == want(docs, asks, 5)
    assert sorted((r.qid, r["rank"], r.doc, round(r.score, 6)) for r in S.top_k(I.scores(index, asks), 5).collect()) == want(docs, asks, 5)
    own = docs.where("doc % 50 = 0").selectExpr("doc AS qid", "tokens")
    found = sorted((r.qid, r["rank"], r.doc) for r in I.search(index, own, 4, light=light, apart=True).collect())
    assert found == sorted((r.qid, r["rank"], r.doc) for r in S.by_document(docs, docs.where("doc % 50 = 0"), 4).collect())


def test_a_segment_counts_once_it_is_whole(spark):
    docs = spark.createDataFrame(made_docs(5, 30), "doc long, tokens array<string>")
    index = I.build(docs, scratch(spark, "index"))
    index.table("blocks").withColumn("segment", S.F.lit("broken")).write.mode("append").partitionBy("segment").parquet(f"{index.folder}/blocks")
    asks = spark.createDataFrame([(1, ["w0", "w1"])], "qid long, tokens array<string>")
    assert [(r.doc, r["rank"]) for r in I.search(index, asks, 5).collect()] == [(r.doc, r["rank"]) for r in S.top_k(S.bm25_scores(docs, asks), 5).collect()]
    empty = I.build(docs.limit(0), scratch(spark, "index"))
    assert I.search(empty, asks, 5).collect() == []


def test_acceptance_is_that_of_the_sequence(spark):
    rnd = random.Random(7)
    for quota, least in ((4, 0.3), (1000, 0.5)):
        topics = [(rnd.randrange(3), i, sorted({rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 6))})) for i in range(150)]
        topics += [(9, 1000 + i, [f"x{i}", f"x{i + 1}"]) for i in range(12)]  # a chain: each waits for the one before
        want = []
        for c in (0, 1, 2, 9):
            kept = []
            for k, i, toks in topics:
                if k == c and toks and len(kept) < quota and all(len({*t} & {*toks}) / len({*t} | {*toks}) < least for _, t in kept):
                    kept.append((i, toks))
            want += [(c, i) for i, _ in kept]
        got = C.accepted(spark.createDataFrame(topics, "category int, id long, toks array<string>"), quota, least)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_choices_are_those_of_the_sequence(spark):
    rnd = random.Random(11)
    wishes = [(w, x, p) for w in range(60) for p, x in enumerate(rnd.sample(range(40), rnd.randint(1, 5)), 1)]
    wishes += [(100 + i, 500 + j, j + 1) for i in range(8) for j in range(6)]  # all want the same
    used, hard, soft = set(), [], []
    for w in sorted({w for w, _, _ in wishes}):
        own = sorted((p, x) for v, x, p in wishes if v == w)
        free = next(((x, p) for p, x in own if x not in used), None)
        if free:
            used.add(free[0])
            hard.append((w, *free, True))
        soft.append((w, *free, True) if free else (w, own[0][1], own[0][0], False))
    df = spark.createDataFrame(wishes, "who int, what int, place int")
    assert sorted(map(tuple, C.first_choices(df).collect())) == hard
    assert sorted(map(tuple, C.first_choices(df, soft=True).collect())) == soft and len(hard) < len(soft)


@pytest.mark.parametrize("noise", [5, 10])
def test_threads_without_ids_lend_none_and_stay_noise(spark, noise):
    corpus = spark.createDataFrame([(t, p, f"m{t}-{p}" if t % 2 else None, f"2001-{t:02d}") for t in range(40) for p in range(2)], "thread int, position int, message_id string, date string")
    clues = spark.createDataFrame([(1, -1, p, f"c{p}", None, "2000") for p in range(6)], "case int, thread int, position int, message_id string, in_reply_to string, date string")
    cluster, excluded = spark.createDataFrame([(1, 2)], "case int, thread int"), spark.createDataFrame([(t,) for t in (4, 5, 6)], "thread int")
    rows = X.full_haystack(clues, corpus, cluster, excluded, noise, 1).collect()
    shown = {r.thread for r in rows if not r.clue}
    lent = {r.message_id for r in rows if r.clue}
    assert len(shown) == noise and not shown & {2, 4, 5, 6} and len(lent) == 6
    assert not {int(m[1:].split("-")[0]) for m in lent} & (shown | {4, 5, 6})


def test_too_little_noise_is_an_error_unless_allowed(spark):
    corpus = spark.createDataFrame([(t, 0, f"m{t}", "2001") for t in range(6)], "thread int, position int, message_id string, date string")
    clues = spark.createDataFrame([(1, -1, 0, "c", None, "2000")], "case int, thread int, position int, message_id string, in_reply_to string, date string")
    none = spark.createDataFrame([], "case int, thread int")
    with pytest.raises(Exception, match="too small for the noise"):
        X.full_haystack(clues, corpus, none, none, 9, 1).collect()
    assert len(X.full_haystack(clues, corpus, none, none, 9, 1, short_ok=True).collect()) == 6


def test_handles_of_named_and_missing_threads(spark):
    rows = [("b", 0), (None, 1), ("a", 1), ("a", 0), (None, 0), ("th-10", 0), ("th-9", 0)]
    box = X.mailbox(spark.createDataFrame(rows, "thread string, position int"), "thread", "position").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    threads = list(dict.fromkeys(t for t, _ in order))
    assert {(r.thread, r.position): (r.handle, r.thread_handle) for r in box} == {r: (f"e{i}", f"t{threads.index(r[0]) + 1}") for i, r in enumerate(order, 1)}
    numbers = X.mailbox(spark.createDataFrame([(5, 0), (None, 0), (9000, 0)], "thread long, position int"), "thread", "position")
    assert {(r.thread, r.handle, r.thread_handle) for r in numbers.collect()} == {(None, "e1", "t1"), (5, "e2", "t2"), (9000, "e3", "t3")}


def test_one_scan_is_one_replacement_after_the_other(spark):
    import re

    from mailquarry.operators import rewriting as W

    rnd = random.Random(13)
    names = [("".join(rnd.choice("ab_ ") for _ in range(rnd.randint(1, 6))).strip() or "a", f"<{i}>") for i in range(40)] + [("Ann Lee", "P1"), ("Lee", "P2"), ("Ann", "P3"), ("Lee Ann", "P4")]
    names = list({n: (n, label) for n, label in reversed(names)}.values())
    texts = ["".join(rnd.choice("ab_ .é") for _ in range(300)) for _ in range(30)] + ["Ann Lee Ann Leeds, Ann-Lee Ann", "", None]
    order = sorted(names, key=lambda x: (-len(x[0]), x[0]))

    def chain(text):
        for n, label in order:
            text = re.sub(rf"(?a:\b){re.escape(n)}(?a:\b)", label, text)
        return text

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = spark.createDataFrame([*names, (None, "x"), ("", "y")], "name string, label string")
    for most in (1 << 20, 60):
        got = {r.i: r.text for r in W.with_names(df, table, "text", most=most).collect()}
        assert got == {i: t if t is None else chain(t) for i, t in enumerate(texts)}
    assert len(list(W.blocks(table, 60))) > 3 and W.with_names(df, table.limit(0), "text").columns == df.columns


def test_scan_for_very_many_names():
    import time

    from mailquarry.operators import rewriting as W

    machine = W.automaton([(f"name {i} of{i}", str(i)) for i in range(100_000)])
    began = time.process_time()
    text = " ".join(f"name {i} of{i} and" for i in range(0, 100_000, 3))
    assert W.rewritten(text, machine) == " ".join(f"{i} and" for i in range(0, 100_000, 3))
    assert time.process_time() - began < 5


def test_a_stream_goes_on_from_its_state(spark):
    from mailquarry.streaming import restored

    rnd, at = random.Random(17), scratch(spark, "restored")
    log = [(rnd.randrange(4), i, rnd.choice(["READ", "SEARCH", "SEGMENT", None]), rnd.choice([None, 1, 2, 3])) for i in range(60)]
    schema = "user_id long, event_id long, tool string, k int"
    for part in (log[:25], log[10:40] + log[10:12], log[5:], log):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/log")
        restored.advance(spark, spark.createDataFrame([], schema).schema, f"{at}/log", at, 6)
    want = []
    for u in sorted({r[0] for r in log}):
        own = [r for r in log if r[0] == u]
        used = sum(t in ("LIST", "SEARCH", "READ") for _, _, t, _ in own)
        want.append((u, len(own), used, len({k for _, _, t, k in own if t == "READ" and k}), used >= 6, max(i for _, i, _, _ in own)))
    assert sorted(map(tuple, restored.latest(spark, at).collect())) == want


def test_a_stream_of_many_files_goes_in_few_batches(spark):
    import glob

    from mailquarry.streaming import restored

    at, schema = scratch(spark, "restored"), "user_id long, event_id long, tool string, k int"
    log = [(u, 100 * u + i, ["READ", "LIST", None][i % 3], [None, 1, 2, 3, 4][i % 5]) for u in range(3) for i in range(30)]
    for part in (log[::2], log[1::2] + [(0, 0, "SEARCH", 9), (0, 2, "READ", 9), (2, 204, "READ", 9)]):
        spark.createDataFrame(part, schema).repartition(7).write.mode("append").parquet(f"{at}/log")
        restored.advance(spark, spark.createDataFrame([], schema).schema, f"{at}/log", at, 20)
    assert len(glob.glob(f"{at.removeprefix('file://')}/out/*")) == 2
    assert sorted(map(tuple, restored.latest(spark, at).collect())) == [(u, 30, 20, 4, True, 100 * u + 29) for u in range(3)]


def test_no_prompt_is_paid_twice(spark, tmp_path):
    import time

    from pyspark.sql import functions as F

    from mailquarry.operators import models

    sent, ledger = tmp_path / "sent", f"file://{tmp_path}/ledger"
    sent.mkdir()
    prompts = spark.createDataFrame([(i, f"p{i % 40}" if i % 9 else None) for i in range(120)], "i int, prompt string")

    def maker(fail):
        def make():
            def generate(batch):
                if fail and any(p == fail for p in batch):
                    time.sleep(4)  # the other tasks end before the job does
                    raise ValueError("broken")
                import uuid

                (sent / uuid.uuid4().hex).write_text("\n".join(batch))
                return [f"to {p}" for p in batch]

            return generate

        return make

    paid = lambda: [p for f in sent.iterdir() for p in f.read_text().split("\n")]
    with pytest.raises(Exception, match="broken"):
        models.paid_once(prompts, maker("p7"), "prompt", ledger, a_task=4)
    import hashlib

    before, stored = paid(), {r._h for r in spark.read.parquet(ledger).collect()}
    # of tasks that the failure stopped, prompts may be sent and not stored; what is stored is not sent again
    assert stored and stored <= {hashlib.sha256(p.encode()).hexdigest() for p in before} and "p7" not in before
    for f in sent.iterdir():
        f.unlink()
    out = models.paid_once(prompts, maker(None), "prompt", ledger, a_task=4)
    assert {(r.i, r.answer) for r in out.collect()} == {(i, f"to p{i % 40}" if i % 9 else None) for i in range(120)}
    every = {f"p{i % 40}" for i in range(120) if i % 9}
    assert sorted(paid()) == sorted(p for p in every if hashlib.sha256(p.encode()).hexdigest() not in stored)
    again = len(paid())
    assert models.paid_once(prompts, maker("p1"), "prompt", ledger).where(F.col("answer").isNull()).count() == 14 and len(paid()) == again


def test_waits_are_those_that_the_error_names(spark, tmp_path):
    from mailquarry.operators import models

    mark = tmp_path / "mark"

    def make():
        def generate(batch):
            if not mark.exists():
                mark.write_text("")
                e = ConnectionError("busy")
                e.retry_after = 0.01
                raise e
            return batch

        return generate

    out = models.paid_once(spark.createDataFrame([("x",)], "prompt string"), make, "prompt", f"file://{tmp_path}/ledger", wait=1e6, rate=1e6)
    assert out.first().answer == "x"


def test_a_set_is_published_whole_or_not_at_all(spark, tmp_path):
    from pathlib import Path

    from pyspark.sql import functions as F

    from mailquarry.sources import published as P

    at = f"file://{tmp_path}/set"
    assert P.versions(spark, at) == []
    assert P.publish(spark.range(100).repartition(4), at) == 1

    @F.udf("long")
    def breaks(x):
        if x == 77:
            raise ValueError("killed")
        return x

    with pytest.raises(Exception, match="killed"):
        P.publish(spark.range(100).repartition(8).select(breaks("id").alias("id")), at)
    assert P.versions(spark, at) == [1] and [p.name for p in (tmp_path / "set").iterdir()] == ["v1"]
    (tmp_path / "set" / "_hidden-left").mkdir()
    assert P.publish(spark.range(7), at) == 2 and P.read_published(spark, at).count() == 7 and P.read_published(spark, at, version=1).count() == 100
    assert not (tmp_path / "set" / "_hidden-left").exists()
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, at, version=3)
    assert P.damage(spark, at, 1).count() == 0
    files = sorted(p for p in (Path(tmp_path) / "set/v1/data").iterdir() if p.name.startswith("part-"))
    for crc in files[0].parent.glob(".*.crc"):
        crc.unlink()
    data = bytearray(files[0].read_bytes())
    data[9] ^= 1
    files[0].write_bytes(data)
    files[1].rename(files[1].with_name("part-other.parquet"))
    found = {r.file: r.state for r in P.damage(spark, at, 1).collect()}
    assert found == {files[0].name: "changed", files[1].name: "missing", "part-other.parquet": "added"}


def test_nearest_in_cells_are_the_nearest(spark):
    from mailquarry.operators import measures as M

    rnd = random.Random(23)
    centres = [[rnd.uniform(-9, 9) for _ in range(3)] for _ in range(12)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(centres)]) for i in range(300)] + [(900 + i, centres[0]) for i in range(40)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.where("id % 3 = 0 or id >= 930").withColumnRenamed("id", "qid")
    key = lambda x: sorted((r.qid, r["rank"], r.id, round(r.distance, 6)) for r in x.collect() if r.distance is not None)
    for k, count in ((1, 16), (4, 5), (3, 500)):
        assert key(M.nearest_in_cells(queries, df, k, count)) == key(M.nearest(queries.where("qid <> 999"), df.where("id <> 999"), k))
    assert M.cell_pairs(queries, df, 1, 16).count() < 0.25 * queries.count() * len(rows)
    one = df.where("id = 5")
    assert M.nearest_in_cells(one.withColumnRenamed("id", "qid"), one).collect() == [] and M.nearest_in_cells(queries, df.limit(0)).collect() == []


def test_texts_that_hold_passages_of_any_length(spark):
    from mailquarry.operators import records as R

    rnd = random.Random(29)
    texts = [" ".join(rnd.choice(["ab", "c", "de f", "x\ny"]) for _ in range(12)) for _ in range(60)] + [None, "", "b"]
    for passages in (["ab c", "e f x", "y c c ab c de", "zz"], ["b"], [None, "zz"], ["", "zz"]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        got = {r.doc_id for r in R.holding(docs, spark.createDataFrame([(p,) for p in passages], "passage string")).collect()}
        assert got == {i for i, t in enumerate(texts) if t is not None and any(p is not None and p in t for p in passages)}
