"""Operators on small invented tables."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailquarry.operators import assembly as A
from mailquarry.operators import measures as M
from mailquarry.operators import models
from mailquarry.operators import records as R
from mailquarry.operators import retrieval as S
from mailquarry.sources import mail


def docs(spark):
    rows = [(0, ["gas", "deal"]), (1, ["gas", "gas", "pipe"]), (2, ["gas", "deal"]), (3, []), (4, ["other"])]
    return spark.createDataFrame(rows, "doc long, tokens array<string>")


def test_scores_against_the_formula(spark):
    asks = spark.createDataFrame([(7, ["gas", "gas", "pipe", "absent"])], "qid long, tokens array<string>")
    got = {r.doc: r.score for r in S.bm25_scores(docs(spark), asks).collect()}
    avg, n = 8 / 5, 5

    def part(f, df, dl):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg))

    assert got == pytest.approx({0: part(1, 3, 2), 1: part(2, 3, 3) + part(1, 1, 3), 2: part(1, 3, 2)})
    best = S.top_k(S.bm25_scores(docs(spark), asks), 3).orderBy("rank").collect()
    assert [r.doc for r in best] == [1, 0, 2]


def test_like_documents_leave_themselves_out(spark):
    got = S.by_document(docs(spark), spark.createDataFrame([(0,)], "doc long")).collect()
    assert {r.doc for r in got} == {1, 2} and got[0].qid == 0


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 0, 5, 1), (0, 0, 6, 2), (0, 1, 6, 1), (0, 1, 7, 2), (0, 2, 8, 1)], "gid int, qid int, doc int, rank int")
    got = S.reciprocal_ranks(lists).orderBy("rank").collect()
    assert [r.doc for r in got] == [6, 5, 8, 7] and got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_rerank_falls_back_to_the_pool(spark):
    pool = spark.createDataFrame([(0, 1, 1, None), (0, 2, 2, 3.0), (0, 3, 3, None), (0, 4, 4, 9.0)], "qid int, doc int, rank int, r double")
    assert [r.doc for r in S.rerank(pool, F.col("r"), 3).orderBy("shown").collect()] == [4, 2, 1]


def test_similar_sets_miss_no_pair(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, sorted(rnd.sample("abcdefgh", rnd.randint(0, 6)))) for i in range(60)]
    sets = {}
    for i, s in rows:
        if s:
            sets.setdefault(tuple(s), i)
    for least in (0.5, 0.8):
        want = {(min(i, j), max(i, j)) for s, i in sets.items() for t, j in sets.items() if i != j and len({*s} & {*t}) / len({*s} | {*t}) >= least}
        got = {(r.a, r.b) for r in R.similar_sets(spark.createDataFrame(rows, "id long, toks array<string>"), least).collect()}
        assert got == want


def test_whole_sets_travel_for_near_pairs_only(spark, monkeypatch):
    """All sets meet on tokens that are rarer than the others, yet few are similar: the parities tell, and the rest does not travel."""
    import random

    rnd = random.Random(2)
    common = [f"w{i}" for i in range(600)]
    rows = [(i, sorted({*rnd.sample(common, 120), *[f"r{j}" for j in range(30)]})) for i in range(60)]
    rows += [(100 + i, sorted({*s[:140], f"x{i}"})) for i, s in rows[:10]] + [(200, rows[0][1]), (201, None), (202, [])]
    seen, write = {}, R.written
    monkeypatch.setattr(R, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    got = {(r.a, r.b): r.jaccard for r in R.similar_sets(spark.createDataFrame(rows, "id long, toks array<string>"), 0.8).collect()}
    sets = {i: set(s) for i, s in rows if s and i != 200}
    want = {(i, j): len(s & t) / len(s | t) for i, s in sets.items() for j, t in sets.items() if i < j and len(s & t) / len(s | t) >= 0.8}
    assert got == want and len(want) == 10
    assert seen["pairs"][0].count() <= 2 * len(want)


def test_near_sets_travel_about_once(spark, monkeypatch):
    """In a crowd where many pairs are near, but few sets have the same least neighbour, and units are of bounded size."""
    import random

    rnd = random.Random(4)
    core, more = [f"c{i}" for i in range(70)], [f"m{i}" for i in range(400)]
    crowd, last = [], rnd.sample(more, 14)
    for i in range(150):
        last = [*last[2:], *rnd.sample(more, 2)]  # like those that are next to it
        crowd.append((i, sorted({*core, *last})))
    for unit in (1 << 17, 1000):
        monkeypatch.setattr(R, "UNIT", unit)
        seen, write = {}, getattr(R.written, "real", R.written)
        keep = lambda df, name, write=write, seen=seen: seen.setdefault(name, []).append(write(df, name)) or seen[name][-1]
        keep.real = write
        monkeypatch.setattr(R, "written", keep)
        got = {(r.a, r.b): r.jaccard for r in R.similar_sets(spark.createDataFrame(crowd, "id long, toks array<string>"), 0.8).collect()}
        sets = {i: set(s) for i, s in crowd}
        assert got == {(i, j): len(s & t) / len(s | t) for i, s in sets.items() for j, t in sets.items() if i < j and len(s & t) / len(s | t) >= 0.8}
        assert len(got) > 500
        if unit > 1000:
            travels = seen["dealt"][0][0].select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().count()
            assert travels <= 2 * len(crowd)


def test_passages_are_found_wherever_they_stand(spark):
    passages = ["one two\nthree four five six", "a b c d", "two words", "x", "  lead\t\tby spaces and  more ", "cut at both ends he", None]
    texts = [*[f"so {p}, and" for p in passages[:4]], f"({passages[4]})", "we{}re".format(passages[5]), "one two three four five six", "two  words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in R.holding(docs, spark.createDataFrame([(p,) for p in passages], "passage string")).collect()}
    assert got == {i for i, t in enumerate(texts) if any(p in t for p in passages if p is not None and t is not None)}


def test_every_document_of_a_set_has_its_class(spark):
    rows = [(4, ["b", "a"]), (2, ["a", "b"]), (9, ["a", "b"]), (5, ["c"]), (7, []), (8, None)]
    got = R.set_classes(spark.createDataFrame(rows, "id long, toks array<string>"))
    assert sorted(map(tuple, got.collect())) == [(2, 2), (4, 2), (5, 5), (9, 2)]


def test_keep_first_and_upsert_and_latest(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, None)], "id long, t string")
    assert {r.id for r in R.keep_first(df, R.signature("t"), "id").collect()} == {1, 3}
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]))
    assert {tuple(r) for r in R.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert R.latest(spark.createDataFrame([("a", 1, 5), ("a", 2, 4)], "k string, n int, v int"), ["k"], "n").first().v == 4


def test_subsets(spark):
    for n, count in ((2, 2), (3, 6), (4, 14)):
        row = spark.range(1).select(R.proper_subsets(n).alias("m")).select(F.transform("m", lambda m: R.members(m)).alias("s")).first().s
        assert len(row) == count and len(set(map(tuple, row))) == count and [1] in row and list(range(1, n + 1)) not in row


def test_a_small_item_may_follow_one_that_did_not_fit(spark):
    items = F.array(*[F.struct(F.lit(p).cast("long").alias("pos"), F.lit(s).cast("long").alias("size"), F.lit(m).alias("must")) for p, s, m in [(0, 60, False), (1, 50, False), (2, 40, False), (3, 30, True)]])
    assert spark.range(1).select(R.fit_budget(items, 100)).first()[0] == [0, 2, 3]


def test_credit_counts_every_read_and_searches_unlike_those_before(spark):
    from mailquarry.operators import rules as U

    events = [("SEARCH", "abcde"), ("READ", ""), ("SEARCH", "abcde"), ("SEARCH", "abcdx"), ("READ", ""), ("SEARCH", ""), ("LIST", ""), ("SEARCH", "xyz"), (None, "")]
    log = spark.createDataFrame([(1, i, tool, list(words)) for i, (tool, words) in enumerate(events)] + [(2, 0, "LIST", [])], "s int, i int, tool string, w array<string>")
    got = sorted((r.s, r.i, r.credit) for r in U.with_credit(log, "s", "i", "tool", F.col("w")).collect())
    assert got == [(1, i, c) for i, c in enumerate([1, 2, 2, 3, 4, 4, 4, 5, 5])] + [(2, 0, 0)]


def test_answers_of_several_candidates(spark):
    import json

    from mailquarry.operators import rules as U

    good, blank, odd = {"secret": " a "}, {"secret": " "}, {"secret": "b", "evidence_email_ids": [1]}
    cases = [([good, good], None), ([good], "count"), ([], None), ([good, blank], "no secret"), ([odd, blank], "evidence"), ([good, {"secret": "b", "evidence_email_ids": "e1"}], "evidence"), ({"secret": "a"}, "not a list"), ([1, 2], "no secret"), ([good, {"secret": "b", "evidence_email_ids": ["e1"]}], None)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(99, "no json"), (100, None)], "i int, said string")
    got = {r.i: r.f for r in df.select("i", U.misshapen(F.col("said"), 2).alias("f")).collect()}
    assert got == {**{i: f for i, (_, f) in enumerate(cases)}, 99: "not a list", 100: "not a list"}


def test_two_readings_of_evidence(spark):
    cited = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("a", "t9"), ("a", None), ("b", None)], "key string, thread string")
    wanted = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t1"), ("c", "t1")], "key string, thread string")
    got = {r.key: (r.precision, r.recall) for r in M.thread_evidence(cited, wanted).collect()}
    assert got == {"a": (0.5, 0.5), "b": (0.0, 0.0), "c": (0.0, 0.0)}
    by_id = spark.createDataFrame([("a", "m1"), ("a", "zz")], "key string, message string")
    clues = spark.createDataFrame([("a", "m1", 1), ("a", "m2", 1), ("a", "m3", 2)], "key string, message string, clue int")
    assert tuple(M.message_evidence(by_id, clues).first())[1:] == (0.5, 0.5)


def test_product_gate_rounds_half_to_even(spark):
    def gate(f, m, r, p):
        return spark.range(1).select(M.product_gate(F.lit(f), F.lit(m), F.lit(r), F.lit(p))).first()[0]

    assert gate(True, True, 0.5, 0.5) == 0.25 and gate(True, True, 0.25, 0.25) == 0.062 and gate(False, True, 1.0, 1.0) == 0.0


def test_auc_with_ties(spark):
    rows = [("g", 1.0, 1), ("g", 1.0, 0), ("g", 2.0, 1), ("g", 0.0, 0)]
    assert M.auc(spark.createDataFrame(rows, "g string, s double, p int"), "s", "p", ["g"]).first().auc == pytest.approx(3.5 / 4)


def test_nearest_leaves_itself_out(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    got = {r.qid: (r.id, r.distance) for r in M.nearest(rows.withColumnRenamed("id", "qid"), rows).collect()}
    assert got == {0: (2, 0.0), 1: (0, 5.0), 2: (0, 0.0)}


def test_haystacks_have_what_was_asked(spark):
    cases = spark.createDataFrame([("x", "c1"), ("y", "c2")], "case string, thread string")
    corpus = spark.createDataFrame([(f"n{i}",) for i in range(30)], "thread string")
    taken = spark.createDataFrame([("x", f"n{i}") for i in range(10)], "case string, thread string")
    one = A.haystacks(cases, corpus, taken, 12, 3).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, A.haystacks(cases, corpus.repartition(3), taken, 12, 3).collect()))
    for case in "xy":
        mine = [r for r in one if r.case == case]
        assert len(mine) == 13 and sum(r.clue for r in mine) == 1 and sorted(r.place for r in mine) == list(range(1, 14))
    assert not {r.thread for r in one if r.case == "x"} & {f"n{i}" for i in range(10)}


def test_segments_wrap(spark):
    seen = spark.createDataFrame([("a", [0, 3], 3), ("b", [2, 3], 2), ("c", [0, 1, 2, 3], 1)], "session string, segments array<int>, cursor int")
    assert {r.session: r.segment for r in A.next_segment(seen, 4).collect()} == {"a": 1, "b": 0, "c": None}


def test_generator_failures_are_empty(spark):
    def flaky():
        def run(prompts):
            if len(prompts) > 1 or "bad" in prompts[0]:
                raise ConnectionError
            return [p.upper() for p in prompts]

        return run

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "p string").coalesce(1)
    assert [r.x for r in df.select(models.generated(flaky, F.col("p")).alias("x")).collect()] == ["OK", "", ""]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        df.select(models.generated(lambda: lambda prompts: [str(1 / 0)], F.col("p")).alias("x")).collect()
    said = spark.createDataFrame([('{"match": true}',), ('{"match": "true"}',), ("no",)], "s string")
    assert [r.m for r in said.select(models.strict_match(F.col("s")).alias("m")).collect()] == [True, False, False]


def test_threads_to_messages(spark, tmp_path):
    import json

    m = {"message_id": "1", "from_addr": "Ada.Reed@x.example", "to_addrs": [], "subject": "s", "date": "2001-01-01T09:00:00-06:00", "body": "x" * 30}
    rows = [{"thread_id": "t1", "messages": [m, {**m, "message_id": "2", "from_addr": "bo@x.example"}, {**m, "message_id": "3", "body": "short"}, {**m, "message_id": "4", "body": None}]}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    users = spark.createDataFrame([("bo@x.example", "Bo Lund")], "email string, display_name string")
    got = mail.load_messages(mail.read_jsonl(spark, str(tmp_path / "t.jsonl"), mail.THREAD), users).orderBy("pos").collect()
    assert [(r.message_id, r.from_name, r.date) for r in got] == [("1", "Ada Reed", "2001-01-01T09:00:00"), ("2", "Bo Lund", "2001-01-01T09:00:00")]
    assert mail.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int", missing_ok=True).count() == 0
    (tmp_path / "x.txt").write_text("id1  # why\n# all\n\nid2\n")
    assert {r.message_id for r in mail.exclusions(spark, str(tmp_path / "x.txt")).collect()} == {"id1", "id2"}


def test_cases_and_results(spark, tmp_path):
    import json

    cases = [{"topic_id": f"{r}{i}", "status": "KEPT" if i else "DROP"} for r in "WC" for i in range(4)] + [{"topic_id": "W9"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, cases)))
    got = mail.load_cases(spark, {"com": str(tmp_path / "c.jsonl")}, "topic_id string, status string", 3)
    assert sorted(r.topic_id for r in got.collect()) == ["C1", "C2", "W1"]
    assert {r.register for r in mail.dataset(got).collect()} == {"work", "casual"}
    df = spark.createDataFrame([("a", 1, None), ("b", None, 0.5)], "k string, n int, x double")
    mail.write_results(df, str(tmp_path / "r"), ["k", "x", "n"])
    back = mail.read_results(spark, str(tmp_path / "r"), "k string, x double, n int")
    assert {tuple(r) for r in back.collect()} == {("a", None, 1), ("b", 0.5, None)}


def test_raw_mail(spark, tmp_path):
    (tmp_path / "1.").write_bytes(b"From: ada@x.example\n\nbody here\n-----Original Message-----\nold")
    got = mail.read_maildir(spark, str(tmp_path)).first()
    assert (got.sender, got.body) == ("ada@x.example", "body here")


def test_haystacks_are_full_where_clues_come_first(spark):
    from mailquarry.operators.records import hash_order

    corpus = spark.range(40).withColumnRenamed("id", "thread")
    first = [r.thread for r in corpus.orderBy(hash_order(corpus.thread, 3)).limit(4).collect()]
    cases = spark.createDataFrame([(1, t) for t in first[:2]], "case long, thread long")
    taken = spark.createDataFrame([(1, t) for t in first[2:]], "case long, thread long")
    got = A.haystacks(cases, corpus, taken, 10, 3).collect()
    assert sum(not r.clue for r in got) == 10 and sorted(r.place for r in got) == list(range(1, 13))


def test_principal_directions_are_those_of_the_covariance(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(60, 6)) * [5, 1, 3, 1, 1, 0.5]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id long, v array<float>")
    got = {r.id: (r.p1, r.p2) for r in M.principal(df, "id", "v").collect()}
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    w = np.array([v if v[abs(v).argmax()] > 0 else -v for v in vt[:2]])
    assert len(got) == 60 and np.allclose([got[i] for i in range(60)], c @ w.T, atol=1e-4)
    assert M.principal(df.where("v is null"), "id", "v").count() == 0


def test_topics_of_all_shapes(spark, tmp_path):
    from mailquarry.sources import mail

    one = '{"id": "a", "plot": "p", "era": "2001-10-13T09"}, {"topic_id": "a", "plot": "q", "era": "2001-10-14T09"}, {"plot": "none"}'
    for name, text in {"kept": '{"kept":\n[' + one + "]}", "topics": '{"topics": [' + one + "]}", "lines": one.replace("}, {", "}\n{")}.items():
        (tmp_path / name).write_text(text)
        assert [(r.id, r.plot, r.era) for r in mail.load_topics(spark, str(tmp_path / name)).collect()] == [("a", "q", "2001-10-14")]


def test_rows_of_logs_are_the_latest(spark, tmp_path):
    import json

    from mailquarry.sources import mail

    rows = [("s", 1, "2001", 0.5, {}), ("s", 1, "2002", 0.75, {"secret": "x" * 500}), ("s", 2, "2001", None, {})]
    text = [json.dumps({"sample": s, "epoch": e, "logged": t, "values": json.dumps({} if f is None else {"final": f}), "details": json.dumps(x), "metadata": '{"config": "c"}', "answer": "said"}) for s, e, t, f, x in rows]
    (tmp_path / "log").write_text("\n".join(text))
    got = sorted((r.epoch, r.final, r.config, r.budget, len(r.secret)) for r in mail.rows_from_logs(spark, str(tmp_path / "log")).collect())
    assert got == [(1, "0.75", "c", "", 400), (2, "", "c", "", 4)]


def test_too_small_a_corpus_to_borrow_from(spark):
    from mailquarry.operators import mailbox as X

    clues = spark.createDataFrame([(1, -1, 0, "a", None, "2001"), (1, -1, 1, "b", "a", "2001")], "case int, thread int, position int, message_id string, in_reply_to string, date string")
    corpus = spark.createDataFrame([(5, 0, "m5", "2000")], "thread int, position int, message_id string, date string")
    none = spark.createDataFrame([], "case int, thread int")
    with pytest.raises(Exception, match="too small to borrow"):
        X.full_haystack(clues, corpus, none, none, 3, 1).collect()


def test_similar_to_accepted_sets(spark):
    import random

    from mailquarry.operators import mailbox as X

    rnd = random.Random(2)
    rows = [(i, sorted({rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 8))})) for i in range(120)]
    accepted = [(i, sorted({rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 6))})) for i in range(12)]
    want = {i: not x or any(len({*x} & {*y}) / len({*x} | {*y}) >= 0.5 for _, y in accepted) for i, x in rows}
    schema = "id int, toks array<string>"
    assert {r.id: r.duplicate for r in X.like_any(spark.createDataFrame(rows, schema), spark.createDataFrame(accepted, schema), 0.5).collect()} == want


def test_a_session_of_the_mailbox(spark):
    from mailquarry.operators.session import Mailbox

    rows = [(1, 0, "a", "ann", "gas deal", "the gas tariff filing " * 60, "2001-02-01"), (2, 0, "b", "bob", "lunch", "sushi today", "2001-01-01"), (2, 1, "c", "ann", "re lunch", "tariff sushi filing", "2001-01-02"), (3, 0, "d", "cy", "hidden tariff", "tariff memo shredded", "2001-03-01")]
    messages = spark.createDataFrame(rows, "thread int, position int, id string, sender string, subject string, body string, date string")
    box = Mailbox(messages, spark.createDataFrame([("c",), ("d",)], "id string"), budget=6, segment_size=2, least_credit=3)
    assert [r.thread_handle for r in box.list_threads()] == ["t2", "t1", "t3"] and [r.thread_handle for r in box.list_threads(2)] == ["t2", "t1"]
    hits = box.call("SEARCH", "tariff memo")
    assert hits[0].handle == "e4" and {r.handle for r in hits} == {"e1", "e3", "e4"} and not any(r.is_read for r in hits)
    assert box.submit([{"secret": "x"}]) == "investigate"
    assert [(r.handle, len(r.body)) for r in box.read("e3")] == [("e2", 11), ("e3", 19)] and len(box.read("t1")[0].body) <= 1500
    assert [r.handle for r in box.expand("e4", log=False)] == [] and box.call("READ", "e99") == [] and box.exhausted and box.call("SEARCH", "sushi") == []
    assert [box.submit(x) for x in ("x", [{"secret": "a"}, {"secret": "b"}], [{"secret": " "}], [{"secret": "a", "evidence": [1]}], [])] == ["not a list", "count", "no secret", "evidence", "scan"]
    assert [len(box.call("SEGMENT")) for _ in range(3)] == [2, 1, 0] and box.submit([]) == "" and box.answer == []
    m = box.metrics()
    assert (m["n_search"], m["n_read"], m["n_emails_opened"], m["n_redundant_reads"], m["n_clues_total"], m["n_clues_read"], m["clue_recall"]) == (1, 3, 3, 0, 2, 1, 0.5)
    assert box.submit([{"secret": " it ", "evidence": [" e4 "]}]) == "" and box.answer == [{"secret": "it", "evidence": ["e4"]}]
    box.close()


def test_clue_set_specs():
    from mailquarry.sources import mail

    assert mail.clue_sets("a/com_n2.jsonl, b/x.jsonl:pal ,plain,") == {"com_n2": "a/com_n2.jsonl", "pal": "b/x.jsonl", "plain": "plain"}


def test_records_with_names_for_labels(spark):
    """Messages to the depth that their type has, against the same written out."""
    deep = "struct<`from`:string,to:array<string>,cc:array<string>,subject:string,body:string,note:string,forward:{}>"
    plain = "struct<`from`:string,body:string>"
    kind = f"id int, clues array<struct<i:int,plot:string,messages:array<{deep.format(deep.format(plain))}>>>, atoms array<struct<role:string,fact:string>>, actor string"

    def message(label, name, first, forward):
        of = lambda x, y: (x, [f"{x}@x", None], None, f"Re {y}", f"{y}'s", "Person A", forward)
        return of(label, label), (name, [f"{name.lower().replace(' ', '.')}@x", None], None, f"Re {first}", f"{first}'s", "Person A", None)

    full = {"Person A": "Ada Reed", "Person B": "Bo Ek"}
    inner, inner_done = message("Person B", "Bo Ek", "Bo", ("person-a", "<<FIRM>> of Person B"))
    outer, outer_done = message("personA", "Ada Reed", "Ada", inner)
    inner_done = (*inner_done[:6], ("Ada Reed", "Acme of Bo"))
    outer_done = (*outer_done[:6], inner_done)
    rows = [(1, [(1, "Person A", [outer, None]), (2, None, None)], [("x", "Person B's"), ("y", None)], "Person B"), (2, None, None, None), (3, [], [], "")]
    want = [(1, [(1, "Ada Reed", [outer_done, None]), (2, None, None)], [("x", "Bo Ek's"), ("y", None)], "Bo Ek"), (2, None, None, None), (3, [], [], "")]
    df = spark.createDataFrame(rows, kind)
    got = R.regrounded(df, full, [("<<FIRM>>", "Acme")], texts=["actor"])
    assert got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.createDataFrame(want, kind).collect()))
    assert R.regrounded(df.select("id", "actor"), full, clues=None, atoms=None).count() == 3


def test_search_in_blocks_equals_scoring_all_pairs(spark, monkeypatch):
    """In small blocks too, with ties, repeats, words that all have, texts without words, and pairs left out."""
    import random

    from mailquarry.operators import blocks

    rnd = random.Random(3)
    words = ["all", *[f"w{i}" for i in range(40)]]
    rows = [(i, ["all"] * (i % 4) + rnd.choices(words, k=rnd.randint(0, 12))) for i in range(200)] + [(500 + i, rows_) for i, rows_ in enumerate([["all", "w1"]] * 30 + [[], None])]
    docs_ = spark.createDataFrame(rows, "doc long, tokens array<string>").repartition(3)
    asks = docs_.where("doc % 7 = 0 and tokens is not null").select(F.col("doc").alias("qid"), "tokens")
    out = asks.select("qid", F.explode(F.array(F.col("qid"), F.col("qid") + 1, F.lit(505))).alias("doc"))
    seen = lambda df: sorted((r.qid, r["rank"], r.doc, round(r.score, 6)) for r in df.collect())
    known = docs_.where("tokens is not null")
    for sizes in ((4096, 512), (16, 5)):
        monkeypatch.setattr(blocks, "DOCS", sizes[0])
        monkeypatch.setattr(blocks, "QUERIES", sizes[1])
        assert seen(S.best(known, asks, 6)) == seen(S.top_k(S.bm25_scores(known, asks), 6))
        assert seen(S.best(known, asks, 6, out)) == seen(S.top_k(S.bm25_scores(known, asks).join(out, ["qid", "doc"], "left_anti"), 6))
    plan = S.best(known, asks, 6)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan


def kin_docs(spark):
    """Documents of three kins and of none, with many copies, in one task's order."""
    import random

    rnd = random.Random(9)
    kins = ["a", "b", "c", None]
    rows = [(i, kins[i % 4], [f"{kins[i % 4]}{rnd.randrange(12)}" for _ in range(rnd.randint(0, 9))] + ["all"] * (i % 3)) for i in range(160)]
    return spark.createDataFrame(rows + [(200 + i, "a", ["a1", "a2", "all"]) for i in range(40)], "doc long, kin string, tokens array<string>").coalesce(1)


def test_a_task_gives_the_best_of_all_its_cells(spark, monkeypatch):
    """k rows a query go on, however many blocks a task has; blocks hold one kin, and results are those of all pairs."""
    from mailquarry.operators import blocks

    docs_ = kin_docs(spark)
    asks = docs_.where("doc % 9 = 0").select(F.col("doc").alias("qid"), "tokens")
    want = S.top_k(S.bm25_scores(docs_, asks).where("qid <> doc"), 3)
    want = sorted((r.qid, r["rank"], r.doc, round(r.score, 6)) for r in want.collect())
    assert want == sorted((r.qid, r["rank"], r.doc, round(r.score, 6)) for r in S.by_document(docs_, docs_.where("doc % 9 = 0"), 3).collect())
    # what a task does, in small steps
    for name, size in (("DOCS", 16), ("QUERIES", 8), ("PAIRS", 64), ("STRIP", 40), ("EXACT", 3), ("HEAVY", 4)):
        monkeypatch.setattr(blocks, name, size)
    rows = docs_.collect()
    n = {t: sum(t in r.tokens for r in rows) for r in rows for t in r.tokens}
    idf, average = {t: math.log(1 + (len(rows) - x + 0.5) / (x + 0.5)) for t, x in n.items()}, sum(len(r.tokens) for r in rows) / len(rows)
    table = pa.table({"doc": [r.doc for r in rows], "kin": pa.array([r.kin for r in rows], pa.string()), "tokens": pa.array([r.tokens for r in rows], pa.list_(pa.string()))})
    packed = list(blocks._pack_docs(table.to_batches(max_chunksize=7)))
    kin = {r.doc: r.kin for r in rows}
    for p in packed:
        assert {kin[int(i)] for i in np.frombuffer(p.column("ids")[0].as_py(), "<i8")} == {p.column("kin")[0].as_py()}
    assert len(packed) >= 13 and sum(p.column("n")[0].as_py() for p in packed) == len(rows)
    asked = [(r.doc, r.kin, sorted({*r.tokens}), [idf[t] for t in sorted({*r.tokens})], [r.doc]) for r in rows if r.doc % 9 == 0 and r.tokens]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*asked), kinds)], ["qid", "kin", "terms", "weights", "without"])
    queries = list(blocks._pack_queries([batch]))
    assert len(queries) > 1
    cells = [pa.RecordBatch.from_arrays([*d.columns, *q.columns], [*d.schema.names, *q.schema.names]) for d in packed for q in queries]
    found = [r for b in blocks._cells(3, lambda f, dl, norm: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / average)))(cells) for r in b.to_pylist()]
    assert len(found) <= 3 * len(asked)
    assert sorted((r["qid"], r["doc"], round(r["score"], 6)) for r in found) == sorted((q, doc, score) for q, _, doc, score in want)


def test_tfidf_shuffles_no_postings(spark):
    """Weights and cosines against the formula; nothing is grouped by document and term."""
    rows = [(0, ["a", "b", "b", "x"]), (1, ["a", "b"]), (2, ["b", "c", "c"]), (3, []), (4, ["c", "a", "only"])]
    df = spark.createDataFrame(rows, "doc long, tokens array<string>").repartition(2)
    n = {t: sum(t in w for _, w in rows) for _, ws in rows for t in ws}
    x = {(d, t): w.count(t) / len(w) * math.log(5 / n[t]) for d, w in rows for t in w if n[t] >= 2}
    norm = {d: math.sqrt(sum(v * v for (e, _), v in x.items() if e == d)) + 1e-9 for d, _ in rows}
    want = {(d, t): v / norm[d] for (d, t), v in x.items()}
    assert {(r.doc, r.term): r.w for r in S.tfidf(df).collect()} == pytest.approx(want)
    cosine = {(a, b): sum(want.get((a, t), 0) * want.get((b, t), 0) for t in n) for a in (0, 2, 4) for b in range(5) if a != b}
    got = {(r.qid, r.doc): r.score for r in S.nearest_by_tfidf(df, 2, 9).collect()}
    assert got == pytest.approx({k: v for k, v in cosine.items() if v > 0})


def test_tfidf_neighbours_in_blocks_of_kins(spark, monkeypatch):
    """With copies and kins, against all pairs; the documents' frequencies come to the blocks once, not for queries too, and k rows a
    query and task go on."""
    from mailquarry.operators import blocks

    joined, add, found, best = [], blocks.with_frequencies, [], blocks.best
    monkeypatch.setattr(blocks, "with_frequencies", lambda b: joined.append(b) or add(b))
    monkeypatch.setattr(blocks, "best", lambda *x: found.append(best(*x)) or found[-1])
    df = kin_docs(spark)
    got = sorted((r.qid, r["rank"], r.doc, round(r.score, 6)) for r in S.nearest_by_tfidf(df, 9, 4).collect())
    assert len(joined) == 1
    w = S.tfidf(df)
    pairs = w.where("doc % 9 = 0").select(F.col("doc").alias("qid"), "term", F.col("w").alias("x")).join(w, "term").where("qid <> doc")
    want = S.top_k(pairs.groupBy("qid", "doc").agg(F.sum(F.col("x") * F.col("w")).alias("score")), 4)
    assert got == sorted((r.qid, r["rank"], r.doc, round(r.score, 6)) for r in want.collect())
    tasks = found[0].select(F.spark_partition_id().alias("p")).distinct().count()
    assert found[0].count() <= 4 * len({r[0] for r in got}) * tasks


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    """In blocks of any size, with copies, far vectors and such that are near to nothing."""
    import random

    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) + (1e6 if i % 10 == 0 else 0) for _ in range(5)]) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(9)]
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [1.0])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(3)
    want = {}
    for i, x in rows:
        far = sorted((round(math.dist(x, y), 9), j) for j, y in rows if j != i)
        want |= {(i, r): j for r, (_, j) in enumerate(far[:3], 1)}
    for size in (4096, 7):
        monkeypatch.setattr(M, "ROWS", size)
        assert {(r.qid, r["rank"]): r.id for r in M.nearest(df.withColumnRenamed("id", "qid"), df, 3).collect()} == want
