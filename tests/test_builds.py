"""Builds in rounds and mailbox files."""

import json
import mailbox
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from mailquarry.operators import models, rounds
from mailquarry.operators import retrieval as S
from mailquarry.operators.session import Mailbox
from mailquarry.shared import scratch
from mailquarry.sources import mail, mbox, published


def settled(df):
    return sorted(((r.id, r.status, r.way, r.tries, r["round"], tuple(r.log)) for r in df.collect()), key=str)


def by_need(name, column):
    """A stage that passes a case as soon as it has failed `column` times; before, it goes back to itself."""
    done = F.col("tries") >= F.col(column)
    return rounds.Stage(name, lambda df: df.withColumn("verdict", F.when(F.col("out"), "drop").when(done, "ok").otherwise(name)).withColumn("feedback", F.concat("feedback", F.lit("x"))))


CASES = "id long, a int, b int, out boolean"


def one_case(a, b, out, ways, tries, names=("first", "second")):
    """What a case comes to, step by step."""
    log, n, fails, k, left = [], 0, 0, 0, list(ways or [None])
    while True:
        n += 1
        v = "drop" if out else "ok" if fails >= (a, b)[k] else names[k]
        log.append(f"{names[k]}:{v}")
        if v == "drop":
            return "DROP", left[0], fails, n, tuple(log)
        if v == "ok":
            if k == 1:
                return "KEPT", left[0], fails, n, tuple(log)
            k += 1
            continue
        fails += 1
        if fails >= tries:
            if len(left) == 1:
                return "DROP", left[0], fails, n, tuple(log)
            left, k, fails = left[1:], 0, 0


def test_rounds_are_what_each_case_comes_to(spark):
    rows = [(1, 0, 0, False), (2, 1, 0, False), (3, 1, 2, False), (4, 9, 0, False), (5, 0, 9, False), (6, 0, 0, True), (None, 0, 1, False), (2, 1, 0, False), (None, 0, 1, False)]
    stages = [by_need("first", "a"), by_need("second", "b")]
    for ways in (None, ["x", "y"]):
        at = scratch(spark, "rounds")
        column = None if ways is None else F.array(*map(F.lit, ways))
        df = spark.createDataFrame(rows, CASES)
        rounds.begin(df.where("id < 3"), at, "id", ways=column)
        assert rounds.step(spark, at, stages, 3)
        assert rounds.begin(df, at, "id", ways=column).count() == 7  # none of the first two is settled yet
        assert rounds.begin(df, at, "id", ways=column).count() == 7
        got = settled(rounds.run(spark, at, stages, 3))
        assert got == sorted(((i, *one_case(a, b, o, ways, 3)) for i, a, b, o in dict.fromkeys(rows)), key=str)
        assert not rounds.step(spark, at, stages, 3)


def test_a_round_that_breaks_off_leaves_nothing_and_pays_nothing_twice(spark, tmp_path):
    asked, at, ledger = tmp_path / "asked", scratch(spark, "rounds"), scratch(spark, "ledger")
    asked.mkdir()

    def make():
        def generate(prompts):
            for p in prompts:
                with open(asked / p, "a") as f:
                    f.write("x")
            return [p[::-1] for p in prompts]

        return generate

    def work(broken):
        def f(df):
            out = models.paid_once(df.withColumn("prompt", F.concat_ws("-", "id", "tries")), make, "prompt", ledger)
            if broken:
                out = out.withColumn("answer", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("answer")))
            return out.withColumn("got", F.col("answer")).withColumn("verdict", F.when((F.col("id") == 2) & (F.col("tries") == 0), None).otherwise("ok"))

        return f

    rounds.begin(spark.createDataFrame([(i, "") for i in range(5)], "id long, got string"), at, "id")
    with pytest.raises(Exception, match="lost"):
        rounds.step(spark, at, [rounds.Stage("ask", work(True))], 2)
    assert published.versions(spark, at) == [1] and rounds.open_rows(spark, at).count() == 5
    out = rounds.run(spark, at, [rounds.Stage("ask", work(False))], 2)
    assert sorted((r.id, r.got, r.tries) for r in out.collect()) == [(i, ("1-2" if i == 2 else f"0-{i}"), int(i == 2)) for i in range(5)]
    assert {f.name: f.read_text() for f in asked.iterdir()} == {**{f"{i}-0": "x" for i in range(5)}, "2-1": "x"}


def test_rounds_of_nothing_and_faults(spark):
    at = scratch(spark, "rounds")
    none = spark.createDataFrame([], CASES)
    rounds.begin(none, at, "id")
    assert rounds.run(spark, at, [by_need("first", "a")], 2).count() == 0
    with pytest.raises(ValueError, match="log"):
        rounds.begin(none.withColumn("log", F.lit(1)), at, "id")
    rounds.begin(spark.createDataFrame([(1, 0, 0, False)], CASES), at, "id")
    with pytest.raises(Exception, match="no such stage"):
        rounds.step(spark, at, [rounds.Stage("s", lambda df: df.withColumn("verdict", F.lit("nowhere")))], 2)


def made_mail(n, seed=5):
    """Messages as (header lines, body lines) with all that may be mistaken for a message's start."""
    rnd = random.Random(seed)
    lines = ["plain words", "", "From here on", ">From there", ">>From afar", "From", "héllo wörld", "x" * 300, "> quoted", " From x"]
    return [[rnd.choice(lines) for _ in range(rnd.choice([0, 1, 3, 12]))] for _ in range(n)]


def as_mbox(path, mails):
    with open(path, "wb") as f:
        for k, body in enumerate(mails):
            kept = [re.sub(r"^(>*From )", r">\1", x) for x in body]
            head = [f"From a@b {k}", f"From: p{k}@x", f"Message-ID: <{k}>", f"Subject: s{k}", "Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: 8bit", ""]
            f.write("\n".join(head + kept).encode() + b"\n\n" * bool(kept) + b"\n" * (not kept))


@pytest.mark.parametrize("crossing", [1, 7, 100, 999, 10**6])
def test_ranges_of_an_mbox_have_each_message_once(tmp_path, crossing):
    mails = made_mail(60)
    as_mbox(tmp_path / "a.mbox", mails)
    size = (tmp_path / "a.mbox").stat().st_size
    starts = [m.start() for m in re.finditer(rb"^From ", (tmp_path / "a.mbox").read_bytes(), re.M)]
    for body in (True, False):
        found = []
        with open(tmp_path / "a.mbox", "rb") as f:
            for a in range(0, size, crossing):
                found += [(at, mbox.fields(raw, ["message_id", "body"] if body else ["message_id"], "f", at, True)) for at, raw in mbox.messages(f, a, min(a + crossing, size), body)]
        assert [at for at, _ in found] == starts
        assert [x[0] for _, x in found] == [f"<{k}>" for k in range(60)]
        if body:
            assert [x[1].rstrip("\n") for _, x in found] == ["\n".join(b).rstrip("\n") for b in mails]
            whole = [m.get_payload(decode=True).decode() for m in mailbox.mbox(tmp_path / "a.mbox")]
            assert [re.sub(r"(?m)^>(>*From )", r"\1", w).rstrip("\n") for w in whole] == [x[1].rstrip("\n") for _, x in found]


def test_mail_is_read_by_planned_splits(spark, tmp_path):
    mails = made_mail(40)
    (tmp_path / "box").mkdir()
    as_mbox(tmp_path / "box" / "a.mbox", mails)
    as_mbox(tmp_path / "box" / "b.mbox", mails[:3])
    (tmp_path / "box" / "_hidden").write_text("From x\n\nno\n")
    whole = mbox.read_mail(spark, str(tmp_path / "box"), split=2000)
    assert whole.rdd.getNumPartitions() > 4
    assert sorted((r.file[-6:], r.message_id, r.body.rstrip("\n")) for r in whole.collect()) == sorted((n, f"<{k}>", "\n".join(b).rstrip("\n")) for n, part in (("a.mbox", mails), ("b.mbox", mails[:3])) for k, b in enumerate(part))
    pruned = mbox.read_mail(spark, f"file://{tmp_path}/box", schema="subject string, receivers string", files="*b.mbox")
    assert sorted(map(tuple, pruned.collect())) == [(f"s{k}", None) for k in range(3)] and pruned.rdd.getNumPartitions() == 1
    (tmp_path / "dir").mkdir()
    odd = [b"", b"no header at all", b"From: =?bad?=\nSubject: [\n\nx", b"Content-Type: text/plain; charset=none-such\n\n\xe9", b"From: a@b\r\nSubject: long\r\n\r\nline\r\nFrom you\r\n", b"Subject: " + b"y" * 100_000 + b"\n\nend"]
    for k, raw in enumerate(odd):
        (tmp_path / "dir" / f"{k}.").write_bytes(raw)
    single = mbox.read_mail(spark, str(tmp_path / "dir"), "files")
    assert single.rdd.getNumPartitions() == 1
    assert [r.body for r in sorted(single.collect())] == ["", "", "x", "é", "line\nFrom you\n", "end"]
    assert mbox.read_mail(spark, str(tmp_path / "dir"), "files", split=1).rdd.getNumPartitions() == len(odd)
    (tmp_path / "none").mkdir()
    assert mbox.read_mail(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        mbox.read_mail(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(Exception, match="no such fields"):
        mbox.read_mail(spark, str(tmp_path / "box"), schema="colour string").count()


def test_splits_grow_with_what_there_is_to_read(spark, tmp_path):
    mails, most = made_mail(400), mbox.A_CORE * spark.sparkContext.defaultParallelism
    as_mbox(tmp_path / "a.mbox", mails)
    whole = mbox.read_mail(spark, str(tmp_path), schema="subject string, at long, body string", split=256)
    assert most // 2 <= whole.rdd.getNumPartitions() <= most < (tmp_path / "a.mbox").stat().st_size // 256
    assert sorted((int(r.subject[1:]), r.body.rstrip("\n")) for r in whole.collect()) == [(k, "\n".join(b).rstrip("\n")) for k, b in enumerate(mails)]
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip" / "a.eval", "w") as z:
        for k in range(300):
            z.writestr(f"{k}.json", str(k))
    dealt = mbox.read_zipped(spark, str(tmp_path / "zip"), split=64)
    assert dealt.rdd.getNumPartitions() <= most and sorted(int(r.content) for r in dealt.collect()) == list(range(300))


def test_equal_headers_are_parsed_once(monkeypatch):
    import email.headerregistry

    parsed, call = [], email.headerregistry.HeaderRegistry.__call__
    monkeypatch.setattr(email.headerregistry.HeaderRegistry, "__call__", lambda self, name, value: parsed.append(name) or call(self, name, value))
    for k in range(100):
        raw = f"From: Ada <ada@once.example>\nSubject: once {k}\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nwörds\n".encode()
        assert mbox.fields(raw, ["sender", "subject", "body"], "f", 0, True) == ("Ada <ada@once.example>", f"once {k}", "wörds")
    assert parsed.count("Subject") == 100 and len(parsed) < 110


def test_a_body_is_what_the_standard_parser_finds():
    import email
    import email.policy

    from mailquarry.functions import udf as U

    part = b"--b\nContent-Type: text/html\n\n<p>\n--b\nContent-Type: text/plain; charset=latin-1\n\n\xe9 part\n--b--\n"
    heads = [
        b"", b"\n", b"\r\n", b"Subject: a\n\n", b"Subject: a\r\n\r\n", b"Subject: a\n\r\n", b"no header\n\n", b" begins folded\nSubject: a\n\n", b"Subject: a\nnot a header\nX: b\n\n", b"Subject: a\n", b"Subject: a",
        b"Content-Type: multipart/mixed; boundary=b\n\n", b"Content-Type: multipart/mixed\n\n", b"Content-Type: message/rfc822\n\n", b"Content-Type: text/html\n\n", b"Content-Type: image/png\n\n", b"Content-Type: nonsense\n\n",
        b"Content-Type: text/plain; charset=none-such\n\n", b"Content-Type: text/plain; charset=latin-1\n\n", b"Content-Transfer-Encoding: base64\n\n", b"Content-Transfer-Encoding: quoted-printable\n\n", b"Content-Disposition: attachment\n\n",
        b"Subject: =?bad?=\n\n", b"Subject: \xc3\xa9\n folded\n\n", b"Subject: " + b"y" * 1000 + b"\n\n",
    ]
    bodies = [b"", b"x", b"\n", b"From: inner\n\ninner\n", b"one\r\n\r\ntwo\rthree\x0bfour\x85\n", "wörds\u2028é".encode(), b"aGVsbG8=\n", b"=E9=\nx", part, b"\xff\x00\n"]
    for raw in (h + b for h in heads for b in bodies):
        m = email.message_from_bytes(raw, policy=email.policy.default)
        subject = None if m["Subject"] is None else str(m["Subject"]).encode("utf-8", "replace").decode()
        try:
            want = subject, U.plain_text(m)
        except Exception as e:  # noqa: BLE001  where the parser gives up, so does this
            with pytest.raises(type(e)):
                mbox.fields(raw, ["subject", "body"], "f", 0, False)
            continue
        assert mbox.fields(raw, ["subject", "body"], "f", 0, False) == want, raw


def test_escaped_lines_above_an_empty_line_with_a_return():
    assert mbox.fields(b"Subject: a\n\n>From b\r\n\r\n>>From c\n", ["body"], "f", 0, True) == ("From b\n\n>From c",)


def test_members_of_archives_are_dealt_out(spark, tmp_path):
    for name, n in (("a.eval", 30), ("b.eval", 2), ("c.eval", 0)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("header.json", "{}")
            for k in range(n):
                z.writestr(f"samples/{k}.json", json.dumps({"sample": f"{name}{k}", "epoch": 1, "logged": "2001", "values": '{"found": %d}' % (k % 2), "answer": "é" * 50}))
    logs = mbox.read_zipped(spark, str(tmp_path), "samples/*.json", split=1500)
    assert logs.rdd.getNumPartitions() > 3
    assert sorted(json.loads(r.content)["sample"] for r in logs.collect()) == sorted([f"a.eval{k}" for k in range(30)] + ["b.eval0", "b.eval1"])
    assert mbox.read_zipped(spark, str(tmp_path), schema="member string").where("member = 'header.json'").count() == 3
    rows = mail.rows_of_samples(mbox.read_zipped(spark, str(tmp_path), "samples/*.json", "content string"))
    assert sorted((r.sample, r.found) for r in rows.where("sample like 'b%'").collect()) == [("b.eval0", "0"), ("b.eval1", "1")] and rows.count() == 32


def test_what_a_reranker_names_is_shown(spark):
    handles = [f"e{k}" for k in (5, 3, 12, 1, 7)]
    said = {0: "e1, then e12 (e1 again), e99, e7", 1: "none of these", 2: None, 3: "e3e5"}
    rows = [(q, k + 1, h, s) for q, s in said.items() for k, h in enumerate(handles)] + [(4, 1, "e5", "e3 e5"), (4, 2, "e3", "e3 e5")]
    got = {}
    for r in S.reranked(spark.createDataFrame(rows, "qid int, rank int, handle string, said string"), "said", 2).orderBy("qid", "shown").collect():
        got.setdefault(r.qid, []).append(r.handle)
    assert got == {0: ["e1", "e12"], 1: ["e5", "e3"], 2: ["e5", "e3"], 3: ["e3", "e5"], 4: ["e5", "e3"]}


def test_search_with_a_reranker(spark):
    rows = [(k, 0, k, "a", f"budget {k}", "budget " * (9 - k), "2001-01-01") for k in range(6)]
    box = Mailbox(spark.createDataFrame(rows, "thread int, position int, id int, sender string, subject string, body string, date string"), pool=5, show=2)
    asked = []
    first = [r.handle for r in box.search("budget")]
    assert len(first) == 2 and len(box.log[-1]["returned"]) == 5
    pool = box.log[-1]["returned"]
    told = lambda q, lines, n: asked.append((q, lines.count("\n"), n)) or f"{pool[4]} and {pool[0]}"
    assert [r.handle for r in box.search("budget", reranker=told)] == [pool[4], pool[0]] and asked == [("budget", 4, 2)]
    assert [r.handle for r in box.search("budget", reranker=lambda *_: "sorry")] == first == pool[:2]
    box.close()
    with pytest.raises(ValueError):
        Mailbox(spark.createDataFrame(rows, "thread int, position int, id int, sender string, subject string, body string, date string"), show=0)
