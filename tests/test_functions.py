"""Text functions at the edges where engines and readings differ."""

from pyspark.sql import functions as F

from mailquarry.functions import parse as P
from mailquarry.functions import text as T
from mailquarry.functions import udf as U


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_two_tokenisers(spark):
    assert one(spark, T.tokenize("t"), t="The A1 b of café, re: x9 x9") == ["a1", "caf", "x9", "x9"]
    assert one(spark, T.query_tokens("t"), t="The a b A") == ["the", "a", "b"]
    assert one(spark, T.tokenize(F.lit(None).cast("string"))) == []


def test_jaccard_of_nothing_is_zero(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty)) == 0.0
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_bodies(spark):
    cases = {
        "x ----- Forwarded by A ----- y": "x y", "a\nForwarded by Bo on\nb": "a b", "From: a\nSubject: b\ntext": "text", "mail ada.b+c@x.example now": "mail now", "call 713-853-5620 (phone) now": "call now",
        "q (fax) r": "q r", "room EB 3801a end": "room end", "at 1400 Smith Street here": "at here", "in Houston, Texas 77002 ok": "in ok", "Ada/HOU/ECT said": "Ada said", "on 10/13/2000 04:15 PM we": "on we",
        "a / , b": "a, b", "  many\r\n\tspaces ": "many spaces",
    }
    rows = spark.createDataFrame(list(cases), "string").select("value", T.clean_body("value").alias("x")).collect()
    assert {r.value: r.x for r in rows} == cases
    assert one(spark, T.clean_body("t"), t="a---cut---b") == "a b"


def test_era(spark):
    for given, want in {"2024-05-10": "2001-05-10", "1999-01-01T09": "1999-01-01T09", "1980-01-01": "2001-01-01", "soon": "soon", "2003-1-1": "2003-1-1"}.items():
        assert one(spark, T.clamp_era("t"), t=given) == want


def test_receipts(spark):
    cases = {"Thanks, noted.": "Thanks, noted.", "Thank you\nAda Reed": "Thank you", "thanks thanks thanks": None, "Thanks Bob": None, "Thanks!": None, "Got it 4": None, "Noted\nfiled\ndone": None, "Thanksgiving": None, "Ok": None, "": None}
    rows = spark.createDataFrame(list(cases), "string").select("value", T.receipt("value").alias("x")).collect()
    assert {r.value: r.x for r in rows} == cases


def test_relabel_leaves_strangers(spark):
    people = [("Ada Reed", "Person A"), ("Bo Lund", "Person B")]
    cases = {"Ada Reed wrote": "Person A wrote", "Ada Stone wrote": "Ada Stone wrote", "ask Ada today": "ask Person A today", "Bo St. Lund": "Person B", "Old Reed": "Old Reed", "the Reed memo": "the Person A memo", "Ada Bo Lund": "Person A Person B"}
    rows = spark.createDataFrame(list(cases), "string").select("value", T.relabel("value", people).alias("x")).collect()
    assert {r.value: r.x for r in rows} == cases


def test_substitutions_are_ordered(spark):
    rules = T.substitutions([("Ada Reed", "ada@a.example", "Una May", "una@z.example")], [("@a.example", "@z.example")], [("Acme", "Zeta")])
    assert one(spark, T.replace_all(F.col("t"), rules), t="ADA@a.example, bo@A.example: Ada Reed, Ada, Reed of Acme, Acmes") == "una@z.example, bo@z.example: Una May, Una, May of Zeta, Acmes"


def test_template_values_are_filled_in_turn(spark):
    assert one(spark, T.fill(F.lit("<<A>>-<<B>>"), {"A": F.lit("<<B>>"), "B": F.lit("x")})) == "x-x"
    assert one(spark, T.fill(F.lit("<<A>>-<<B>>"), {"B": F.lit("<<A>>"), "A": F.lit("y")})) == "y-y"


def test_carriers(spark):
    assert one(spark, T.carrier_absent("c", "b"), c="the letter of", b="x") == ["<no carrier given>"]
    assert one(spark, T.carrier_absent("c", "b"), c="pipeline tariff pipeline docket", b="docket tariff") is None
    assert one(spark, T.carrier_absent("c", "b"), c="pipeline tariff pipeline", b="tariff") == ["pipeline", "pipeline"]


def test_prose(spark):
    good = "Word " * 30 + "end."
    assert one(spark, T.is_clean_prose("t"), t=good) and not one(spark, T.is_clean_prose("t"), t=good.upper()) and not one(spark, T.is_clean_prose("t"), t="Too short.")


def test_python_functions():
    assert U.ascii_of("“Café” – ﬁn…") == '"Cafe" - fin...'
    assert U.wrapped("aaa bbb ccc\n\nverylongword x", 7) == "aaa bbb\nccc\n\nverylongword\nx"
    cases = {'a {"x": "}{"} b': {"x": "}{"}, "```json\n{\"a\": 1}\n```": {"a": 1}, "{bad} then {\"b\": [2]}": {"b": [2]}, "none": None, "[1]": None, None: None}
    assert {k: U.first_json(k) for k in cases} == cases
    assert U.ascii_of("a \u2014 b\u2022c\u00b7d\u2010e\u2011f\u2012g\u2015h\u00a0i\u2009j\u202fk\u200bl\ufeffm") == "a -- b-c-d-e-f-g--h i j klm"
    assert U.mime_body(b"From: ada@x.example\nContent-Type: text/plain\n\nhello\n> quoted") == ("ada@x.example", "hello")
    assert U.mime_body(None)[1] == ""


def test_json_is_found_in_linear_time():
    import json
    import time

    began = time.time()
    assert U.first_json("{" * 200_000) is None
    assert U.first_json('{"a":' * 100_000) is None
    assert U.first_json('{"a":' * 100_000 + "bad" + "}" * 100_000) is None
    assert U.first_json('{"a":' * 100_000 + "1" + "}" * 100_000) is None
    assert U.first_json('{"a": "x' * 20_000 + '{"b": 1}') == {"b": 1}
    assert time.time() - began < 20
    cases = {'{"a": {"b": 1}, bad': {"b": 1}, '{"not {"a":1}': {"a": 1}, '{"a" 1} {"c": "}"}': {"c": "}"}, "{} x": {}, '{"a": [1, {"b": [2,]}, {"c": 3}]}': {"c": 3}, '{"a":1,}{"b":-1.5e3}': {"b": -1500.0}, '[{"a": null}]': {"a": None}, '{"a":tru}': None, '{"a\n": 1}': None}
    assert {k: U.first_json(k) for k in cases} == cases

    def brute(s):
        for i, c in enumerate(s):
            if c == "{":
                try:
                    found, _ = json.JSONDecoder().raw_decode(s, i)
                except ValueError:
                    continue
                return found
        return None

    import random

    rnd = random.Random(5)
    for _ in range(4000):
        s = "".join(rnd.choice(['{"a":', "{", "}", '"', "[", "]", ",", ":", "1", " ", '"b"', "null", '{"c":2}']) for _ in range(rnd.randint(1, 14)))
        assert U.first_json(s) == brute(s), s


def test_rules_for_json_in_prose():
    import itertools
    import json
    import random
    import time

    assert U.balanced_json('x {"a": "}"} {') == {"a": "}"} and U.balanced_json('{bad} {"a": 1}') is None and U.balanced_json('{"a": 1') is None
    assert U.balanced_json('a [1, "]", [2]] ]', "[") == [1, "]", [2]] and U.balanced_json(None) is U.balanced_json("", "[") is None
    assert U.balanced_json('it"s {"a": "b\\"}"}') == {"a": 'b"}'}
    assert U.fenced_json('```json\n{"a": {"b": 1}}\n```') == {"a": {"b": 1}} == U.fenced_json('```{"a": {"b": 1}}```') == U.fenced_json('so: {"a": {"b": 1}} !')
    assert U.fenced_json('{"a": 1} {"b": 2}') is U.fenced_json("} {") is U.fenced_json(None) is None
    assert U.counted_json('{bad} {"a": "}"}') == {"a": "}"} and U.counted_json('{bad} {"a": "}"}', False) is None
    assert U.counted_json('{"a": "\\"{"} {"b": 1}') == {"b": 1} and U.counted_json('{"a": {"b": "{"}, "c": {}}', False) == {}

    def brute(s, quotes):
        for i in (i for i, c in enumerate(s) if c == "{"):
            depth, inside = 0, False
            for j, c in enumerate(s[i:], i):
                if quotes and c == '"':
                    inside = not inside
                depth += 0 if inside else (c == "{") - (c == "}")
                if not depth and not inside:
                    try:
                        return json.loads(s[i : j + 1])
                    except ValueError:
                        break
        return None

    rnd = random.Random(11)
    parts = ["{", "}", '"', '"a":', "1", ",", "\\", '"x"', '{"b":2}', "[", "]", " "]
    for _ in range(20_000):
        s = "".join(rnd.choices(parts, k=rnd.randrange(14)))
        assert [U.counted_json(s, q) for q in (True, False)] == [brute(s, q) for q in (True, False)], s
    began, n = time.time(), 100_000
    for s in ("{" * n, '{"a":' * n, '{"a":' * n + "1" + "}" * n, '{"a":' * n + "bad" + "}" * n, '{"' * n, '{"a\\"{' * n, '{"a": "' + "{" * n + '"}', '"' * n + "{" * n, '{"a": "{\\"b\\":' * n, "}" * n + "{}", "[" * n, "```" * n):
        for rule in (U.balanced_json, U.fenced_json, U.counted_json, lambda x: U.counted_json(x, False), lambda x: U.balanced_json(x, "[")):
            rule(s)
    assert time.time() - began < 60


def test_reground(spark):
    names = {"Person A": "Ada Reed", "Person B": "Bo Ek", "Person J": "Jo"}
    cases = {
        "Person A's and personA@x, PERSON_B, person-b, PersonA.": "Ada Reed's and ada.reed@x, Bo Ek, Bo Ek, Ada Reed.",
        "Annex A's, option  B's, Exhibit A's stay; A's own, Dr. A, Dr A, Mrs. B, candidate J, J candidacy": "Annex A's, option  B's, Exhibit A's stay; Ada Reed's own, Dr. Ada Reed, Dr Ada Reed, Mrs. Bo Ek, candidate Jo, Jo candidacy",
        "A application, Mr D, Personal A, <<FIRM>>": "A application, Mr D, Personal A, Acme",
        "": "",
    }
    rows = spark.createDataFrame([*map(list, zip(cases)), [None]], "value string").select("value", T.reground("value", names, [("<<FIRM>>", "Acme")]).alias("a"), T.labels_left("value").alias("left"), T.labels_in("value").alias("names"))
    got = {r.value: r for r in rows.collect()}
    assert {k: got[k].a for k in cases} == cases and got[None].a == ""
    assert got[list(cases)[1]].left == ["A's", "Dr. A", "Dr A", "Mrs. B", "candidate J", "J candidacy"]
    assert got[list(cases)[0]].names == ["Person A"]


def test_steps(spark):
    cases = {"THOUGHT: a\nACTION: SEARCH tariff filing": ("SEARCH", "tariff filing"), 'ACTION: ANSWER {"found": false}': ("ANSWER", '{"found": false}'), "ACTION: ANSWER READ e5\nx": ("READ", "e5"), '{"found": true}': ("ANSWER", '{"found": true}'), "ACTION: ANSWER maybe": (None, None)}
    tool, arg = P.step("value")
    rows = spark.createDataFrame(list(cases), "string").select("value", tool.alias("a"), arg.alias("b")).collect()
    assert {r.value: (r.a, r.b) for r in rows} == cases


def test_style_of_nothing(spark):
    row = T.stylometrics(spark.range(1).select(F.lit("").alias("t")), "t").first()
    assert row.log_chars == 0 and row.lines == 1 and row.types == 0


def test_mail_behind_its_header(spark):
    import itertools
    import random
    import re

    quote = re.compile(r"^\s*(>|-{3,}|_{3,}|from:|to:|sent:|subject:|cc:|original message|forwarded)", re.I)

    def brute(text):
        lines = (text or "").splitlines()
        start = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
        kept = list(itertools.takewhile(lambda x: not quote.match(x), lines[start + 1 :]))
        full = [i for i, x in enumerate(kept) if x.strip()]
        return kept[full[0] : full[-1] + 1] if full else []

    rnd = random.Random(2)
    parts = ["From: a", "", " ", " hello", "you", "\u00a0", "> quoted", " ----", "--", "Forwarded by", "x" * 5000]
    texts = [None, "", "From: a", "\n", "a\n\n b \n", "a\r\n\r\nb\r\n"] + [rnd.choice(["\n", "\r\n"]).join(rnd.choices(parts, k=rnd.randrange(9))) for _ in range(400)]
    assert brute("From: a\nTo: b\n\n\n hello\n\nyou\n \n> quoted\nmore") == [" hello", "", "you"]
    got = spark.createDataFrame([[t] for t in texts], "t string").select("t", T.mail_lines("t").alias("m")).collect()
    assert [r.m for r in got] == [brute(r.t) for r in got]


def test_prose_behind_a_json_value_is_no_json_object(spark):
    texts = ['{"found": true}', ' {"a": {}} ', "4703 Acht und <a@b>", '"said" he', "true words", "[1] cited", "{} and more }", "{}, {}", "{}] x", "{}} x", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = {r.i: r.j for r in df.select("i", P.whole_object("raw").alias("j")).collect()}
    assert [i for i, j in got.items() if j is not None] == [0, 1]


def test_topics_of_many_files_keep_the_last_line(spark, tmp_path):
    """The later file counts, also where it is the smaller one, which a scan reads last to first; lines are not read as one text."""
    from mailquarry.sources import mail

    pad = "x" * 2000
    (tmp_path / "part-0.json").write_text("".join(f'{{"id": "{i}", "plot": "new?{pad}"}}\n' for i in range(50)))
    (tmp_path / "part-1.json").write_text("".join(f'{{"id": "{i}", "plot": "last"}}\n' for i in range(50)))
    (tmp_path / "part-2.json").write_text(f'{{"id": "7", "plot": "{pad * 90}"}}\n{{"id": "7", "plot": "end"}}\n')
    df = mail.load_topics(spark, str(tmp_path))
    assert {r.id: r.plot for r in df.collect()} == {str(i): "last" if i != 7 else "end" for i in range(50)}


def test_a_long_text_of_names_is_relabelled_fast(spark):
    import time

    df = spark.createDataFrame([(("Abcdefghij klmnopqrst " * 20_000) + "Vorst left. Old Vorst stayed. Quilla met him.",)], "t string")
    started = time.time()
    got = df.select(T.relabel("t", [("Quilla Vorst", "Person A")]).alias("x")).first().x
    assert got.endswith("Person A left. Old Vorst stayed. Person A met him.") and time.time() - started < 30


def _plainly(c, names):
    """reground() as every rule after the other."""
    rules = []
    for x, n in names.items():
        spelt = f"(?i)\\bperson[\\s_-]*{x}\\b"
        rules += [(spelt + "(?=@)", n.lower().replace(" ", ".")), (spelt, n)]
    thing = f"(?<!(?i:\\b(?:{'|'.join(T.NO_PERSON_AFTER)})\\s{{1,40}}))"
    rules += [(f"\\b(?={x}'s\\b){thing}{x}(?='s\\b)", n) for x, n in names.items()]
    rules += [(f"\\b({'|'.join(T.TITLES)}){x}\\b", f"$1{n}") for x, n in names.items()]
    return T.replace_all(c, rules + [(f"\\b{x}(?=\\s+candidacy\\b)", n) for x, n in names.items()])


def test_labels_are_looked_for_where_they_can_be(spark):
    """The same as rule after rule, whatever stands together; in texts without most of them in less time."""
    import random
    import time

    rnd = random.Random(6)
    parts = ["Person A", "person_b", "PERSON-C", "personA@x", "person", " ", "_", "-", "A", "B's", "A's", "Plan A's", "Mr. ", "Mrs B", "Dr\nC", "candidate A", "C candidacy", "B  candidacy", "x", ".", "@", "\n", "é", "Persona", "Ada"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for full in (["Ada Reed", "Bo Ek", "Cy Dahl"], ["B. Reed", "Person C", "Mr A"]):
        names = dict(zip("ABC", full))
        both = df.select(T.reground("t", {f"Person {x}": n for x, n in names.items()}).alias("x"), _plainly(F.col("t"), names).alias("y"))
        assert both.where("x <> y").count() == 0 and both.where("x <> ''").count() > 2000
    names = dict(zip("ABCDEFGHJ", ["Ada Reed"] * 9))
    long = spark.range(40).select(F.concat(F.lit("Person A: "), F.repeat(F.lit("nobody is named in these plain words, "), 2000)).alias("t")).cache()
    long.count()
    took = []
    for c in (T.reground("t", {f"Person {x}": n for x, n in names.items()}), _plainly(F.col("t"), names)):
        began = time.time()
        long.select(c.alias("t")).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[0] < 0.6 * took[1]
