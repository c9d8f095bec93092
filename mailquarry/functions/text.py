"""Text functions as columns: no Python runs on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words that ranked search leaves out.
STOPWORDS = tuple(
    "a an the of to in for on with by from is are was were be been this that these those it its as at and or we you they he "
    "she his her their our your i not have has had will would can could should may might must do does did about into over "
    "under after before while which who whom whose what when where why how them then than out up down off no any all some more "
    "most other such only own same but if because so very also just we'll re fw fwd please thanks thank you let know need want "
    "get got would like".split()
)
# Nouns too common to tie a carrier to a message.
CARRIER_STOPWORDS = tuple("the a an of for with and to s our their its agreement document letter notice filing form report status".split())
# The closed vocabulary of a receipt.
RECEIPT_WORDS = tuple(
    "thanks thank you got it received noted will do does file filed filing log logged keep kept confirmed confirm understood "
    "acknowledged all set good to go done on much again now here in have this for the a so great perfect fine and of receipt "
    "your yours message note am i we ll ve record copy them that".split()
)
# How a receipt starts, and what rules one out.
RECEIPT_START = "(?i)^(thanks?|thank you|got it|received|noted|will do|will file|will keep|filed|logged|understood|acknowledged|confirmed|all set|good to go|on it)([^A-Za-z0-9_]|$)"
RECEIPT_DROP = "(?i)(^|[^A-Za-z0-9_])(bye|crush|baby|buddy|grouch|god|news|idea|job|lunch|beer|fun|luck|deal|cool|sir)([^A-Za-z0-9_]|$)|[!?]|[:;]-?[)(dpDP]"
BARE_NAME = "^[ \\t]*[-\u2013]*[ \\t]*[A-Z][a-z]+([ \\t]+[A-Z]\\.?)?([ \\t]+[A-Z][a-z]+)?[ \\t]*$"
# Boilerplate of forwarded mail, in the order in which it is taken out; routing tags are a parameter.
KINDS = "phone|fax|cell|tel|telephone|direct|office|mobile|main"
BODY_RULES = (
    ("-{3,}.*?-{3,}", " "),
    ("(?i)\\bForwarded by[^\\n]*", " "),
    ("(?i)\\b(From|To|cc|bcc|Sent|Subject|Date)\\s*:\\s*[^\\n]*", " "),
    ("[\\w.+-]+@[\\w.-]+", " "),
    (f"(?i)\\b\\d{{3}}[-.\\s]\\d{{3}}[-.\\s]\\d{{4}}\\b\\s*\\(?\\s*({KINDS})?\\s*\\)?", " "),
    (f"(?i)\\(\\s*({KINDS})\\s*\\)", " "),
    ("\\bEB\\s*\\d{3,4}[a-z]?\\b", " "),
    ("\\b\\d{1,5}\\s+[A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+){0,3}\\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Suite|Ste|Floor|Fl)\\b\\.?", " "),
    ("\\b[A-Z][a-zA-Z]+,\\s+[A-Z][a-zA-Z]{2,}\\s+\\d{5}(?:-\\d{4})?\\b", " "),
    ("{routing}", " "),
    ("\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\b(\\s+\\d{1,2}:\\d{2}\\s*[AP]M)?", " "),
    ("\\s+/\\s+,", ","),
    ("\\s+", " "),
)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, f) -> Column:
    """f of the value, which is computed once however often f's lambdas look at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(c: Column | str) -> Column:
    """Tokens for search and statistics: runs of two or more ASCII letters or digits, lower case, repeats included."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]{2,}"), F.lit(0))


def tokenize(c: Column | str, stop: Sequence[str] = STOPWORDS) -> Column:
    """words() less stop words."""
    return F.filter(words(c), lambda w: ~w.isin(*sorted(set(stop))))


#: What begins a quoted or forwarded part.
QUOTE_MARKS = ">|-{3,}|_{3,}|from:|to:|sent:|subject:|cc:|original message|forwarded"
_LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def mail_lines(c: Column | str) -> Column:
    """The lines of a plain mail behind its header, which is what stands before the first blank line, up to a quoted or forwarded
    line and without blank lines at either end; none without a blank line."""
    first = lambda a, f: F.array_position(F.transform(a, f), F.lit(True)).cast("int")
    blank, said = lambda x: ~x.rlike("(?U)\\S"), lambda x: x.rlike("(?U)\\S")
    behind = let(F.split(_text(c), _LINE_END), lambda a: let(first(a, blank), lambda p: F.when(p > 0, F.slice(a, p + 1, F.size(a))).otherwise(F.slice(a, 1, 0))))
    kept = let(behind, lambda a: let(first(a, lambda x: x.rlike(f"(?iU)^\\s*(?:{QUOTE_MARKS})")), lambda p: F.when(p > 0, F.slice(a, 1, p - 1)).otherwise(a)))
    return let(kept, lambda a: let(first(a, said), lambda p: F.when(p > 0, F.slice(a, p, F.size(a) - first(F.reverse(a), said) + 2 - p)).otherwise(F.slice(a, 1, 0))))


def topic_signature(*fields: Column | str) -> Column:
    """The set of words in a topic's fields, by which topics are told apart; sorted, so that equal sets are equal arrays."""
    return F.array_sort(F.array_distinct(tokenize(F.concat_ws(" ", *fields))))


def query_tokens(c: Column | str) -> Column:
    """The set of tokens by which searches are compared: single characters count, stop words too."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def replace_all(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Ordered substitutions in one projection; later rules see what earlier ones made."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def clean_body(c: Column | str, routing: Sequence[str] = ("HOU", "ECT", "NA", "LON", "Corp")) -> Column:
    """A message body without forwarding lines, headers, addresses, phones, routing tags and dates, in single spaces."""
    tags = f"\\b/?({'|'.join(routing)})\\b(/\\w+)*"
    return F.trim(replace_all(_text(c), [(tags if p == "{routing}" else p, r) for p, r in BODY_RULES]))


def oneline(c: Column | str, n: int) -> Column:
    """Single spaces, n characters at most."""
    return F.substring(F.trim(F.regexp_replace(_text(c), "[ \\t\\r\\n\\f]+", " ")), 1, n)


def clamp_era(c: Column | str, first: int = 1999, last: int = 2002, default: str = "2001") -> Column:
    """A date string whose year lies outside gets the default year; what is no date stays."""
    s = _text(c)
    year = F.regexp_extract(s, "^(\\d{4})(-\\d{2}-\\d{2}.*)$", 1)
    out = (year != "") & ~F.coalesce(year.try_cast("int"), F.lit(0)).between(first, last)
    return F.when(out, F.concat(F.lit(default), F.substring(s, 5, 1 << 30))).otherwise(s)


def is_clean_prose(c: Column | str) -> Column:
    """25 to 140 words, few tabs and equals signs, not mostly capitals, at least one full stop and one small letter."""
    s = _text(c)
    n = F.size(F.filter(F.split(s, "[ \\t\\r\\n\\f]+"), lambda w: w != ""))
    letters, capitals = F.regexp_count(s, F.lit("[A-Za-z]")), F.regexp_count(s, F.lit("[A-Z]"))
    loud = (letters > 0) & (capitals / F.greatest(letters, F.lit(1)) > 0.4)
    return n.between(25, 140) & (F.regexp_count(s, F.lit("\\t")) <= 2) & (F.regexp_count(s, F.lit("=")) <= 3) & ~loud & s.contains(".") & s.rlike("[a-z]")


def receipt(c: Column | str) -> Column:
    """The short receipt that a body is, on one line; null if it is none. Of two or more lines a last bare name is dropped."""
    lines = F.filter(F.transform(F.split(_text(c), "\\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t\\r\\f]", " "))), lambda x: x != "")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    signed = (F.size(lines) >= 2) & last.rlike(BARE_NAME) & ~last.rlike(RECEIPT_START)
    kept = F.when(signed, F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    line = F.trim(F.regexp_replace(F.array_join(kept, " "), "[ \\t]{2,}", " "))
    known = F.array(*map(F.lit, sorted(set(RECEIPT_WORDS))))
    said = F.regexp_extract_all(F.lower(line), F.lit("[a-z]+"), F.lit(0))
    worn = let(said, lambda all_: F.exists(all_, lambda w: F.size(F.filter(all_, lambda v: v == w)) >= 3))
    ok = F.size(kept).between(1, 2) & line.rlike(RECEIPT_START) & ~line.rlike(RECEIPT_DROP) & ~line.rlike("(?i)http|@|www\\.") & ~line.rlike("[0-9]")
    ok = ok & F.length(line).between(6, 40) & (F.size(said) > 0) & F.forall(said, lambda w: F.array_contains(known, w)) & ~worn
    return F.when(ok, line)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """<<KEY>> by its value, key after key: what a value brings in is filled by later keys."""
    return reduce(lambda t, kv: F.replace(t, F.lit(f"<<{kv[0]}>>"), kv[1]), values.items(), template)


def relabel(c: Column | str, people: Sequence[tuple[str, str]]) -> Column:
    """Real names (name, label) to labels: whole names first, longest first; a first name before a label or not before a
    capitalised word; a last name with no capitalised word before it."""
    full = {n: label for n, label in people}
    for n, label in people:
        first, *rest = n.split()
        if len(rest) == 1:
            full |= {f"{first} St. {rest[0]}": label, f"{first} St {rest[0]}": label}
    quote = lambda n: "\\Q" + n + "\\E"
    # a name's letters come first in its pattern and what must stand around it is asked behind them: most places are passed by the
    # letters alone, and the look back over a capitalised word is not made at every place of a text
    named = lambda n: f"{quote(n)}(?<=\\b{quote(n)})\\b"
    rules = [(named(n), full[n]) for n in sorted(full, key=len, reverse=True)]
    firsts = {n.split()[0]: label for n, label in people}
    for n in sorted(firsts, key=len, reverse=True):
        rules += [(f"{named(n)}(?=\\s+Person\\b)", firsts[n]), (f"{named(n)}(?!\\s+[A-Z])", firsts[n])]
    lasts = {n.split()[-1]: label for n, label in people}
    rules += [(f"{named(n)}(?<![A-Z][a-z]{{1,40}}\\s{{1,4}}{quote(n)})", lasts[n]) for n in sorted(lasts, key=len, reverse=True)]
    return replace_all(_text(c), rules)


def substitutions(people: Sequence[tuple[str, str, str, str]], domains: Sequence[tuple[str, str]], companies: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Ordered rules from people (name, address, new name, new address): addresses, domains, whole names, first and last
    names, companies."""
    quote = lambda n: "\\Q" + n + "\\E"
    rules = [(f"(?i){quote(a)}", b) for _, a, _, b in people if a] + [(f"(?i){quote(d)}", e) for d, e in domains]
    rules += [(f"\\b{quote(n)}\\b", m) for n, _, m, _ in people]
    for n, _, m, _ in people:
        rules += [(f"\\b{quote(n.split()[0])}\\b", m.split()[0]), (f"\\b{quote(n.split()[-1])}\\b", m.split()[-1])]
    return rules + [(f"\\b{quote(c)}\\b", d) for c, d in companies]


def carrier_absent(carrier: Column | str, body: Column | str, need: float = 0.5) -> Column:
    """Null if enough of the carrier's telling words, repeats counted, stand in the body; else those that do not."""
    telling = carrier_words(carrier)
    absent = absent_words(carrier, body)
    return F.when(F.size(telling) == 0, F.array(F.lit("<no carrier given>"))).when(F.size(absent) > (1 - need) * F.size(telling), absent)


def carrier_words(carrier: Column | str) -> Column:
    return F.filter(tokenize(carrier, STOPWORDS + CARRIER_STOPWORDS), lambda w: F.length(w) > 2)


def absent_words(carrier: Column | str, body: Column | str) -> Column:
    """The carrier's telling words, repeats kept, that the body lacks."""
    return let(tokenize(body), lambda have: F.filter(carrier_words(carrier), lambda w: ~F.array_contains(have, w)))


def output_after(c: Column | str, marker: str, opener: str | None = None) -> Column:
    """What follows a marker such as </think>; without it, what stands before the opener."""
    s = _text(c)
    after = F.trim(F.regexp_extract(s, f"(?s){marker}\\s*(.*)", 1))
    before = F.trim(F.regexp_replace(s, f"(?s){opener}.*", "")) if opener else s
    return F.when(after != "", after).otherwise(before)


STYLE = ("log_chars", "log_words", "word_chars", "lines", "line_chars", "punctuation", "digits", "capitals", "commas", "enders", "caps_words", "function_words", "header", "sentence_words", "types")


def stylometrics(df: DataFrame, c: str, stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """df with 15 features of style, named as in STYLE. Letters are ASCII letters. What several features need is computed in
    a projection of its own."""
    s = F.col("_s")
    count = lambda p: F.regexp_count(s, F.lit(p)).cast("double")
    base = df.withColumn("_s", _text(c)).withColumn("_w", words("_s")).withColumn("_lines", count("\\n") + 1).withColumn("_ends", F.greatest(count("[.!?]+"), F.lit(1.0))).withColumn("_capitals", count("[A-Z]"))
    base = base.withColumn("_n", F.size("_w").cast("double"))
    w, n, chars, lines, sentences = F.col("_w"), F.col("_n"), F.length(s).cast("double"), F.col("_lines"), F.col("_ends")
    nw, nc = F.greatest(n, F.lit(1.0)), F.greatest(chars, F.lit(1.0))
    values = (
        F.log1p(chars), F.log1p(n), F.when(n > 0, F.length(F.array_join(w, "")) / nw).otherwise(0.0), lines, chars / lines,
        count("[^A-Za-z0-9 \\t\\r\\n\\f]") / nc, count("[0-9]") / nc, F.col("_capitals") / F.greatest(count("[A-Za-z]"), F.lit(1.0)), count(",") / nw, sentences / nw,
        F.size(F.filter(F.regexp_extract_all(s, F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda x: x == F.upper(x))) / nw,
        F.size(F.filter(w, lambda x: x.isin(*sorted(set(stop))))) / nw, s.rlike("Forwarded by|-----|Original Message|@ECT|cc:").cast("double"), n / sentences, F.size(F.array_distinct(w)) / nw,
    )
    return base.select(*df.columns, *[v.alias(name) for v, name in zip(values, STYLE)])


def scrub_labels(c: Column | str) -> Column:
    """Label residue out of file names and handles: PersonC, _H., H_ before a capital; doubled separators are one."""
    rules = (("[_-]?Person[ _]?[A-J](?![A-Za-z])", ""), ("[_-]([A-J])(?=[_.])", ""), ("\\b([A-J])[_-](?=[A-Z])", ""), ("[_-]{2,}", "_"))
    return replace_all(_text(c), rules)


def leaks(c: Column | str, names: Sequence[str]) -> Column:
    """Which of the names, as whole words, a text still has."""
    s = _text(c)
    found = [F.when(s.rlike("(^|[^A-Za-z0-9])\\Q" + n + "\\E([^A-Za-z0-9]|$)"), F.lit(n)) for n in names]
    return F.array_compact(F.array(*found))


def resolve_type(register: Column, kind: Column, legacy: dict[str, tuple[str, str]], registers: Sequence[str], kinds: Sequence[str]) -> Column:
    """(register, mechanism): a legacy kind carries both; else an unknown register is casual, an unknown kind commission."""
    out = F.struct(F.when(register.isin(*registers), register).otherwise("casual").alias("register"), F.when(kind.isin(*kinds), kind).otherwise("commission").alias("mechanism"))
    for name, (r, m) in legacy.items():
        out = F.when(kind == name, F.struct(F.lit(r).alias("register"), F.lit(m).alias("mechanism"))).otherwise(out)
    return out


# A bare capital after one of these words is a part of a document or a thing, not a person.
NO_PERSON_AFTER = tuple(
    "plan exhibit section schedule part phase option type class grade appendix annex clause figure table item note tier group category model series version round level column track "
    "attachment addendum building gate route line form".split()
)
TITLE_MARKS = ("candidate", "Mr", "Ms", "Dr")
TITLES = ("candidate\\s+", "Mr\\.?\\s+", "Mrs\\.?\\s+", "Ms\\.?\\s+", "Dr\\.?\\s+")


def bare_labels(c: Column | str, names: dict[str, str]) -> Column:
    """A single capital in a person's place (A's, Mr A, candidate A, A candidacy) by its name; A's behind a word like Exhibit
    stays."""
    thing = f"(?<!(?i:\\b(?:{'|'.join(NO_PERSON_AFTER)})\\s{{1,40}}))"
    out = _text(c)
    for x, n in names.items():
        out = _where_held(out, [f"{x}'s"], [(f"\\b(?={x}'s\\b){thing}{x}(?='s\\b)", n)])
    out = _where_held(out, TITLE_MARKS, [(f"\\b({'|'.join(TITLES)}){x}\\b", f"$1{n}") for x, n in names.items()])
    return _where_held(out, ["candidacy"], [(f"\\b{x}(?=\\s+candidacy\\b)", n) for x, n in names.items()])


def _where_held(c: Column, marks: Iterable[str], rules: list[tuple[str, str]]) -> Column:
    """replace_all() for rules of which none can match in a text without any of the marks: such a text is not scanned for them."""
    return let(c, lambda x: F.when(reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in marks]), replace_all(x, rules)).otherwise(x))


def reground(c: Column | str, names: dict[str, str], firm: Sequence[tuple[str, str]] = ()) -> Column:
    """Labels like Person D, person_d or PersonD by names: as the local part of an address before an @. Placeholders of the
    firm come first, bare labels last. names: label to name; those that could match within another go first."""
    out = _text(c)
    for a, b in firm:
        out = F.replace(out, F.lit(a), F.lit(b))
    rules = {}
    for label, name in names.items():
        spelt = f"(?i)\\bperson[\\s_-]*{label.split()[-1]}\\b"
        rules[label.split()[-1].upper()] = rules.get(label.split()[-1].upper(), []) + [(spelt + "(?=@)", name.lower().replace(" ", ".")), (spelt, name)]
    bare = {label.split()[-1].upper(): name for label, name in names.items()}
    # no rule may make what another looks for: then one scan tells which labels a text has, and only their rules are tried
    apart = all(re.fullmatch("(?i)(?!.*person)[a-z0-9]+", x) for x in rules) and not any(re.search(f"(?i)person|\\b(?:{'|'.join(rules)})\\b|[$\\\\]", n) for n in names.values())
    if not apart:
        return bare_labels(replace_all(out, [r for x in rules.values() for r in x]), bare)
    spelt = F.lit(f"(?i)\\bperson[\\s_-]*({'|'.join(rules)})\\b")

    def replaced(text):
        return lambda found: reduce(lambda x, r: let(x, lambda y: F.when(F.array_contains(found, r[0]), replace_all(y, r[1])).otherwise(y)), rules.items(), text)

    return bare_labels(let(out, lambda x: let(F.array_distinct(F.transform(F.regexp_extract_all(x, spelt, F.lit(1)), lambda y: F.upper(y))), replaced(x))), bare)


def labels_in(c: Column | str) -> Column:
    """The different labels Person A to Person J of a text, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(c), F.lit("\\bPerson [A-J]\\b"), F.lit(0))))


def labels_left(c: Column | str) -> Column:
    """Bare labels in a person's place, for a check after reground()."""
    thing = f"(?<!(?i:\\b(?:{'|'.join(NO_PERSON_AFTER)})\\s{{1,40}}))"
    found = [f"\\b(?=[A-J]'s\\b){thing}[A-J]'s\\b", "\\bcandidate\\s+[A-J]\\b|\\b(?:Mr|Mrs|Ms|Dr)\\.?\\s+[A-J]\\b|\\b[A-J]\\s+candidacy\\b"]
    return F.concat(*[F.regexp_extract_all(_text(c), F.lit(x), F.lit(0)) for x in found])
