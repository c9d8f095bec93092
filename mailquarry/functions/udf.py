"""What built-in functions cannot say: Unicode folding, wrapping, callback replacements, JSON in prose and MIME. All are
vectorised over Arrow batches, and the plain Python beneath is kept apart for tests."""

from __future__ import annotations

import email
import email.message
import email.policy
import functools
import itertools
import json
import re
import textwrap
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mailquarry.functions.text import QUOTE_MARKS

# Typographic characters and what they become before others are folded or dropped.
PUNCTUATION = {
    "\u2014": "--", "\u2013": "-", "\u2012": "-", "\u2015": "--", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"',
    "\u2026": "...", "\u2022": "-", "\u00b7": "-", "\u2010": "-", "\u2011": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u200b": "", "\ufeff": "",
}
_QUOTE = re.compile(f"^\\s*(?:{QUOTE_MARKS})", re.I)


def ascii_of(s: str | None) -> str:
    """Typographic marks by plain ones, accents off, all else above ASCII away."""
    s = "".join(PUNCTUATION.get(c, c) for c in s or "")
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def wrapped(s: str | None, width: int = 75) -> str:
    """Each line cut at spaces to the width; words stay whole, blank lines stay."""
    out = []
    for line in ascii_of(s).split("\n"):
        out.extend(textwrap.wrap(line, width, break_long_words=False, break_on_hyphens=False) or [""])
    return "\n".join(out)


_JSON = re.compile(r'\s*+(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null))')


def _objects(s: str, start: int) -> tuple[list[tuple[int, int]], list[int]]:
    """What reading JSON from the brace at `start` finds, to its end or the first error: (from, to) of each complete object, and
    where those begin that were open at an error."""
    done, opened, at, want = [], [], start, "v"  # v: value, k: key or end, K: key, e: value or end, c: colon, n: comma or end
    while m := _JSON.match(s, at):
        at = m.end()
        mark = m[1]
        if want in "ve" and mark != "]" and mark not in (",", ":", "}"):
            if mark in ("{", "["):
                opened.append((m.start(1), mark))
                want = "k" if mark == "{" else "e"
                continue
        elif want in "kK" and m[2] is not None:
            want = "c"
            continue
        elif want == "c" and mark == ":":
            want = "v"
            continue
        elif want == "n" and mark == ",":
            want = "K" if opened[-1][1] == "{" else "v"
            continue
        elif want in "kn" and mark == "}" and opened[-1][1] == "{" or want in "en" and mark == "]" and opened[-1][1] == "[":
            begun, kind = opened.pop()
            if kind == "{":
                done.append((begun, at))
        else:
            break
        if not opened:
            break
        want = "n"
    return done, [x for x, _ in opened]


def first_json(s: str | None) -> dict | None:
    """The first {...} that is a JSON object; braces in strings do not count, and a broken one is passed over, but not what
    it holds. Each piece is read about once. Null too for an object nested deeper than Python's parser goes."""
    s, at, broken = s or "", 0, set()
    while (at := s.find("{", at)) >= 0:
        if at not in broken:
            done, opened = _objects(s, at)
            if done:
                a, b = min(done)
                before = s.find("{", at + 1, a) if a > at else -1
                while before >= 0 and before in opened:
                    before = s.find("{", before + 1, a)
                if before < 0:
                    try:
                        return json.loads(s[a:b])
                    except (ValueError, RecursionError):
                        return None
            broken.update(opened)
        at += 1
    return None


def _complete(s: str) -> Iterator[tuple[int, int]]:
    """(from, to) of every JSON object in a text, those within others and within their strings too, in order."""
    known, broken, at = {}, set(), 0
    while (at := s.find("{", at)) >= 0:
        if at not in known and at not in broken:
            done, opened = _objects(s, at)
            known.update(done)
            broken.update(opened)
        if at in known:
            yield at, known[at]
        at += 1


def _loaded(s: str) -> dict | list | None:
    try:
        return json.loads(s)
    except (ValueError, RecursionError):
        return None


_STRING_OR_MARK = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}\[\]]', re.S)


def balanced_json(s: str | None, mark: str = "{") -> dict | list | None:
    """What stands between the first { (or [) and the mark that closes it, strings apart; nothing behind it is tried."""
    s, close, depth = s or "", {"{": "}", "[": "]"}[mark], 0
    start = s.find(mark)
    for m in _STRING_OR_MARK.finditer(s, start) if start >= 0 else ():
        depth += (m[0] == mark) - (m[0] == close)
        if not depth:
            return _loaded(s[start : m.end()])
    return None


def fenced_json(s: str | None) -> dict | None:
    """What stands between the first { and the last } of a text, a code fence around it taken off."""
    s = (s or "").strip()
    s = s.removeprefix("```").removeprefix("json") if s.startswith("```") else s
    s = s.strip().removesuffix("```")
    a, b = s.find("{"), s.rfind("}")
    return _loaded(s[a : b + 1]) if 0 <= a < b else None


def _closes(s: str, quotes: bool) -> dict[int, int]:
    """Behind which } each { ends: counting all marks, or those between as many quotes as the {, escaped ones too."""
    out, opened, side = {}, ([], []), 0
    for m in re.finditer(r'[{}"]' if quotes else "[{}]", s):
        if m[0] == "{":
            opened[side].append(m.start())
        elif m[0] == '"':
            side = 1 - side
        elif opened[side]:
            out[opened[side].pop()] = m.end()
    return out


def counted_json(s: str | None, quotes: bool = True) -> dict | None:
    """The first {...} that is a JSON object, where its end is found by counting braces: those outside quotes, each quote taken as
    one, or all. An object with an escaped quote or with a brace in a string may thus be passed over."""
    s = s or ""
    ends = _closes(s, quotes)
    return next((_loaded(s[a:b]) for a, b in _complete(s) if ends.get(a) == b), None)


@functools.lru_cache(4096)
def _parsed(name: str, value: str) -> str:
    return email.policy.default.header_fetch_parse(name, value)


class MailPolicy(email.policy.EmailPolicy):
    """The default policy, which parses a header anew each time that it is asked for, with what a worker has parsed kept: types,
    encodings and senders are the same in most mails. A header as parsed does not change; long ones are not kept."""

    def header_fetch_parse(self, name, value):
        return _parsed(name, value) if type(value) is str and len(value) <= 256 else super().header_fetch_parse(name, value)


MAIL_POLICY = MailPolicy()


def plain_text(m: email.message.Message) -> str:
    """The first plain text part, empty if there is none; one of an unknown character set as Latin-1."""
    part = m.get_body(preferencelist=("plain",))
    try:
        text = part.get_content() if part else ""
    except (LookupError, UnicodeError):
        text = (part.get_payload(decode=True) or b"").decode("latin-1")
    return text.replace("\r\n", "\n")


def mime_body(raw: bytes | None) -> tuple[str, str]:
    """Sender and the first plain text part up to a quoted or forwarded line."""
    m = email.message_from_bytes(raw or b"", policy=MAIL_POLICY)
    kept = itertools.takewhile(lambda line: not _QUOTE.match(line), (plain_text(m) if raw else "").split("\n"))
    return str(m.get("From", "")), "\n".join(kept).strip()


@F.pandas_udf(StringType())
def to_ascii(s: pd.Series) -> pd.Series:
    return s.map(ascii_of)


@F.pandas_udf(StringType())
def ascii_wrap(s: pd.Series) -> pd.Series:
    return s.map(wrapped)


@F.pandas_udf(StringType())
def extract_json(s: pd.Series) -> pd.Series:
    """The object as canonical JSON, null if there is none."""
    return s.map(lambda x: None if (j := first_json(x)) is None else json.dumps(j, sort_keys=True, ensure_ascii=False))


def json_by(rule: Callable[[str | None], dict | list | None]):
    """A column function for one of the rules above: what it finds as canonical JSON, null if there is nothing."""

    @F.pandas_udf(StringType())
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (j := rule(x)) is None else json.dumps(j, sort_keys=True, ensure_ascii=False))

    return found


@F.pandas_udf(StructType([StructField("sender", StringType()), StructField("body", StringType())]))
def mail_body(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mime_body(x) for x in raw], columns=["sender", "body"])
