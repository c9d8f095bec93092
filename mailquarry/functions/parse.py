"""Model output to columns, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOOLS = "LIST|SEARCH|READ|SEGMENT|EXPAND"


def step(c: str) -> tuple[Column, Column]:
    """(tool, argument) of a line-protocol step: an ANSWER with a result, else a tool hidden in a malformed ANSWER, else a
    tool, else a bare result."""
    s = F.coalesce(F.col(c), F.lit(""))
    payload = F.trim(F.regexp_extract(s, "(?s)ACTION:\\s*ANSWER\\s+(.*)", 1))
    inner, inner_arg = (F.regexp_extract(payload, f"^({TOOLS})\\s+([^\\n]*)", g) for g in (1, 2))
    tool, arg = (F.regexp_extract(s, f"ACTION:\\s*({TOOLS})\\s*([^\\n]*)", g) for g in (1, 2))
    found = '"found"'
    name = F.when(payload.contains(found), "ANSWER").when(inner != "", inner).when(tool != "", tool).when(s.contains(found), "ANSWER")
    value = F.when(payload.contains(found), payload).when(inner != "", F.trim(inner_arg)).when(tool != "", F.trim(arg)).when(s.contains(found), F.trim(s))
    return name, value


def whole_object(raw: Column | str) -> Column:
    """The text if all of it is one JSON object, else null. Spark's parser is content with a value at the start, so prose behind a
    number, a word in quotes or an object would pass; in a list and in an object of one field nothing can stand behind it."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    alone = lambda a, b: F.try_parse_json(F.concat(F.lit(a), raw, F.lit(b))).isNotNull()
    return F.when(raw.rlike("^\\s*\\{"), F.when(alone("[", "]") & alone('{"a":', "}"), raw))


def solution(json_column: Column, raw: Column, ids: str = "<[^<>\\s]+@[^<>\\s]+>") -> list[Column]:
    """found, secret and cited ids: from the JSON object if there is one, else from the text."""
    said = F.get_json_object(json_column, "$.found")
    found = F.when(said.isNotNull(), said == "true").otherwise(raw.rlike('(?i)"?found"?\\s*:\\s*true'))
    listed = F.coalesce(F.get_json_object(json_column, "$.evidence_email_ids"), F.when(json_column.isNull(), raw), F.lit(""))
    return [F.coalesce(found, F.lit(False)).alias("found"), F.trim(F.coalesce(F.get_json_object(json_column, "$.secret"), F.lit(""))).alias("secret"), F.array_distinct(F.regexp_extract_all(listed, F.lit(ids), F.lit(0))).alias("evidence_ids")]
