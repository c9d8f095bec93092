"""Names from a table put in place of others in whole texts, by one scan for all names.

The names become an Aho-Corasick automaton, made once in each task from a broadcast of at most MAX_BYTES of names and labels;
a larger table is dealt into blocks of that size, in order, which go over a text one after the other. The result is that of one
replacement after the other in the order of the names: of names that overlap in a text the first in that order gets its place,
of occurrences of one name that overlap the leftmost. This holds where no label forms a name, alone or with what stands beside
it, and names begin and end with a letter, digit or _.

An occurrence counts as a whole word: at both ends a letter, digit or _ of ASCII stands beside none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 32 << 20
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def automaton(names: list[tuple[str, str]]):
    """Finds all names at once, each with its place in the list, its length and its label. The first of equal names counts."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for place, (name, label) in enumerate(names):
        if name and name not in machine:
            machine.add_word(name, (place, len(name), label))
    machine.make_automaton()
    return machine


def _apart(text: str, at: int) -> bool:
    """Whether a word begins or ends before this character."""
    return (at > 0 and text[at - 1] in _WORD) != (at < len(text) and text[at] in _WORD)


def rewritten(text: str, machine) -> str:
    found = []
    for last, (place, n, label) in machine.iter(text):
        start = last + 1 - n
        if _apart(text, start) and _apart(text, last + 1):
            found.append((place, start, last + 1, label))
    taken: list[tuple[int, int, str]] = []
    for _, start, end, label in sorted(found):
        i = bisect_left(taken, (start,))
        if (i == len(taken) or taken[i][0] >= end) and (i == 0 or taken[i - 1][1] <= start):
            insort(taken, (start, end, label))
    out, at = [], 0
    for start, end, label in taken:
        out += text[at:start], label
        at = end
    return "".join(out) + text[at:]


def _rewriter(held):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(held.value)
        for texts in batches:
            yield texts.map(lambda t: t if t is None else rewritten(t, machine))

    return run


def blocks(names: DataFrame, most: int = MAX_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The names in order, longest first, in blocks of at most `most` bytes, one after the other through the driver. names (name,
    label); of equal names the least label counts."""
    known = names.where("name is not null and name <> ''").groupBy("name").agg(F.min(F.coalesce("label", F.lit(""))).alias("label"))
    rows = known.withColumn("n", F.length("name")).repartitionByRange(F.desc("n"), "name").sortWithinPartitions(F.desc("n"), "name")
    held, size = [], 0
    for r in rows.toLocalIterator():
        more = len(r.name.encode()) + len(r.label.encode())
        if held and size + more > most:
            yield held
            held, size = [], 0
        held.append((r.name, r.label))
        size += more
    if held:
        yield held


def with_names(df: DataFrame, names: DataFrame, *columns: str, most: int = MAX_BYTES) -> DataFrame:
    """df with the names (name, label) in these text columns replaced, longest names first; null texts stay."""
    for block in blocks(names, most):
        run = _rewriter(df.sparkSession.sparkContext.broadcast(block))
        df = df.withColumns({c: run(F.col(c)) for c in columns})
    return df


def _holder(held):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(held.value)
        for texts in batches:
            yield texts.map(lambda t: t is not None and next(machine.iter(t), None) is not None).astype(bool)

    return run


def holds_any(passages: DataFrame, column: str, most: int = MAX_BYTES) -> Column:
    """Whether a text holds one of the passages (passage), in any place; the empty passage is in no text here."""
    held = F.lit(False)
    for block in blocks(passages.select(F.col("passage").alias("name"), F.lit("").alias("label")), most):
        held = held | _holder(passages.sparkSession.sparkContext.broadcast(block))(F.col(column))
    return held
