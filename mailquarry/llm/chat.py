r"""Chat formatting: multi-party perspective rotation.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as named
users; what the assistant says is what a model is trained on. A rendered dialogue is one row for each turn: its segment, where
the segment lies in the whole rendering (the segments joined in the order of position), and the masked range, the assistant's
words with the end mark. A conversation may be of any length: no dialogue is gathered in one row or task, offsets are running
sums over blocks of turns.

What a speaker says cannot forge a mark: in a text a backslash goes into each `<|`, after those that stand there already, so
taking one out of each `<\|` gives the text back; in a name the characters %, <, |, > and line ends are written as % and two
hexadecimal digits. Masks are exact in what is rendered.

System turns belong to no participant and are rendered as such in each perspective; a conversation of nothing else has no
perspective. A null role is the participant `unknown`, a null text empty, a null turn comes before all others, and rows with a
null conv_id are one conversation. Turns with equal numbers go by a hash of role and text; repeated rows stay repeated. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry.llm.common import cut, table

END = "<|end|>\n"
_NO_TURN = -(1 << 63)


def said_plainly(text: Column) -> Column:
    """The text with no mark in it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def name_plainly(name: Column) -> Column:
    for x in "%<|>\n\r":
        name = F.replace(name, F.lit(x), F.lit(f"%{ord(x):02X}"))
    return name


def rotate(turns: DataFrame) -> DataFrame:
    """One row for each turn and perspective of turns (conv_id, turn, role, text)."""
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("named", F.col("conv_id").isNotNull())
    said = said.withColumn("mark", F.sha2(F.concat_ws(":", "name", "text"), 256)).withColumn("t", F.coalesce("turn", F.lit(_NO_TURN)))
    said = said.withColumn("a", F.shiftright("t", 8)).withColumn("b", F.struct(F.col("t").bitwiseAND(255).alias("t"), F.substring("mark", 1, 2).alias("m")))
    who = said.where("name <> 'system'").select("c", "named", F.col("name").alias("perspective")).distinct()
    mine = F.col("name") == F.col("perspective")
    role = F.when(mine, "assistant").when(F.col("name") == "system", "system").otherwise("user")
    head = F.when(role == "user", F.concat(F.lit("<|user name="), name_plainly(F.col("name")), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))
    rows = said.join(who, ["c", "named"]).withColumn("speaks_as", role).withColumn("train", mine).withColumn("head_chars", F.length(head).cast("long"))
    rows = cut(rows.withColumn("rendered", F.concat(head, said_plainly(F.col("text")), F.lit(END))).withColumn("chars", F.length("rendered").cast("long")).drop("text"), "turns")

    keys = ["c", "named", "perspective"]
    blocks = rows.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("m"))
    outer = blocks.groupBy(*keys, "a").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    before = lambda c, *by: F.sum(c).over(Window.partitionBy(*keys, *by[:-1]).orderBy(by[-1])) - F.col(c)
    outer = outer.select(*keys, "a", before("n", "a").alias("n0"), before("m", "a").alias("m0"))
    inner = blocks.select(*keys, "a", "b", before("n", "a", "b").alias("n1"), before("m", "a", "b").alias("m1"))
    starts = inner.join(outer, [*keys, "a"]).select(*keys, "a", "b", (F.col("n0") + F.col("n1")).alias("n0"), (F.col("m0") + F.col("m1")).alias("m0"))
    # the join and the window want rows of a block together: one shuffle serves both
    w = Window.partitionBy(*keys, "a", "b").orderBy("t", "mark", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(starts, [*keys, "a", "b"]).withColumn("rn", F.count(F.lit(1)).over(w) - 1).withColumn("upto", F.sum("chars").over(w))
    end = F.col("m0") + F.col("upto")
    return placed.select(
        "conv_id", "perspective", (F.col("n0") + F.col("rn")).alias("position"), "turn", "speaks_as", "name", "rendered", "train",
        (end - F.col("chars")).alias("start"), end.alias("end"),
        F.when(F.col("train"), end - F.col("chars") + F.col("head_chars")).alias("mask_start"), F.when(F.col("train"), end).alias("mask_end"),
    )


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


QUERIES = {"op8_perspective_rotation": op8_perspective_rotation}

ORACLE_SQL = {
    "op8_perspective_rotation": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text,
         sha256(concat(coalesce(role, 'unknown'), ':', coalesce(text, ''))) AS mark
  FROM conversations),
who AS (SELECT DISTINCT conv_id AS c, name AS perspective FROM said WHERE name <> 'system'),
rows AS (
  SELECT s.*, w.perspective, s.name = w.perspective AS train,
         CASE WHEN s.name = w.perspective THEN 'assistant' WHEN s.name = 'system' THEN 'system' ELSE 'user' END AS speaks_as
  FROM said s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.c),
heads AS (
  SELECT *, CASE WHEN speaks_as = 'user' THEN '<|user name=' ||
         replace(replace(replace(replace(replace(replace(name, '%', '%25'), '<', '%3C'), '|', '%7C'), '>', '%3E'), chr(10), '%0A'), chr(13), '%0D')
         || '|>' || chr(10) ELSE '<|' || speaks_as || '|>' || chr(10) END AS head FROM rows),
segments AS (SELECT *, head || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS rendered FROM heads),
placed AS (
  SELECT *, row_number() OVER o - 1 AS position, sum(length(rendered)) OVER o AS upto FROM segments
  WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, mark, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaks_as, name, rendered, train,
       CAST(upto - length(rendered) AS BIGINT) AS "start", CAST(upto AS BIGINT) AS "end",
       CASE WHEN train THEN CAST(upto - length(rendered) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN train THEN CAST(upto AS BIGINT) END AS mask_end
FROM placed""",
}
