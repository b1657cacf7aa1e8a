"""Multi-party perspective rotation, with DataFrame functions only.

A dialogue is rendered once for every participant: that speaker's turns are the assistant's and are learnt from, all
other speakers are users under their names, and system turns stay what they are. The rendered text is
<|role name|>\\ncontent\\n for each turn, in order of turns; a mask lists the places of the assistant's contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM = "system"


def rotate(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, ...) to conv_id, perspective, n_turns, n_masked, text, mask.

    mask holds start-end pairs of character places, end excluded, comma-joined. A null role is the speaker 'unknown', a null text
    an empty one, a null turn comes first; turns with equal numbers are ordered by role and text; repeated rows are repeated
    turns. Nothing says which rows without conv_id belong together, so each is a dialogue of one turn. A dialogue of system turns
    alone has no participant and no row. Other columns are not read. Places are running sums, so work follows the text; a row
    of the result is one rendered dialogue, the unit of output, so memory follows its length.
    """
    whole = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = whole.where("conv_id is not null")
    speakers = known.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    seen = rendered(known.join(speakers, "conv_id"))
    order = Window.partitionBy("conv_id", "perspective").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("end", F.sum(F.length("head") + F.length("text") + 1).over(order) - 1)
    piece = F.sort_array(F.collect_list(F.struct("end", "own", F.length("text").alias("size"), F.concat("head", "text", F.lit("\n")).alias("shown"))))
    talks = placed.groupBy("conv_id", "perspective").agg(piece.alias("talk"))
    spans = F.transform(F.filter("talk", lambda t: t["own"]), lambda t: span(t["end"] - t["size"], t["end"]))
    out = talks.select("conv_id", "perspective", F.size("talk").cast("long").alias("n_turns"), F.size(spans).cast("long").alias("n_masked"), F.array_join(F.transform("talk", lambda t: t["shown"]), "").alias("text"), F.array_join(spans, ",").alias("mask"))
    one = F.lit(1).cast("long")
    single = rendered(whole.where((F.col("conv_id").isNull()) & (F.col("role") != SYSTEM)).withColumn("perspective", F.col("role")))
    start = F.length("head")
    return out.union(single.select("conv_id", "perspective", one, one, F.concat("head", "text", F.lit("\n")), span(start, start + F.length("text"))))


def rendered(turns: DataFrame) -> DataFrame:
    """Turns with perspective to turns with own, whether the assistant's, and head, the line before the content."""
    own = F.col("role") == F.col("perspective")
    part = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user "), "role"))
    return turns.withColumns({"own": own, "head": F.concat(F.lit("<|"), part, F.lit("|>\n"))})


def span(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, p.perspective, t.turn, t.role, t.text, t.role = p.perspective AS own,
    '<|' || CASE WHEN t.role = p.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user ' || t.role END || '|>' || chr(10) AS head
  FROM t JOIN p ON t.conv_id = p.conv_id
),
placed AS (
  SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - length(text) - 1 AS start FROM s
)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (own) AS n_masked,
  string_agg(head || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(text) AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective
UNION ALL
SELECT conv_id, role, 1, 1, '<|assistant|>' || chr(10) || text || chr(10), '14-' || CAST(14 + length(text) AS BIGINT) FROM t WHERE conv_id IS NULL AND role <> 'system'
"""
