"""Filter interaction audit: what each of five filters removes in every order, from one CUBE.

Every document is reduced to five failure flags, its part and two marks of its labels, and equal rows are counted. A CUBE
over the flags and the part sums these counts; of its grouping sets, the rows whose selected flags are all false count the
documents that pass just these filters. These survivors of the 32 subsets of each part say everything else: a step of an order goes
from one subset to the next, so steps are joined with the survivors of both, and what a filter fails alone or at all are differences
between subsets too. The work on texts is one pass; nothing grows with the 120 orders but the result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
SPACE, CAPITAL, SYMBOL = r"[\x20\x09-\x0D]+", "[A-Z]", r"[#$%&*|]"


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, a, b, c, d, e (true: the filter fails), good, toxic (0 or 1); one row for every input row.

    Null text is empty, null lang the part ''. A text without words fails A alone. E fails where a smaller doc_id has the same text, so
    rows without doc_id neither fail E nor make others fail it. Labels of one doc_id are taken together: good if any has quality 1, toxic
    if any has toxic 1; rows without doc_id have no labels.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("t"), words.alias("w"))
    n, hundred = F.size("w"), F.lit(100).cast("long")
    own = own.select(
        "doc_id", "part", "digest", (n < LEAST_WORDS).alias("a"), (hundred * F.size(F.array_distinct("w")) < n.cast("long") * DISTINCT_PERCENT).alias("b"),
        (hundred * F.regexp_count("t", F.lit(CAPITAL)) > F.length("t").cast("long") * CAPITALS_PERCENT).alias("c"), F.col("t").rlike(SYMBOL).alias("d"),
    )
    own = stage(own, "audit-flags")
    repeated = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    repeated = stage(repeated, "audit-repeated")  # so that the join below reads two exchanges, and a text of many rows can be split
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    out = own.join(repeated, "digest", "left").join(marks, "doc_id", "left")
    return out.select("doc_id", "part", "a", "b", "c", "d", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("e"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def survivors(rows: DataFrame) -> DataFrame:
    """Flagged rows to part, mask, n, good, toxic for every part and each of the 32 subsets: what passes the filters in mask, A the lowest bit."""
    flags = [f.lower() for f in FILTERS]
    counted = stage(rows.groupBy("part", *flags).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "audit-counted")
    cube = counted.cube(*flags, "part").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), F.grouping("part").alias("of_all"), *(F.grouping(f).alias(f"without_{f}") for f in flags))
    passing = cube.where("of_all = 0")
    for f in flags:
        passing = passing.where((F.col(f"without_{f}") == 1) | ~F.col(f))
    mask = sum(((1 - F.col(f"without_{f}").cast("int")) * (1 << k) for k, f in enumerate(flags)), F.lit(0))
    passing = passing.select("part", mask.alias("mask"), "n", "good", "toxic")
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("mask"))
    return grid.join(passing, ["part", "mask"], "left").na.fill(0, ["n", "good", "toxic"])


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter, before, after and masks of the filter alone and of all others, for all orders; 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            rows.append(("".join(order), k + 1, f, before, before | bit, bit, ALL ^ bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int, alone int, others int")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) and labels (doc_id, quality, toxic, ...) to one row per part, filter_order and step.

    part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Empty documents give no rows.
    Other columns are not read.
    """
    at = stage(survivors(flagged(docs, labels)), "audit-survivors")
    look = lambda name: at.select("part", F.col("mask").alias(name), F.struct("n", "good", "toxic").alias(f"at_{name}"))
    every = look("none").where("none = 0").join(look("all").where(F.col("all") == ALL), "part")
    out = steps(docs.sparkSession).join(look("after"), "after").join(look("before"), ["part", "before"]).join(look("alone"), ["part", "alone"]).join(look("others"), ["part", "others"]).join(every, "part")
    fails, removed = F.col("at_none.n") - F.col("at_alone.n"), F.col("at_before.n") - F.col("at_after.n")
    out = out.select(
        "part", "filter_order", "step", "filter", F.col("at_after.n").alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"), (F.col("at_others.n") - F.col("at_all.n")).alias("unique_fails"),
        (F.col("at_before.good") - F.col("at_after.good")).alias("good_lost"), (F.col("at_before.toxic") - F.col("at_after.toxic")).alias("toxic_lost"),
    )
    return out.join(out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley")), ["part", "filter"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), firsts AS (SELECT text, min(doc_id) AS low FROM t GROUP BY text),
f AS (
  SELECT row_number() OVER () AS r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < {LEAST_WORDS}, 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w), 100 * len(regexp_extract_all(text, '{CAPITAL}')) > {CAPITALS_PERCENT} * length(text),
      regexp_matches(text, '{SYMBOL}'), coalesce(t.doc_id > low, false)] AS fail
  FROM t LEFT JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = t.doc_id
), letters AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), judged AS (
  SELECT part, good, toxic, o, s AS step, o[s] AS k, fail[o[s]] AS fails, len(list_filter(o[1 : s - 1], lambda x: fail[x])) > 0 AS gone, len(list_filter(fail, lambda x: x)) AS all_fails
  FROM f, orders, (SELECT unnest(range(1, 6)) AS s)
), counted AS (
  SELECT part, array_to_string(list_transform(o, lambda x: substr('{FILTERS}', x, 1)), '') AS filter_order, step::INT AS step, substr('{FILTERS}', k, 1) AS filter,
    count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed, count(*) FILTER (gone AND fails) AS redundant, count(*) FILTER (fails AND all_fails = 1) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM counted
"""
