"""Known values of persons found in texts.

Values and texts are compared in their compact form, letters and digits alone. Every value of four or more characters is
told by one anchor, the rarest of its runs of four characters over all texts; texts are spread into their runs and joined to
the anchors, and a hit is verified against the whole value. Shorter values must stand as a word. Nothing is looked for person by person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import compact_text
from ..staging import cut

RUN = 4


def _runs(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (c, ...) to keep..., at, run: every run of four characters of c."""
    spread = rows.where(F.length("c") >= RUN).select(*keep, "c", F.explode(F.sequence(F.lit(1), F.length("c") - RUN + 1)).alias("at"))
    return spread.select(*keep, "c", "at", F.substring(F.col("c"), F.col("at"), F.lit(RUN)).alias("run"))


def values_in(texts: DataFrame, values: DataFrame) -> DataFrame:
    """texts (text_id, text) and values (owner_id, value) to distinct (text_id, owner_id, value): which known values stand in which texts.

    Null and empty values and texts meet nothing. A value that many owners share is looked for once. Anchors that many texts hold are
    few, as the rarest run of a value is taken; Spark splits what is left of them.
    """
    compact = cut(texts.select("text_id", "text", compact_text("text").alias("c")), "privacy-texts")
    known = cut(values.where("value is not null").select("value").distinct().select("value", compact_text("value").alias("c")).where("c <> ''"), "privacy-values")
    long = known.select("c").distinct().where(F.length("c") >= RUN)
    runs = cut(_runs(long).select("c", "at", "run"), "privacy-runs")
    asked = cut(runs.select("run").distinct(), "privacy-asked")
    seen = _runs(compact).select("run").join(asked, "run").groupBy("run").agg(F.count("*").alias("n"))
    held = runs.join(seen, "run", "left")
    # a value with a run that stands nowhere cannot stand anywhere
    anchor = held.groupBy("c").agg(F.min_by(F.struct("run", "at"), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("a"), F.bool_and(F.col("n").isNotNull()).alias("can")).where("can")
    anchor = cut(anchor.select(F.col("c").alias("want"), "a.run", F.col("a.at").alias("offset")), "privacy-anchors")
    met = _runs(compact, "text_id").join(anchor, "run")
    start = F.col("at") - F.col("offset") + 1
    found = met.where((start >= 1) & (F.substring(F.col("c"), F.greatest(start, F.lit(1)), F.length("want")) == F.col("want"))).select("text_id", F.col("want").alias("c")).distinct()
    words = compact.select("text_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+"))).alias("w")).select("text_id", compact_text("w").alias("c")).where("c <> ''")
    short = words.join(known.select("c").distinct().where(F.length("c") < RUN), "c", "left_semi").select("text_id", "c").distinct()
    hits = found.union(short).join(known, "c").select("text_id", "value")
    return hits.join(values.select("owner_id", "value").distinct(), "value").select("text_id", "owner_id", "value").distinct()
