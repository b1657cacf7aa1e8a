"""Co-occurrence where a few things are held by very many persons.

Things that more than LIMIT persons hold are hot. Cold things make pairs; hot ones stay classes: a row for each membership, a size for
each thing, and never a pair of two members. Counts over both are exact, as persons with the same hot things are counted as one
group. The limit moves work from pairs to classes and changes no row of a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import edge_active
from ..staging import cut

LIMIT = 1000


def split_by_size(edges: DataFrame, key: list[str], persons: DataFrame, active: Column | None = None, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Live edges (person_id, key..., other) of things with more than one holder, as cold ones and hot ones (with size); other: not merged, so counted as an other."""
    live = edges.where(edge_active() if active is None else active).select("person_id", *key).distinct()
    live = live.join(persons.select("person_id", (F.col("status") != "merged").alias("other")), "person_id", "left").na.fill(False, ["other"])
    live = cut(live, "held")
    sizes = cut(live.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    cold = live.join(sizes.where(F.col("size") <= limit).select(*key), key, "left_semi")
    # hot things are at most edges / limit, and small enough to send to every task long before their members are
    hot = live.join(sizes.where(F.col("size") > limit), key)
    return cold, hot


def sharing(edges: DataFrame, key: list[str], persons: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(person_id, other_id, key...) for cold things, and (person_id, key..., size) for the hot ones, which stand for all their pairs."""
    cold, hot = split_by_size(edges, key, persons, None, limit)
    others = cold.where("other").select(F.col("person_id").alias("other_id"), *key)
    return cold.select("person_id", *key).join(others, key).where("person_id <> other_id").select("person_id", "other_id", *key), hot.select("person_id", *key, "size")


def others_counted(edges: DataFrame, key: list[str], persons: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(person_id, others): distinct persons, merged ones left out, with whom a person shares a thing; persons without any have no row.

    Persons with the same hot things have one signature. Those met through hot things are sums over signatures that share a thing with
    one's own; those met through cold things count unless their signature shares one.
    """
    cold, hot = split_by_size(edges, key, persons, None, limit)
    thing = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key)))
    held = cut(hot.groupBy("person_id").agg(F.sort_array(F.collect_set(thing)).alias("things"), F.first("other").alias("other")), "signatures")
    groups = held.groupBy("things").agg(F.count_if("other").alias("members")).withColumn("sign", F.md5(F.array_join("things", ",")))
    groups = cut(groups, "groups")
    spread = groups.select("sign", F.explode("things").alias("thing"))
    met = spread.join(spread.withColumnRenamed("sign", "near"), "thing").select("sign", "near").distinct().join(groups.select(F.col("sign").alias("near"), "members"), "near")
    reach = met.groupBy("sign").agg(F.sum("members").alias("reach"))
    by_hot = held.withColumn("sign", F.md5(F.array_join("things", ","))).join(reach, "sign").select("person_id", (F.col("reach") - F.col("other").cast("int")).alias("n"))
    marks = held.select("person_id", "things")
    pairs = cold.select("person_id", *key).join(cold.where("other").select(F.col("person_id").alias("other_id"), *key), key).where("person_id <> other_id").select("person_id", "other_id").distinct()
    pairs = pairs.join(marks, "person_id", "left").join(marks.select(F.col("person_id").alias("other_id"), F.col("things").alias("theirs")), "other_id", "left")
    apart = pairs.where(~F.coalesce(F.arrays_overlap("things", "theirs"), F.lit(False)))
    both = apart.groupBy("person_id").agg(F.count("*").alias("n")).union(by_hot)
    return both.groupBy("person_id").agg(F.sum("n").cast("long").alias("others")).where("others > 0")


def others_of(chosen: DataFrame, edges: DataFrame, key: list[str], persons: DataFrame) -> DataFrame:
    """others_counted for a page of persons, chosen (person_id): (person_id, others), persons without any have no row. A thing with a null in its key is shared by none, as there.

    Only things of the page count, so all their holders fall into a few classes by which of those things they hold; classes are counted
    and no pair is made. A chosen person who is not merged is a member of their own class and is taken off again.
    """
    live = edges.where(edge_active()).na.drop(subset=key).select("person_id", F.md5(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in key))).alias("thing")).distinct()
    own = cut(live.join(chosen.select("person_id").distinct(), "person_id", "left_semi"), "own")
    near = live.join(own.select("thing").distinct(), "thing", "left_semi").join(persons.where("status <> 'merged'").select("person_id"), "person_id", "left_semi")
    classes = near.groupBy("person_id").agg(F.sort_array(F.collect_set("thing")).alias("things")).groupBy("things").agg(F.count("*").alias("members"))
    spread = classes.withColumn("sign", F.md5(F.array_join("things", ","))).select("sign", "members", F.explode("things").alias("thing"))
    met = own.join(spread, "thing").select("person_id", "sign", "members").distinct().groupBy("person_id").agg(F.sum("members").alias("reach"))
    themselves = persons.join(own.select("person_id").distinct(), "person_id", "left_semi").select("person_id", (F.col("status") != "merged").cast("int").alias("self"))
    return met.join(themselves, "person_id", "left").select("person_id", (F.col("reach") - F.coalesce("self", F.lit(0))).alias("others")).where("others > 0")
