"""Resolution of the new records of a batch among themselves.

Records that matched no person are judged pair by pair with the rules and scores that hold between a record and a person, and are then
clustered under constraints: links that merge are taken from the strongest to the weakest, and one that would put
two different government ids, or a forbidden pair, into one person is refused. The outcome follows from the set of records alone,
not from their order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import USABLE
from ..staging import Scope, cut, joined
from . import matching as mt
from .connections import components

ID = ["identifier_type", "normalized_value"]


def batch_pairs(identifiers: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, person_id), the larger record first: pairs that share a usable identifier within its cap, or an address and a date of birth.

    A value that more records share than its cap allows is no key, so a value makes pairs up to the square of its cap. An address is
    a key only together with the date of birth, so a tower of many records does not pair them all.
    """
    far = joined(records.count())
    usable = identifiers.where(F.col("quality_flag").isin(*USABLE)).join(far(records.select("record_id")), "record_id", "left_semi").select("record_id", *ID).distinct()
    sizes = usable.groupBy(*ID).agg(F.count("*").alias("n")).where((F.col("n") > 1) & mt.within_cap(F.col("identifier_type"), F.col("n"))).drop("n")
    own = usable.join(far(sizes), ID, "left_semi")
    pairs = own.join(far(own.select(F.col("record_id").alias("person_id"), *ID)), ID).where("record_id > person_id").select("record_id", "person_id")
    if "address_id" in records.columns:
        at = records.where("address_id is not null and dob is not null").select("record_id", "address_id", "dob")
        near = at.join(far(at.withColumnRenamed("record_id", "person_id")), ["address_id", "dob"]).where("record_id > person_id")
        pairs = pairs.union(near.select("record_id", "person_id"))
    return pairs.distinct()


def batch_judged(identifiers: DataFrame, records: DataFrame, graph: DataFrame) -> DataFrame:
    """Pairs of new records to record_id, person_id (the other record), rule, decision, confidence.

    records (record_id, record_type, dob, names, address_id); graph holds the persons' edges, whose fan-out tells hot phones.
    """
    far = joined(records.count())
    pairs = cut(batch_pairs(identifiers, records).join(far(records.select("record_id", "record_type")), "record_id"), "batch-pairs")
    held = identifiers.select(F.col("record_id").alias("person_id"), *ID, "is_verified", "quality_flag", F.lit(True).alias("is_active"))
    ruled = cut(mt.deterministic(pairs, identifiers, held, far=far), "batch-ruled")
    open_ = ruled.where("verdict is null").select("record_id", "person_id", "record_type")
    evidence = mt.identifier_evidence(open_, identifiers, held, reach=graph, far=far)
    other = records.select(F.col("record_id").alias("person_id"), F.when(F.col("dob").isNull(), F.array().cast("array<string>")).otherwise(F.array("dob")).alias("held_dobs"), F.col("names").alias("held_names"), F.col("address_id").alias("held_address"))
    # a pair that met at an address alone has no identifiers in evidence
    rows = open_.join(far(evidence), ["record_id", "person_id"], "left").na.fill(0.0, ["evidence"]).na.fill(False, ["phone_exact", "email_exact", "high_fanout", "corroborated", "phone_near", "email_near"])
    rows = rows.join(far(records.select("record_id", "dob", "names", "address_id")), "record_id").join(far(other), "person_id")
    rows = rows.withColumns({"name_similarity": mt.best_name_similarity("names", "held_names"), "address_match": F.coalesce(F.col("address_id") == F.col("held_address"), F.lit(False))})
    soft = mt.scored(rows).select("record_id", "person_id", F.lit(None).cast("string").alias("rule"), "decision", "confidence")
    hard = ruled.where("verdict is not null").select("record_id", "person_id", "rule", F.col("verdict").alias("decision"), F.when(F.col("verdict") == "merge", 1.0).otherwise(0.0).alias("confidence"))
    return hard.union(soft)


def government_classes(identifiers: DataFrame) -> DataFrame:
    """(node, cls): records with a valid government id and the class of it; ids that one record holds are of one class."""
    ids = identifiers.where("identifier_type = 'nric' and quality_flag = 'valid'").select("record_id", "normalized_value").distinct()
    far = joined(ids.count())
    first = ids.groupBy("record_id").agg(F.min("normalized_value").alias("cls"))
    same = components(ids.join(far(first), "record_id").select(F.col("normalized_value").alias("a"), F.col("cls").alias("b")))
    return first.join(far(same.select(F.col("node").alias("cls"), "component")), "cls", "left").select(F.col("record_id").alias("node"), F.coalesce("component", "cls").alias("cls"))


def strength(weight: Column, a: Column, b: Column) -> Column:
    """The order in which links are taken, as a struct: by weight, and ties by a digest of both ends, which no order of arrival changes."""
    return F.struct(weight.alias("weight"), F.md5(F.concat_ws("-", a.cast("string"), b.cast("string"))).alias("tie"))


def constrained_components(links: DataFrame, classes: DataFrame, forbidden: DataFrame | None = None, rounds: int = 1000) -> DataFrame:
    """links (a, b, weight), classes (node, cls) and forbidden (a, b) to (node, component): no component holds two classes or a forbidden pair.

    The rows are those of taking links one by one from the strongest, refusing what would break a constraint. Components of all links
    that break none are taken whole. In the others, clusters grow in rounds: a link that is the strongest allowed one of both its clusters is taken,
    for nothing stronger can come between; and so is a cluster's only link if it can never be refused. A refused link stays
    refused, as clusters only grow. component is the smallest node.
    """
    spark = links.sparkSession
    banned = None if forbidden is None else forbidden.select("a", "b").union(forbidden.select("b", "a")).distinct()
    with Scope(spark) as whole:
        plain = cut(components(links), "batch-plain")
        far = joined(plain.count())
        bad = plain.join(far(classes), "node").groupBy("component").agg(F.countDistinct("cls").alias("n")).where("n > 1").select("component")
        if banned is not None:
            ends = lambda c: plain.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
            bad = bad.union(banned.join(far(ends("a")), "a").join(far(ends("b")), "b").where("ca = cb").select(F.col("ca").alias("component")))
        bad = cut(bad.distinct(), "batch-bad")
        clean = plain.join(far(bad), "component", "left_anti").select("node", "component")
        split = plain.join(far(bad), "component", "left_semi").select("node")
        now = cut(split.join(far(classes), "node", "left").select("node", F.col("node").alias("component"), "cls"), "batch-start")
        edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
        edges = cut(edges.join(far(split.withColumnRenamed("node", "a")), "a", "left_semi").select("a", "b", strength(F.col("weight"), F.col("a"), F.col("b")).alias("s")), "batch-links")
        with Scope(spark) as grown:
            for _ in range(rounds):
                label = now.select("node", "component")
                group = now.groupBy("component").agg(F.max("cls").alias("cls"))
                mapped = edges.join(far(label.toDF("a", "ca")), "a").join(far(label.toDF("b", "cb")), "b").where("ca <> cb")
                pair = mapped.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max("s").alias("s"))
                pair = pair.join(far(group.toDF("x", "cx")), "x").join(far(group.toDF("y", "cy")), "y").where("cx is null or cy is null or cx = cy")
                if banned is not None:
                    apart = banned.join(far(label.toDF("a", "x")), "a").join(far(label.toDF("b", "y")), "b").select("x", "y").distinct()
                    held = apart.select("x").distinct().withColumn("held", F.lit(True))
                    pair = pair.join(far(apart), ["x", "y"], "left_anti")
                ways = pair.select("x", "y", "s", F.col("cx").alias("own"), F.col("cy").alias("other")).union(pair.select("y", "x", "s", "cy", "cx"))
                best = ways.groupBy("x").agg(F.max_by(F.struct("y", "own", "other"), "s").alias("best"), F.count("*").alias("degree"))
                if banned is not None:
                    best = best.join(far(held), "x", "left")
                free = F.lit(True) if banned is None else F.col("held").isNull()
                sure = (F.col("degree") == 1) & free & (F.col("best.own").isNull() | F.coalesce(F.col("best.own") == F.col("best.other"), F.lit(False)))
                best = cut(best.select("x", F.col("best.y").alias("y"), sure.alias("sure")), "batch-best")
                if not best.take(1):  # while a link is left, the strongest of all is taken
                    break
                # x chooses y, y chooses z, z chooses w: a pair chooses each other and takes the smaller's name; a sure one takes that of y's pair
                chain = best.join(far(best.select(F.col("x").alias("y"), F.col("y").alias("z"))), "y").join(far(best.select(F.col("x").alias("z"), F.col("y").alias("w"))), "z")
                to = F.when(F.col("z") == F.col("x"), F.least("x", "y")).when(F.col("sure") & (F.col("w") == F.col("y")), F.least("y", "z")).when(F.col("sure"), F.col("y"))
                named = chain.select(F.col("x").alias("component"), to.alias("to")).where("to <> component")
                now = cut(now.join(far(named), "component", "left").select("node", F.coalesce("to", "component").alias("component"), "cls"), "batch-round")
                grown.drop(keep=1)
            else:
                raise RuntimeError("clusters did not settle")
        low = now.groupBy("component").agg(F.min("node").alias("low"))
        out = cut(clean.union(now.join(far(low), "component").select("node", "low")), "batch-clusters")
        whole.drop(keep=1)
    return out


def batch_clusters(identifiers: DataFrame, records: DataFrame, graph: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """New records to (record_id, cluster), the smallest record of the person that they make; every record has one.

    Columns of records as in batch_judged. forbidden (a, b) are pairs of records that a reviewer has locked apart.
    """
    judged = cut(batch_judged(identifiers, records, graph), "batch-judged")
    merging = judged.where("decision = 'merge'").select(F.col("record_id").alias("a"), F.col("person_id").alias("b"), F.col("confidence").alias("weight"))
    far = joined(records.count())
    own = identifiers.join(far(records.select("record_id")), "record_id", "left_semi")
    found = constrained_components(merging, government_classes(own), forbidden)  # conflicting ids are of different classes
    return records.select("record_id").join(far(found.select(F.col("node").alias("record_id"), "component")), "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("cluster"))
