"""What merges and their undoing make of the edges of persons, what two persons share, and what sources cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .connections import active_merges, canonical, shared_by

#: Kinds of edges with a person at one end. KNOWS has one at both, so it is listed from either.
EDGE_KINDS = ["LINKED_TO", "IDENTIFIED_BY", "LIVES_AT", "HAS_FACT", "PURCHASED", "OWNS_VEHICLE", "BOUGHT_VEHICLE", "KNOWS_OUT", "KNOWS_IN"]
INTERACTIONS = ["conversation", "call", "crm_history"]


def edges_after_merges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """edges (kind, person_id, target) after all merge events: (kind, person_id, target, origins, moved).

    The log decides: an edge lies with the person that its own one is merged into in the end, and an undone merge leaves it, or gives it
    back, to its origin. Ends of KNOWS follow their persons, and those that come to be one person are dropped. Equal edges
    are one: origins counts the persons they came from, moved says that one of them is another than the holder.
    """
    lineage = canonical(active_merges(events)).select("absorbed", "canonical")
    held = edges.join(lineage.withColumnRenamed("absorbed", "person_id"), "person_id", "left").withColumn("holder", F.coalesce("canonical", "person_id")).drop("canonical")
    other = F.when(F.col("kind").startswith("KNOWS"), F.col("target"))
    held = held.withColumn("other", other).join(lineage.select(F.col("absorbed").cast("string").alias("other"), F.col("canonical").cast("string").alias("end")), "other", "left")
    held = held.withColumn("target", F.coalesce("end", "target")).where(F.col("other").isNull() | (F.col("target") != F.col("holder").cast("string")))
    return held.groupBy("kind", F.col("holder").alias("person_id"), "target").agg(F.countDistinct("person_id").alias("origins"), F.bool_or(F.col("person_id") != F.col("holder")).alias("moved"))


def possible_matches(identified_by: DataFrame, persons: DataFrame, asked: DataFrame) -> DataFrame:
    """What the asked persons (person_id) share with others: (person_id, candidate_id, identifier_type, normalized_value, own_sources, candidate_sources), sources as sorted lists."""
    key = ["identifier_type", "normalized_value"]
    pairs = shared_by(identified_by, key, persons, only=asked).withColumnRenamed("other_id", "candidate_id")
    sources = identified_by.where("coalesce(is_active, true)").groupBy("person_id", *key).agg(F.array_sort(F.collect_set("source_key")).alias("sources"))
    own = sources.withColumnRenamed("sources", "own_sources")
    theirs = sources.withColumnRenamed("person_id", "candidate_id").withColumnRenamed("sources", "candidate_sources")
    return pairs.join(own, ["person_id", *key]).join(theirs, ["candidate_id", *key])


def source_coverage(records: DataFrame, systems: DataFrame, cutoff: Column) -> DataFrame:
    """Records that were there at the cutoff by source, entity and type, and what they lack; sources without any have one row of zeros."""
    there = records.where(F.col("ingested_at").isNull() | (F.col("ingested_at") <= cutoff)).withColumn("there", F.lit(True))
    found = systems.select("source_key").join(there, "source_key", "left")
    count = lambda c: F.count_if(F.coalesce(F.col("there") & c, F.lit(False)))
    return found.groupBy("source_key", F.coalesce("entity_key", F.lit(-1)).alias("entity_key"), F.coalesce("record_type", F.lit("")).alias("record_type")).agg(
        F.count("there").alias("records"), count(F.col("observed_at").isNull()).alias("missing_observed_at"), count(F.col("ingested_at").isNull()).alias("missing_ingested_at"),
        count(F.coalesce("lifecycle_status", F.lit("active")) == "active").alias("active"), count(F.col("lifecycle_status") == "superseded").alias("superseded"),
    )


def interaction_coverage(records: DataFrame, cutoff: Column) -> DataFrame:
    """Interactions known at the cutoff, the newest version of each: counts by source and type, with those of extractions."""
    known = records.where(F.col("record_type").isin(*INTERACTIONS) & F.coalesce(F.col("history_family") == "activity", F.lit(True)) & (F.col("ingested_at") <= cutoff))
    newest = known.groupBy("source_key", "record_type", "source_record_id").agg(F.max_by("lifecycle_status", F.struct("version", "record_id")).alias("status"), F.count("*").alias("versions"))
    status = F.coalesce("status", F.lit("active"))
    return newest.groupBy("source_key", "record_type").agg(F.count("*").alias("interactions"), F.sum("versions").alias("versions"), F.count_if(status == "active").alias("active"))


def fingerprint(*fields: tuple[str, Column]) -> Column:
    """sha256:<hex> of the canonical JSON of fields: keys sorted, no blanks, nulls written."""
    body = F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields))), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))
