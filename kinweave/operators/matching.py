"""Identity resolution: candidates, rules, scores, bands, picks, pairs and merges.

Frames. identifiers (record_id, identifier_type, normalized_value, is_verified, quality_flag, position) come in with records; edges
(person_id, identifier_type, normalized_value, is_verified, quality_flag, is_active, ...) are held by persons. A pair row is
(record_id, person_id). All steps are joins and groupings over pairs, so a record's work follows the persons it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import USABLE, usable_evidence
from ..functions.similarity import best_name_similarity, email_near_match, phone_near_match
from ..staging import joined
from .connections import components

#: How many persons an identifier may reach before it is no key any more; other types are not capped.
FANOUT = {"phone": 50, "email": 100, "nric": 5, "device_id": 25, "social": 25}
#: Weights of the score.
WEIGHT = {"verified": 0.35, "unverified": 0.20, "high_fanout": -0.25, "near": 0.10, "cap": 0.85, "dob": 0.25, "dob_conflict": -0.30, "name_high": 0.20, "name_medium": 0.10, "name_mismatch": -0.25, "address": 0.10}
PHONE_PERSONS, NAME_HIGH, NAME_PARTIAL, PROMOTED, CONVERSATION_NAME = 5, 0.8, 0.5, 0.91, 0.8
BANDS = {"relationship": (0.20, 0.10), None: (0.40, 0.20)}
TRUSTED = ("external_customer_id", "membership_id")
NOT_SYSTEM = ("conversation", "relationship", "call")
REASSIGN, MARGIN = 0.90, 0.10
NAMES = ("full_name", "preferred_name", "legal_name")


def deduplicated(identifiers: DataFrame) -> DataFrame:
    """One row per record, type and value: verified if any row is, the best quality, the first position."""
    best = F.min(F.struct(F.when(F.col("quality_flag") == "valid", 0).when(F.col("quality_flag") == "partial_parse", 1).otherwise(2).alias("r"), F.col("quality_flag").alias("q")))["q"]
    return identifiers.groupBy("record_id", "identifier_type", "normalized_value").agg(F.bool_or("is_verified").alias("is_verified"), best.alias("quality_flag"), F.min("position").alias("position"))


def fanout(edges: DataFrame) -> DataFrame:
    """Persons behind each identifier, over all active edges."""
    active = edges.where(F.coalesce(F.col("is_active"), F.lit(False)))
    return active.groupBy("identifier_type", "normalized_value").agg(F.countDistinct("person_id").alias("fanout"))


def within_cap(kind: Column, n: Column) -> Column:
    cap = F.create_map(*(F.lit(x) for kv in FANOUT.items() for x in kv))[F.split_part(kind, F.lit(":"), F.lit(1))]
    return cap.isNull() | (n <= cap)


def blocking_keys(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """(identifier_type, normalized_value, person_id): usable edges of active persons whose identifier is within its cap.

    Hot identifiers are dropped before the join, so they never meet as keys; that is the rule, not a shortcut.
    """
    keys = edges.where(usable_evidence()).select("identifier_type", "normalized_value", "person_id").distinct()
    kept = fanout(edges).where(within_cap(F.col("identifier_type"), F.col("fanout"))).select("identifier_type", "normalized_value")
    return keys.join(kept, ["identifier_type", "normalized_value"], "left_semi").join(persons.where("status = 'active'").select("person_id"), "person_id", "left_semi")


def candidates(identifiers: DataFrame, edges: DataFrame, persons: DataFrame, addresses: DataFrame | None = None, homes: DataFrame | None = None) -> DataFrame:
    """(record_id, person_id) by a shared usable identifier or an equal address.

    addresses (record_id, normalized_full), homes (person_id, normalized_full, is_active).
    """
    usable = identifiers.where(F.col("quality_flag").isin(*USABLE)).select("record_id", "identifier_type", "normalized_value").distinct()
    found = usable.join(blocking_keys(edges, persons), ["identifier_type", "normalized_value"]).select("record_id", "person_id")
    if addresses is not None and homes is not None:
        live = homes.where(F.coalesce(F.col("is_active"), F.lit(False))).select("normalized_full", "person_id").distinct().join(persons.where("status = 'active'").select("person_id"), "person_id", "left_semi")
        found = found.union(addresses.select("record_id", "normalized_full").distinct().join(live, "normalized_full").select("record_id", "person_id"))
    return found.distinct()


def lock_pairs(locks: DataFrame, now) -> DataFrame:
    """Unexpired locks both ways: (a, b)."""
    live = locks.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return live.select("a", "b").union(live.select("b", "a")).distinct()


def locked_candidates(pairs: DataFrame, identifiers: DataFrame, edges: DataFrame, persons: DataFrame, locks: DataFrame, now) -> DataFrame:
    """Pairs vetoed by a lock: an active owner of one of the record's usable identifiers is locked against the candidate."""
    usable = identifiers.where(F.col("quality_flag").isin(*USABLE)).select("record_id", "identifier_type", "normalized_value")
    owners = edges.where(F.coalesce(F.col("is_active"), F.lit(False))).select("identifier_type", "normalized_value", F.col("person_id").alias("owner")).distinct()
    owners = owners.join(persons.where("status = 'active'").select(F.col("person_id").alias("owner")), "owner", "left_semi")
    # locks are few: they cut the owners before anything is paired
    against = owners.join(lock_pairs(locks, now).select(F.col("a").alias("owner"), F.col("b").alias("person_id")), "owner")
    hit = usable.join(against, ["identifier_type", "normalized_value"]).select("record_id", "person_id").distinct()
    return pairs.join(hit, ["record_id", "person_id"], "left_semi").select("record_id", "person_id").distinct()


def deterministic(pairs: DataFrame, identifiers: DataFrame, edges: DataFrame, record_type: str = "record_type", far=joined(0)) -> DataFrame:
    """Pairs (with record_type) with rule and verdict where a hard rule holds; others get null.

    Government ids in the record's order: the first that the person has merges, the first that conflicts with another valid one of the
    person forbids. Merging is left to records of systems; so are trusted ids. far marks what is joined (see staging.joined).
    """
    system = ~F.col(record_type).isin(*NOT_SYSTEM)
    mine = identifiers.where("quality_flag = 'valid'")
    held = edges.where(F.coalesce(F.col("is_active"), F.lit(False)))
    ids = held.where("identifier_type = 'nric' and quality_flag = 'valid'").groupBy("person_id").agg(F.collect_set("normalized_value").alias("held"))
    gov = pairs.select("record_id", "person_id").join(far(mine.where("identifier_type = 'nric'").select("record_id", "normalized_value", "position")), "record_id").join(far(ids), "person_id")
    first = gov.groupBy("record_id", "person_id").agg(F.min_by(F.array_contains("held", F.col("normalized_value")), "position").alias("same"))
    trusted = mine.where(F.col("identifier_type").isin(*TRUSTED)).select("record_id", "identifier_type", "normalized_value").join(held.select("person_id", "identifier_type", "normalized_value").distinct(), ["identifier_type", "normalized_value"])
    trusted = trusted.select("record_id", "person_id").distinct().withColumn("trusted", F.lit(True))
    out = pairs.join(far(first), ["record_id", "person_id"], "left").join(far(trusted), ["record_id", "person_id"], "left")
    verdict = F.when(~F.col("same"), "no_match").when(F.col("same") & system, "merge").when(F.col("trusted") & system, "merge")
    rule = F.when(~F.col("same"), "government_id_conflict").when(F.col("same") & system, "government_id").when(F.col("trusted") & system, "trusted_id")
    return out.withColumns({"rule": rule, "verdict": verdict}).drop("same", "trusted")


def identifier_evidence(pairs: DataFrame, identifiers: DataFrame, edges: DataFrame, near: bool = True, reach: DataFrame | None = None, far=joined(0)) -> DataFrame:
    """Per pair: evidence (uncapped), phone_exact, email_exact, high_fanout, corroborated, phone_near, email_near.

    An edge may carry source_type; an edge from a conversation does not corroborate. near=False leaves near misses out. reach holds the
    edges that tell hot phones, where they are others than edges. far marks what is joined (see staging.joined); hot phones are not marked, as
    all rows of one would meet in a task.
    """
    kinds = ["phone", "email"]
    mine = pairs.select("record_id", "person_id").join(far(identifiers.where(F.col("identifier_type").isin(*kinds)).select("record_id", "identifier_type", "normalized_value", F.col("is_verified").alias("mine_verified"))), "record_id")
    system = (F.coalesce(F.col("source_type"), F.lit("conversation")) != "conversation") if "source_type" in edges.columns else F.lit(True)
    held = edges.where(usable_evidence() & F.col("identifier_type").isin(*kinds)).groupBy("person_id", "identifier_type", "normalized_value").agg(F.bool_or("is_verified").alias("held_verified"), F.bool_or(system).alias("system"))
    hot_phones = fanout(edges if reach is None else reach).where((F.col("identifier_type") == "phone") & (F.col("fanout") > PHONE_PERSONS)).select("identifier_type", "normalized_value", F.lit(True).alias("hot"))
    exact = mine.join(far(held), ["person_id", "identifier_type", "normalized_value"], "left").join(hot_phones, ["identifier_type", "normalized_value"], "left")
    hit = F.col("held_verified").isNotNull()
    hot = hit & F.coalesce(F.col("hot"), F.lit(False))
    worth = F.when(hit, F.when(F.col("mine_verified") & F.col("held_verified"), WEIGHT["verified"]).otherwise(WEIGHT["unverified"])).otherwise(0.0) + F.when(hot, WEIGHT["high_fanout"]).otherwise(0.0)
    of = lambda k: F.col("identifier_type") == k
    out = exact.groupBy("record_id", "person_id").agg(
        F.sum(worth).alias("evidence"), F.bool_or(hit & of("phone")).alias("phone_exact"), F.bool_or(hit & of("email")).alias("email_exact"), F.bool_or(hot).alias("high_fanout"),
        F.bool_or(hit & F.coalesce(F.col("system"), F.lit(False))).alias("corroborated"),
    )
    if not near:
        return out.withColumns({"phone_near": F.lit(False), "email_near": F.lit(False)})
    unmatched = exact.where(~hit).select("record_id", "person_id", "identifier_type", F.col("normalized_value").alias("x"))
    others = unmatched.join(far(held.select("person_id", "identifier_type", F.col("normalized_value").alias("y"))), ["person_id", "identifier_type"])
    close = others.groupBy("record_id", "person_id").agg(F.bool_or(of("phone") & phone_near_match(F.col("x"), F.col("y"))).alias("phone_near"), F.bool_or(of("email") & email_near_match(F.col("x"), F.col("y"))).alias("email_near"))
    out = out.join(far(close), ["record_id", "person_id"], "left").na.fill(False, ["phone_near", "email_near"])
    return out.withColumn("evidence", F.col("evidence") + F.when(F.col("phone_near"), WEIGHT["near"]).otherwise(0) + F.when(F.col("email_near"), WEIGHT["near"]).otherwise(0))


def scored(rows: DataFrame) -> DataFrame:
    """Pair rows with evidence, signals, record_type, dob, held_dobs, name_similarity (null: a side has no name), address_match to confidence and decision."""
    w = WEIGHT
    has_dob = F.col("dob").isNotNull() & (F.size("held_dobs") > 0)
    same_dob = F.coalesce(has_dob & F.array_contains("held_dobs", F.col("dob")), F.lit(False))
    dob_conflict = F.coalesce(has_dob & ~F.array_contains("held_dobs", F.col("dob")), F.lit(False))
    sim = F.col("name_similarity")
    name = F.when(sim.isNull(), 0.0).when(sim > NAME_HIGH, w["name_high"]).when(sim >= NAME_PARTIAL, w["name_medium"]).otherwise(w["name_mismatch"])
    mismatch = F.coalesce(sim < NAME_PARTIAL, F.lit(False))
    raw = F.least(F.col("evidence"), F.lit(w["cap"])) + F.when(same_dob, w["dob"]).when(dob_conflict, w["dob_conflict"]).otherwise(0.0) + name + F.when(F.col("address_match"), w["address"]).otherwise(0.0)
    conflict = dob_conflict | mismatch | F.col("high_fanout")
    out = rows.withColumns({"raw_score": F.round(raw, 6), "hard_conflict": conflict, "dob_match": same_dob})
    plain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_score")))
    some = F.col("phone_exact") | F.col("email_exact")
    corroborated = (F.col("phone_exact") & F.col("email_exact")) | (some & (F.coalesce(sim >= CONVERSATION_NAME, F.lit(False)) | F.col("address_match") | F.col("dob_match")))
    talk = corroborated & F.col("corroborated") & ~F.col("hard_conflict")
    related = F.col("phone_exact") & F.coalesce(sim >= NAME_PARTIAL, F.lit(False)) & ~F.col("hard_conflict")
    confidence = (
        F.when(F.col("record_type") == "conversation", F.when(talk, PROMOTED).otherwise(F.least(plain, F.lit(BANDS[None][0] - 0.01))))
        .when((F.col("record_type") == "relationship") & related, PROMOTED).otherwise(plain)
    )
    return out.withColumn("confidence", confidence).withColumn("decision", band(F.col("confidence"), F.col("record_type"), F.col("hard_conflict")))


def band(confidence: Column, record_type: Column, conflict: Column) -> Column:
    """merge, review or no_match; a conflict forbids merging in the relationship band alone."""
    rel = record_type == "relationship"
    merge = F.when(rel, (confidence >= BANDS["relationship"][0]) & ~conflict).otherwise(confidence >= BANDS[None][0])
    return F.when(merge, "merge").when(confidence >= F.when(rel, BANDS["relationship"][1]).otherwise(BANDS[None][1]), "review").otherwise("no_match")


def names_of(facts: DataFrame, key: str, name: str) -> DataFrame:
    return facts.where(F.col("attribute_name").isin(*NAMES)).groupBy(key).agg(F.sort_array(F.collect_set("attribute_value")).alias(name))


def name_similarity(pairs: DataFrame, incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs with name_similarity, the best over both lists: incoming (record_id, names), held (person_id, held_names)."""
    return pairs.join(incoming, "record_id", "left").join(held, "person_id", "left").withColumn("name_similarity", best_name_similarity("names", "held_names")).drop("names", "held_names")


def best_match(pairs: DataFrame) -> DataFrame:
    """Scored pairs (record_id, person_id, decision, confidence) to one row per record: the best merge, else the best review, else no_match.

    also_linked: other persons that merge by themselves; the record is linked to them, they are not merged with each other.
    """
    rank = F.when(F.col("decision") == "merge", 0).when(F.col("decision") == "review", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), F.col("person_id").alias("p"), F.col("decision").alias("d")))
    merging = F.array_sort(F.collect_set(F.when(F.col("decision") == "merge", F.col("person_id"))))
    out = pairs.groupBy("record_id").agg(best.alias("b"), merging.alias("all"))
    none = F.col("b.r") == 2
    return out.select("record_id", F.col("b.d").alias("decision"), F.when(none, 0.0).otherwise(-F.col("b.c")).alias("confidence"), F.when(~none, F.col("b.p")).alias("person_id"), F.when(F.col("b.r") == 0, F.array_remove("all", F.col("b.p"))).otherwise(F.array().cast("array<bigint>")).alias("also_linked"))


def continuity(best: DataFrame, prior: DataFrame, pairs: DataFrame) -> DataFrame:
    """best with prior owners (record_id, prior_id): a changed record moves only at high confidence and margin over its owner's, else review.

    Several prior owners are reviewed on the smallest.
    """
    owners = prior.groupBy("record_id").agg(F.min("prior_id").alias("prior_id"), F.countDistinct("prior_id").alias("n"))
    own = pairs.select("record_id", F.col("person_id").alias("prior_id"), F.col("confidence").alias("own"))
    out = best.join(owners, "record_id", "left").join(own, ["record_id", "prior_id"], "left")
    moves = F.col("own").isNotNull() & (F.col("decision") == "merge") & (F.col("confidence") >= REASSIGN) & (F.col("confidence") - F.col("own") + 1e-12 >= MARGIN) & (F.size("also_linked") == 0)
    stays = F.coalesce(F.col("person_id") == F.col("prior_id"), F.lit(False)) & (F.size("also_linked") == 0)
    outcome = F.when(F.col("n").isNull(), F.col("decision")).when(F.col("n") > 1, "review").when(stays, F.col("decision")).when(moves, "merge").otherwise("review")
    person = F.when(F.col("n").isNull() | (F.coalesce(F.col("n") == 1, F.lit(False)) & moves), F.col("person_id")).otherwise(F.col("prior_id"))
    return out.select("record_id", outcome.alias("decision"), "confidence", person.alias("person_id"), F.col("n").isNotNull().alias("had_owner"))


def pair_audit(edges: DataFrame, persons: DataFrame, locks: DataFrame, now, open_cases: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b) of active persons that share a usable identifier within its cap, less locked ones and ones with an open case (a, b)."""
    keys = blocking_keys(edges, persons)
    many = keys.groupBy("identifier_type", "normalized_value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = keys.join(many, ["identifier_type", "normalized_value"], "left_semi")
    a, b = own.withColumnRenamed("person_id", "a"), own.withColumnRenamed("person_id", "b")
    pairs = a.join(b, ["identifier_type", "normalized_value"]).where("a < b").select("a", "b").distinct()
    pairs = pairs.join(lock_pairs(locks, now), ["a", "b"], "left_anti")
    return pairs if open_cases is None else pairs.join(open_cases.select("a", "b"), ["a", "b"], "left_anti")


def survivor(pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """Pairs (a, b) with survivor and absorbed: the more complete person, then the older, then the smaller id."""
    key = lambda side: persons.select(F.col("person_id").alias(side), F.struct((-F.coalesce(F.col("completeness"), F.lit(0.0))).alias("c"), F.col("created_at").alias("t"), F.col("person_id").alias("p")).alias(f"key_{side}"))
    out = pairs.join(key("a"), "a").join(key("b"), "b")
    first = F.col("key_a") < F.col("key_b")
    return out.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("survivor"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("absorbed"))


def resolved_groups(merges: DataFrame, locks: DataFrame, now) -> DataFrame:
    """Merge pairs (a, b) to (node, component, blocked): a component that holds a locked pair is blocked as a whole and goes to review."""
    found = components(merges)
    a, b = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    bad = lock_pairs(locks, now).join(a, "a").join(b, "b").where("ca = cb").select(F.col("ca").alias("component")).distinct().withColumn("blocked", F.lit(True))
    return found.join(bad, "component", "left").select("node", "component", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def person_assignment(best: DataFrame, clusters: DataFrame) -> DataFrame:
    """Persons for the records of a batch: merged records go to theirs, those in review to none yet, and the others to the
    new person of their cluster (record_id, cluster), named by its smallest record."""
    to_person = best.where("decision = 'merge'").select("record_id", F.concat(F.lit("p:"), F.col("person_id").cast("string")).alias("person"))
    fresh = best.where("decision = 'no_match'").select("record_id")
    group = fresh.join(clusters, "record_id", "left").select("record_id", F.concat(F.lit("n:"), F.coalesce("cluster", "record_id").cast("string")).alias("person"))
    return to_person.union(group)
