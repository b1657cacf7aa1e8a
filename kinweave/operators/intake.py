"""What happens to records between a source and the graph: envelopes, exclusions, parents, contacts, registers, coverage and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facts import digest
from ..functions.normalize import relationship_category

#: What can become of a stage-history row in the end.
DISPOSITIONS = ["malformed_excluded", "capture_rejected_valid", "excluded_out_of_scope", "same_hash_replay", "differing_hash_conflict", "canonical_effective", "canonical_pending_parent", "parent_ambiguous", "parent_waiting"]


def with_side_lists(users: DataFrame, key: str, **sides: tuple[DataFrame, list[str]]) -> DataFrame:
    """Users with a sorted list of structs from each side table, empty where it has none: sides name=(frame, columns).

    Each side is grouped once over all users, in place of a lookup by chunks of users.
    """
    out = users
    for name, (side, columns) in sides.items():
        lists = side.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def product_chain(lines: DataFrame, offers: DataFrame, variants: DataFrame, products: DataFrame) -> DataFrame:
    """Lines (offer_id, ...) with their merchant's offer, its variant and its product; a missing link leaves nulls behind it."""
    return lines.join(offers, "offer_id", "left").join(variants, "variant_id", "left").join(products, "product_id", "left")


def chat_text(chats: DataFrame, *logs: DataFrame) -> DataFrame:
    """chats (chat_id) with text, one transcript of several logs (chat_id, at, origin, id, part, line): by time, null last, then origin, id and part.

    Blank lines are left out; a chat without any has an empty text.
    """
    rows = logs[0]
    for log in logs[1:]:
        rows = rows.unionByName(log)
    place = F.struct(F.col("at").isNull().alias("none"), "at", "origin", "id", "part", "line")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["line"]), "\n")
    return chats.join(rows.where("trim(line) <> ''").groupBy("chat_id").agg(text.alias("text")), "chat_id", "left").na.fill("", ["text"])


def preferred_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (child_id, parent_source, parent_record_id) with the parent version they hang on: an active one before a pending one, the newest first.

    parents (record_id, parent_source, parent_record_id, lifecycle_status, version). The best parent of each source record is found first, so children
    join one row. Children without a parent keep null.
    """
    live = parents.where("lifecycle_status in ('active', 'pending_review')")
    best = F.min_by(F.struct("record_id", "lifecycle_status"), F.struct((F.col("lifecycle_status") != "active").alias("p"), (-F.col("version")).alias("v"), F.col("record_id")))
    return children.join(live.groupBy("parent_source", "parent_record_id").agg(best.alias("b")), ["parent_source", "parent_record_id"], "left").select("child_id", F.col("b.record_id").alias("parent_id"), F.col("b.lifecycle_status").alias("parent_status"))


def unchanged_identity(incoming: DataFrame, active: DataFrame, columns: list[str]) -> DataFrame:
    """Records whose identity did not change, with the owner they keep: record_id, person_id.

    incoming (record_id, source_record_id, columns), active (source_record_id, person_id, columns): one owner before, and all columns equal, nulls too.
    """
    owners = active.groupBy("source_record_id").agg(F.countDistinct("person_id").alias("n"), F.min("person_id").alias("person_id"), F.max(F.struct(*columns)).alias("was"), F.countDistinct(F.struct(*columns)).alias("forms"))
    same = F.struct(*columns).eqNullSafe(F.col("was"))
    return incoming.drop("person_id").join(owners.where("n = 1 and forms = 1"), "source_record_id").where(same).select("record_id", "person_id")


def knows_from_contacts(contacts: DataFrame, links: DataFrame) -> DataFrame:
    """KNOWS edges of contact records whose two ends are both resolved: src, dst, label, category, record_id; the others wait for a later run.

    contacts (record_id, source_key, declarer_id, contact_id, label), links (source_key, source_record_id, person_id). A pair with a label is one
    edge, that of its newest record; nobody knows themself.
    """
    end = lambda c, name: links.select("source_key", F.col("source_record_id").alias(c), F.col("person_id").alias(name))
    both = contacts.join(end("declarer_id", "src"), ["source_key", "declarer_id"]).join(end("contact_id", "dst"), ["source_key", "contact_id"]).where("src <> dst")
    return both.groupBy("src", "dst", "label").agg(F.max("record_id").alias("record_id")).withColumn("category", relationship_category(F.col("label")))


def address_only(rows: DataFrame, addresses: DataFrame) -> DataFrame:
    """Register rows (record_id, normalized_full) on the address they name: record_id, address_id, is_new. They never make or touch a person.

    A new address is named by a digest of its text, so equal texts of one run are one address.
    """
    known = addresses.groupBy("normalized_full").agg(F.min("address_id").cast("string").alias("known"))
    out = rows.where("normalized_full is not null").join(known, "normalized_full", "left")
    return out.select("record_id", F.coalesce("known", F.concat(F.lit("new:"), digest(F.col("normalized_full"), 16))).alias("address_id"), F.col("known").isNull().alias("is_new"))


def bankruptcy_cases(held: DataFrame, rows: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases by source and case id, and their edges to persons. rows (source_key, case_id, status, filed_at, document, nric): the newest filing counts,
    fields that it leaves open keep what was held. owners (nric, person_id): a case meets its person where the id has one owner."""
    newest = rows.groupBy("source_key", "case_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("filed_at"))).alias(f"new_{c}") for c in ("status", "filed_at", "document", "nric")))
    cases = held.join(newest, ["source_key", "case_id"], "full").select("source_key", "case_id", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("status", "filed_at", "document", "nric")))
    single = owners.groupBy("nric").agg(F.countDistinct("person_id").alias("n"), F.min("person_id").alias("person_id")).where("n = 1").drop("n")
    return cases, cases.join(single, "nric").select("source_key", "case_id", "person_id")


def vehicles_without(observations: DataFrame, excluded: DataFrame) -> DataFrame:
    """Observations but those of excluded vehicles (product_sku, lta_tag, serial_number): the product with the tag, or with the serial number."""
    by = lambda df, c: df.join(excluded.where(F.col(c).isNotNull()).select("product_sku", c).distinct(), ["product_sku", c], "left_anti")
    return by(by(observations, "lta_tag"), "serial_number").select(*observations.columns)


def filtered_extractions(rows: DataFrame, phones: list[str], emails: list[str], names: list[str], references: list[str]) -> DataFrame:
    """Extractions without excluded people: persons, possible_persons and strong_identifiers are arrays of structs; one left without any is dropped.

    The lists are the configuration of a source. persons have phone, email and name; possible persons identifiers (type, value) too.
    """
    has = lambda c, values: F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)
    strong = lambda i: F.when(i["type"] == "phone", has(i["value"], phones)).when(i["type"] == "email", has(i["value"], emails)).when(i["type"] == "source_customer_ref", has(i["value"], references)).otherwise(False)
    person = lambda p: has(p["phone"], phones) | has(p["email"], emails) | has(p["name"], names)
    out = rows.withColumns({
        "persons": F.filter("persons", lambda p: ~person(p)),
        "possible_persons": F.filter("possible_persons", lambda p: ~(person(p) | F.coalesce(F.exists(p["identifiers"], strong), F.lit(False)))),
        "strong_identifiers": F.filter("strong_identifiers", lambda i: ~strong(i)),
    })
    return out.where(F.coalesce(F.size("persons"), F.lit(0)) + F.coalesce(F.size("possible_persons"), F.lit(0)) + F.coalesce(F.size("strong_identifiers"), F.lit(0)) > 0)


#: What a backfill can make of an item.
COVERAGE = {"created": "created", "duplicate": "existing_same_hash", "projection": "updated_projection", "unchanged": "scope_unchanged", "excluded": "excluded_out_of_scope", "quarantine": "quarantined_owner_unresolved", "conflict": "conflict", "failed": "failed"}


def coverage_report(coverage: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per generation and stream: items, those that ended, one count for each disposition, and what the newest checkpoint says was committed."""
    counts = [F.count_if(F.col("disposition") == d).alias(f"{name}_count") for name, d in COVERAGE.items()]
    own = coverage.groupBy("generation", "stream").agg(F.count("*").alias("coverage_count"), F.count_if("terminal").alias("terminal_count"), *counts)
    last = checkpoints.groupBy("generation", "stream").agg(F.max_by("committed_count", "updated_at").alias("checkpoint_committed_count"))
    return own.join(last, ["generation", "stream"], "left")


def known_owner_refresh(known: DataFrame, read: DataFrame, included: list, misses: int) -> DataFrame:
    """Known deals (deal_id, absent_before) against what was read again (deal_id, category): refreshed, out_of_scope, absent once more, or failed after so many misses."""
    out = known.join(read.withColumn("found", F.lit(True)), "deal_id", "left")
    inside = F.coalesce(F.col("category").isin(*included), F.lit(False))
    state = F.when(F.col("found"), F.when(inside, "refreshed").otherwise("out_of_scope")).when(F.col("absent_before") + 1 >= misses, "failed").otherwise("absent")
    return out.select("deal_id", state.alias("outcome"), F.when(F.col("found"), 0).otherwise(F.col("absent_before") + 1).cast("long").alias("absent"))


def terminal_disposition(scope: Column, captured: Column, hash_state: Column, association: Column) -> Column:
    """What becomes of a row in the end, by its scope, whether capture took it, its hash and its parent; null where these do not agree with any."""
    return (
        F.when(scope == "malformed", "malformed_excluded").when(~captured, "capture_rejected_valid").when(scope == "out_of_scope", "excluded_out_of_scope")
        .when(hash_state == "existing_same_hash", "same_hash_replay").when(hash_state == "new_conflict_variant", "differing_hash_conflict")
        .when(association == "selected_active", "canonical_effective").when(association == "selected_pending_review", "canonical_pending_parent")
        .when(association == "ambiguous", "parent_ambiguous").when(association == "waiting", "parent_waiting")
    )


def invalidation_intents(ledger: DataFrame, published: DataFrame) -> DataFrame:
    """Parents to recompute, once for each decision that touched them and was not published before: parent, identity, version."""
    rows = ledger.select(F.explode("invalidates").alias("parent"), "identity", "version")
    return rows.join(published.select("identity", "version"), ["identity", "version"], "left_anti").distinct()


def mapping_digest(entries: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a stage mapping, whatever the order of its rows: a mapping has a row for each stage of a pipeline, a few hundred."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return entries.select(row.alias("r")).distinct().agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list("r")), ","), 256)).alias("digest"))


def set_differences(expected: DataFrame, found: DataFrame, key: str, by: str) -> DataFrame:
    """Per group: members that are missing and members too many; equal where both are 0, a subset where none is too many."""
    both = expected.select(by, key, F.lit(1).alias("e"), F.lit(0).alias("f")).union(found.select(by, key, F.lit(0), F.lit(1))).groupBy(by, key).agg(F.max("e").alias("e"), F.max("f").alias("f"))
    out = both.groupBy(by).agg(F.count_if((F.col("e") == 1) & (F.col("f") == 0)).alias("missing"), F.count_if((F.col("e") == 0) & (F.col("f") == 1)).alias("extra"))
    return out.withColumns({"is_equal": (F.col("missing") == 0) & (F.col("extra") == 0), "is_subset": F.col("extra") == 0})


#: Bounds of a generated text, in characters and words, and how it names its evidence.
MOST_CHARACTERS, MOST_WORDS, EVIDENCE = 12_000, 350, r"\b((?:source|order|vehicle|relationship)-[a-z0-9_-]+)\b"
#: What tells a person directly: an address of mail, a long number, a government id.
DIRECT = r"[\w.+-]+@[\w-]+\.[\w.]+|\d{8,}|\b[STFGM]\d{7}[A-Z]\b"


def output_fault(text: Column, evidence: Column, sensitive: Column) -> Column:
    """The first rule that a generated text breaks, or null: trimmed, bounded, plain, with limitations, citing given evidence alone, naming nobody.

    evidence and sensitive are arrays of texts; sensitive values are looked for without regard to case.
    """
    cited = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(EVIDENCE)))
    plain = ~(text.contains("```") | text.contains("~~~") | text.rlike(r"</?[A-Za-z][^>]*>") | text.rlike(r'^(\{|\[\s*(\]|\[|\{|"|-?\d|true\b|false\b|null\b))'))
    rest = F.regexp_replace(F.lower(text), EVIDENCE, " ")
    known = F.exists(sensitive, lambda x: (x != "") & F.contains(rest, F.lower(x)))
    return (
        F.when(text.isNull() | (text == "") | (text != F.trim(text)), "not_trimmed").when((F.length(text) > MOST_CHARACTERS) | (F.size(F.split(F.trim(text), r"\s+")) > MOST_WORDS), "too_large")
        .when(~plain, "not_plain_text").when(~text.rlike(r"(?m)^Limitations:"), "missing_limitations").when(F.size(F.array_except(cited, evidence)) > 0, "unknown_evidence")
        .when(F.regexp_replace(text, "(?i)" + EVIDENCE, " ").rlike(DIRECT), "direct_identifier").when(known, "sensitive_value")
    )


def newest_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(*order)).alias("r")).select(*keys, "r.*")


def history_page(analyses: DataFrame, person_id, skip: int, limit: int) -> DataFrame:
    """A page of a person's analyses, newest first."""
    return analyses.where(F.col("person_id") == person_id).orderBy(F.desc("completed_at"), F.desc("analysis_id")).offset(skip).limit(limit)
