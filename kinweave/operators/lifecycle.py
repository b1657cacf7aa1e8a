"""Golden profiles, record versions, activation, retirement and sinks by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of trust tiers.
TIER_RANK = {"tier_1": 4, "tier_2": 3, "tier_3": 2, "tier_4": 1}
CORE = ["full_name", "dob", "phone", "email", "address"]


def tier_rank(tier: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TIER_RANK.items() for x in kv))[tier], F.lit(0))


def best_facts(facts: DataFrame, drop_invalid: bool = False, valid_first: bool = True) -> DataFrame:
    """(person_id, attribute_name, value): valid first, then trust, then newest; ties by the smallest record.

    drop_invalid leaves out facts of invalid_format and placeholder_value, as the profile page does; valid_first=False ranks by trust alone.
    """
    rows = facts.where(~F.col("quality_flag").isin("invalid_format", "placeholder_value")) if drop_invalid else facts
    key = [(F.col("quality_flag") == "valid").cast("int").alias("q")] if valid_first else []
    best = F.max_by("attribute_value", F.struct(*key, tier_rank(F.col("trust_tier")).alias("t"), F.col("observed_at").alias("o"), (-F.col("record_id")).alias("r")))
    return rows.groupBy("person_id", "attribute_name").agg(best.alias("value"))


def best_identifiers(edges: DataFrame) -> DataFrame:
    """(person_id, identifier_type, value): verified first, then the newest confirmation, then the smallest value."""
    order = Window.partitionBy("person_id", "identifier_type").orderBy(F.desc("is_verified"), F.desc("confirmed_at"), "normalized_value")
    return edges.withColumn("at", F.row_number().over(order)).where("at = 1").select("person_id", "identifier_type", F.col("normalized_value").alias("value"))


def best_addresses(homes: DataFrame) -> DataFrame:
    order = Window.partitionBy("person_id").orderBy(F.desc("is_verified"), F.desc("confirmed_at"), "address_id")
    return homes.withColumn("at", F.row_number().over(order)).where("at = 1").select("person_id", "address_id")


def golden_profile(facts: DataFrame, edges: DataFrame, homes: DataFrame, overrides: DataFrame | None = None, page: bool = False) -> DataFrame:
    """One row per person with evidence: preferred values and completeness, the share of five core fields.

    Two forms. Ingestion (page=False): the name falls back to the preferred and the legal one, completeness has two decimals. The profile
    page (page=True): invalid facts are dropped and overrides (person_id, attribute_name, custom_value) win.
    """
    picked = best_facts(facts, drop_invalid=page, valid_first=not page)
    if page and overrides is not None:
        custom = overrides.where("custom_value <> ''").select("person_id", "attribute_name", "custom_value")
        picked = picked.join(custom, ["person_id", "attribute_name"], "full").select("person_id", "attribute_name", F.coalesce("custom_value", "value").alias("value"))
    wide = picked.groupBy("person_id").pivot("attribute_name", ["full_name", "preferred_name", "legal_name", "dob"]).agg(F.first("value"))
    ids = best_identifiers(edges).groupBy("person_id").pivot("identifier_type", ["phone", "email", "nric"]).agg(F.first("value"))
    out = wide.join(ids, "person_id", "full").join(best_addresses(homes), "person_id", "full")
    name = F.col("full_name") if page else F.coalesce("full_name", "preferred_name", "legal_name")
    filled = sum((c.isNotNull().cast("int") for c in (name, F.col("dob"), F.col("phone"), F.col("email"), F.col("address_id"))), F.lit(0)) / len(CORE)
    return out.select("person_id", name.alias("preferred_full_name"), F.col("dob").alias("preferred_dob"), F.col("phone").alias("preferred_phone"), F.col("email").alias("preferred_email"), F.col("nric").alias("preferred_nric"), F.col("address_id").alias("preferred_address_id"), (filled if page else F.round(filled, 2)).alias("completeness"))


def override_options(facts: DataFrame, edges: DataFrame, homes: DataFrame) -> DataFrame:
    """What a person's fields may be pinned to: (person_id, field, value), from facts, identifiers and addresses."""
    a = facts.select("person_id", F.col("attribute_name").alias("field"), F.col("attribute_value").alias("value"))
    b = edges.select("person_id", F.col("identifier_type").alias("field"), F.col("normalized_value").alias("value"))
    c = homes.select("person_id", F.lit("address").alias("field"), F.col("normalized_full").alias("value"))
    return a.union(b).union(c).distinct()


def planned_versions(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """incoming (source_record_id, record_hash) against held (source_record_id, record_hash, version, lifecycle_status): plan and version.

    The hash of the active or pending version is a duplicate; else the next version is staged, and a pending one is rejected by it.
    """
    open_ = held.where("lifecycle_status in ('active', 'pending_review')")
    state = held.groupBy("source_record_id").agg(F.max("version").alias("newest"))
    hashes = open_.groupBy("source_record_id").agg(
        F.max_by(F.when(F.col("lifecycle_status") == "active", F.col("record_hash")), F.when(F.col("lifecycle_status") == "active", F.col("version"))).alias("active_hash"),
        F.max_by(F.when(F.col("lifecycle_status") == "pending_review", F.col("record_hash")), F.when(F.col("lifecycle_status") == "pending_review", F.col("version"))).alias("pending_hash"),
    )
    out = incoming.join(state, "source_record_id", "left").join(hashes, "source_record_id", "left")
    same = F.coalesce((F.col("record_hash") == F.col("active_hash")) | (F.col("record_hash") == F.col("pending_hash")), F.lit(False))
    plan = F.when(same, "duplicate").when(F.col("newest").isNull(), "first").otherwise("next")
    return out.select(*incoming.columns, plan.alias("plan"), F.when(~same, F.coalesce("newest", F.lit(0)) + 1).alias("version"), (~same & F.col("pending_hash").isNotNull()).alias("rejects_pending"))


def scd2(records: DataFrame, key: str = "source_record_id", at: str = "observed_at", by: str = "record_id", value: str = "record_hash") -> DataFrame:
    """Records of one source identity in order to versions: runs of an equal hash are one version, valid until the next begins."""
    order = Window.partitionBy(key).orderBy(at, by)
    new = F.when(F.lag(value).over(order).eqNullSafe(F.col(value)) & F.lag(by).over(order).isNotNull(), 0).otherwise(1)
    kept = records.withColumn("new", new).where("new = 1").withColumn("version", F.row_number().over(order).cast("long"))
    following = F.lead(by).over(order)
    return kept.select(key, by, value, "version", following.alias("superseded_by"), following.isNull().alias("is_active"))


def retired(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that a full listing no longer has."""
    return previous.select(key).distinct().join(current.select(key), key, "left_anti")


def retire_evidence(edges: DataFrame, superseded: DataFrame, key: str = "record_id") -> DataFrame:
    """Edges of superseded records become inactive; none is dropped."""
    gone = superseded.select(key).distinct().withColumn("gone", F.lit(True))
    return edges.join(gone, key, "left").withColumn("is_active", F.when(F.col("gone"), F.lit(False)).otherwise(F.col("is_active"))).drop("gone")


def dirty_persons(*touched: DataFrame) -> DataFrame:
    """Persons that any of several changes (person_id) reaches, once each."""
    out = touched[0].select("person_id")
    for t in touched[1:]:
        out = out.union(t.select("person_id"))
    return out.where("person_id is not null").distinct()


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of changes win by key, column by column where they are not null; new keys are added. One shuffle on the keys."""
    rest = [c for c in target.columns if c not in keys]
    side = changes.select(*keys, *(F.col(c).alias(f"new_{c}") for c in rest))
    return target.join(side, keys, "full").select(*keys, *(F.coalesce(f"new_{c}", c).alias(c) for c in rest))


def match_only(records: DataFrame, assigned: DataFrame, types: tuple[str, ...] = ("conversation", "call")) -> DataFrame:
    """Records with the person they matched; kinds that never make a person are dropped where they matched none."""
    out = records.join(assigned.select("record_id", "person_id"), "record_id", "left")
    return out.where(~F.col("record_type").isin(*types) | F.col("person_id").isNotNull())


def unambiguous_contacts(contacts: DataFrame) -> DataFrame:
    """contacts (record_id, contact, person_id) to (record_id, person_id): every contact resolves, and all to one person."""
    each = contacts.groupBy("record_id", "contact").agg(F.countDistinct("person_id").alias("n"), F.min("person_id").alias("p"))
    whole = each.groupBy("record_id").agg(F.min(F.col("n") == 1).alias("ok"), F.countDistinct("p").alias("n"), F.min("p").alias("person_id"))
    return whole.where("ok and n = 1").select("record_id", "person_id")


def excluded(records: DataFrame, phones: DataFrame | None = None, emails: DataFrame | None = None, domains: list[str] = ()) -> DataFrame:
    """Records without those of given phones, emails or mail domains with their subdomains."""
    out = records
    if phones is not None:
        out = out.join(phones.select("phone"), "phone", "left_anti")
    if emails is not None:
        out = out.join(emails.select("email"), "email", "left_anti")
    own = F.substring_index(F.lower("email"), "@", -1)
    for d in domains:
        out = out.where(~F.coalesce((own == d) | own.endswith("." + d), F.lit(False)))
    return out
