"""Person reads: list with filters, sorts and pages, summary, search, facets, entities, reports."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import all_of, contains_ci, edge_active, is_activity, is_live, is_present, order_nulls_last, phone_confidence

#: Filters by name: what they ask of a person row.
FILTERS = {
    "status": lambda v: F.col("status") == v,
    "is_high_value": lambda v: F.col("is_high_value") == v,
    "is_high_risk": lambda v: F.col("is_high_risk") == v,
    "has_phone": lambda v: is_present("preferred_phone", v),
    "has_email": lambda v: is_present("preferred_email", v),
    "has_nric": lambda v: is_present("preferred_nric", v),
    "has_dob": lambda v: is_present("preferred_dob", v),
    "name_contains": lambda v: contains_ci("preferred_full_name", v),
    "email_contains": lambda v: contains_ci("preferred_email", v),
    "phone_contains": lambda v: F.col("preferred_phone").contains(v),
    "birth_year": lambda v: F.substring("preferred_dob", 1, 4) == str(v),
    "birth_month": lambda v: F.substring("preferred_dob", 6, 2) == f"{int(v):02d}",
    "birth_day": lambda v: F.substring("preferred_dob", 9, 2) == f"{int(v):02d}",
    "completeness_min": lambda v: F.col("completeness") >= v,
    "completeness_max": lambda v: F.col("completeness") <= v,
}
SORTS = {"preferred_full_name", "preferred_phone", "preferred_email", "preferred_dob", "preferred_nric", "created_at", "completeness", "person_id"}


def filtered(persons: DataFrame, **filters) -> DataFrame:
    """Only filters that are given enter the plan."""
    return persons.where(all_of([FILTERS[k](v) for k, v in filters.items() if v is not None]))


def with_flag(persons: DataFrame, holders: DataFrame, wanted: bool | None) -> DataFrame:
    """Existence filter: persons that have (or have not) a row in holders (person_id)."""
    if wanted is None:
        return persons
    return persons.join(holders.select("person_id").distinct(), "person_id", "left_semi" if wanted else "left_anti")


def with_keys(persons: DataFrame, keyed: DataFrame, keys: list, mode: str = "or") -> DataFrame:
    """Persons that hold any ('or') or every ('and') of some keys in keyed (person_id, key)."""
    if not keys:
        return persons
    held = keyed.where(F.col("key").isin(*keys)).groupBy("person_id").agg(F.countDistinct("key").alias("n"))
    return persons.join(held.where(F.col("n") >= (len(set(keys)) if mode == "and" else 1)), "person_id", "left_semi")


def live_links(records: DataFrame) -> DataFrame:
    """Records that readers see: live, no stage history, with an active link."""
    return records.where(is_live() & is_activity() & edge_active("link_active"))


def owner_entity(records: DataFrame, systems: DataFrame) -> DataFrame:
    """Records with entity_key: their own owner, else the one that operates their source. systems is one row per source, so its join
    is left to Spark, which broadcasts by measured size."""
    named = systems.select("source_key", F.col("entity_key").alias("source_entity"))
    return records.join(named, "source_key", "left").withColumn("entity_key", F.coalesce("owner_entity_key", "source_entity")).drop("source_entity")


def metrics(page: DataFrame, records: DataFrame, systems: DataFrame, identified_by: DataFrame, orders: DataFrame, connections: DataFrame) -> DataFrame:
    """The metrics of a page of persons. Every input is cut to the page by a semi join before it is grouped."""
    own = page.select("person_id")
    on_page = lambda df: df.join(own, "person_id", "left_semi")
    seen = on_page(live_links(records))
    counts = [
        seen.groupBy("person_id").agg(F.count("*").alias("source_record_count")),
        owner_entity(seen, systems).groupBy("person_id").agg(F.countDistinct("entity_key").alias("entity_count")),
        on_page(identified_by.where(edge_active())).groupBy("person_id").agg(F.count("*").alias("identifier_count")),
        on_page(orders).groupBy("person_id").agg(F.count("*").alias("order_count")),
        on_page(connections),
    ]
    phones = identified_by.where(edge_active() & (F.col("identifier_type") == "phone"))
    best = page.select("person_id", F.col("preferred_phone").alias("normalized_value")).join(phones, ["person_id", "normalized_value"]).groupBy("person_id").agg(F.max(phone_confidence()).alias("phone_confidence"))
    out = page
    for c in counts:
        out = out.join(c, "person_id", "left")
    names = ["source_record_count", "entity_count", "identifier_count", "order_count", "connection_count"]
    return out.join(best, "person_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def page_of(rows: DataFrame, sort: str, descending: bool, skip: int, limit: int, allowed: set[str] = SORTS) -> DataFrame:
    """One page with a stable order: an allowed key, null as the largest, ties by person_id."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    return rows.orderBy(order_nulls_last(sort, descending), F.col("person_id").asc()).offset(skip).limit(limit)


def look_ahead(rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """A page and whether there is more, from limit + 1 rows."""
    got = rows.limit(limit + 1)
    return got.limit(limit), got.count() > limit


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).decode()


def decode_cursor(cursor: str | None) -> int:
    if not cursor:
        return 0
    try:
        offset = int(base64.urlsafe_b64decode(cursor.encode()).decode())
    except ValueError as e:
        raise ValueError("bad cursor") from e
    if offset < 0:
        raise ValueError("bad cursor")
    return offset


def summary(persons: DataFrame) -> DataFrame:
    return persons.where("status <> 'merged'").agg(
        F.count("*").alias("all_profiles_count"), F.count_if(F.col("is_high_risk")).alias("high_risk_count"), F.count_if(F.col("is_high_value")).alias("high_value_count"),
        F.count_if(F.col("preferred_phone").isNull() & F.col("preferred_email").isNull()).alias("no_contact_count"),
    )


def tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def name_search(persons: DataFrame, column: str, query: str) -> DataFrame:
    """Persons whose name shares a word with the query: score is shared words over all words of both."""
    own, asked = tokens(F.col(column)), tokens(F.lit(query))
    return persons.withColumn("score", F.size(F.array_intersect(own, asked)) / F.size(F.array_union(own, asked))).where("score > 0")


def facets(records: DataFrame, systems: DataFrame) -> DataFrame:
    """Live records by source and owning entity."""
    return owner_entity(live_links(records), systems).groupBy("source_key", "entity_key").agg(F.count("*").alias("records"), F.countDistinct("person_id").alias("persons"))


def entity_list(entities: DataFrame, records: DataFrame, systems: DataFrame) -> DataFrame:
    """Entities with their live records and persons; those without have 0."""
    found = owner_entity(live_links(records), systems).groupBy("entity_key").agg(F.count("*").alias("record_count"), F.countDistinct("person_id").alias("person_count"))
    return entities.join(found, "entity_key", "left").na.fill(0, ["record_count", "person_count"])


def persons_by_status(persons: DataFrame) -> DataFrame:
    return persons.groupBy("status").agg(F.count("*").alias("person_count"))


def shared_identifiers(identified_by: DataFrame, persons: DataFrame, kind: str = "phone", least: int = 2, sample: int = 5) -> DataFrame:
    """Identifiers of so many active persons: value, shared_count and the first few person ids in order."""
    active = persons.where("status = 'active'").select("person_id")
    edges = identified_by.where((F.col("identifier_type") == kind) & edge_active()).select("normalized_value", "person_id").distinct().join(active, "person_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("normalized_value").orderBy("person_id"))
    ranked = edges.withColumn("at", first)
    out = ranked.groupBy("normalized_value").agg(F.count("*").alias("shared_count"), F.sort_array(F.collect_list(F.when(F.col("at") <= sample, F.col("person_id")))).alias("sample_ids"))
    return out.where(F.col("shared_count") >= least)


def top_buyers(persons: DataFrame, orders: DataFrame, limit: int) -> DataFrame:
    """Active persons by number of orders, ties by person_id: orders are summed first, so the join moves one row per buyer."""
    bought = orders.groupBy("person_id").agg(F.count("*").alias("order_count"), F.round(F.sum("total_amount"), 2).alias("total_spend"), F.date_format(F.max("ordered_at"), "yyyy-MM-dd").alias("last_order_date"))
    named = persons.where("status = 'active'").select("person_id", F.col("preferred_full_name").alias("name"))
    return bought.join(named, "person_id").orderBy(F.desc("order_count"), "person_id").limit(limit)


def entity_persons(entity_key: int, persons: DataFrame, records: DataFrame, systems: DataFrame) -> DataFrame:
    """Active persons with a record of one entity: person_id, name, status."""
    own = owner_entity(records.where(edge_active("link_active")), systems).where(F.col("entity_key") == entity_key).select("person_id").distinct()
    return persons.where("status = 'active'").join(own, "person_id", "left_semi").select("person_id", F.col("preferred_full_name").alias("name"), "status")


def entity_person_summary(chosen: DataFrame, records: DataFrame, shared: DataFrame) -> DataFrame:
    """Persons of an entity with the number of their records, and of persons that share an identifier or address (shared: pairs of theirs)."""
    sources = records.where(edge_active("link_active")).join(chosen.select("person_id"), "person_id", "left_semi").groupBy("person_id").agg(F.countDistinct("record_id").alias("source_count"))
    linked = shared.groupBy("person_id").agg(F.countDistinct("other_id").alias("connection_count"))
    return chosen.join(sources, "person_id", "left").join(linked, "person_id", "left").na.fill(0, ["source_count", "connection_count"])


def birthday_recipients(persons: DataFrame, month_day: str) -> DataFrame:
    """Active persons born on MM-DD with a phone: one for each phone, the smallest person_id."""
    born = persons.where((F.col("status") == "active") & (F.substring("preferred_dob", 6, 5) == month_day) & F.col("preferred_phone").isNotNull())
    return born.groupBy("preferred_phone").agg(F.min("person_id").alias("person_id"))


def identifier_provenance(identified_by: DataFrame) -> DataFrame:
    """One row per person and identifier: sources in order, whether any confirms it, newest confirmation."""
    return identified_by.where(edge_active()).groupBy("person_id", "identifier_type", "normalized_value").agg(
        F.sort_array(F.collect_set("source_key")).alias("sources"), F.bool_or("is_verified").alias("is_verified"), F.max("confirmed_at").alias("confirmed_at")
    )


def timeline(records: DataFrame) -> DataFrame:
    """What readers see of a person's records, newest first: rank runs from 1."""
    order = Window.partitionBy("person_id").orderBy(F.desc("observed_at"), F.desc("record_id"))
    return live_links(records).select("person_id", "record_id", "record_type", F.row_number().over(order).alias("rank"))


def stored_report(spark, text: str, views: dict[str, DataFrame], kinds: dict[str, str], given: dict[str, str]) -> DataFrame:
    """A stored query with typed parameters. Only a single SELECT is allowed; parameters are bound, never pasted."""
    if not text.lstrip().upper().startswith(("SELECT", "WITH")) or ";" in text.rstrip().rstrip(";"):
        raise ValueError("a report is one SELECT")
    cast = {"integer": int, "float": float, "string": str, "boolean": lambda v: {"true": True, "false": False}[str(v).lower()]}
    return spark.sql(text, args={k: cast[kinds[k]](v) for k, v in given.items()}, **views)
