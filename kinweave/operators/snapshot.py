"""What an analysis of a person reads: one table of six kinds of rows, each cut to its newest few, with counts of what is left out.

Every branch is one grouping or one window of its own table. The first few of a person are taken by a row number alone, which Spark cuts
before the shuffle, so a person with very many records sends a few of them; what is left out is counted by a grouping beside it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import edge_active, is_activity

#: How many rows of a kind are kept, and of the products of an order.
KEPT = {"sources": 20, "orders": 8, "order_items": 5, "vehicles": 10, "relationships": 20}
#: Flags from the worst on, tiers from the least trusted on, and the upper ends of the bands of completeness.
WORST_FLAGS = ("source_untrusted", "invalid_format", "placeholder_value", "shared_suspected", "stale", "partial_parse")
WORST_TIERS = ("tier_4", "tier_3", "tier_2", "tier_1")
BANDS = (("low", 0.34), ("medium", 0.67))
HOLDS = {"OWNS_VEHICLE": "owned", "BOUGHT_VEHICLE": "purchased"}

COLUMNS = {
    "internal_id": "string", "parent_internal_id": "string", "completeness_band": "string", "completeness_score": "double", "record_type": "string", "observed_date": "string",
    "quality_flag": "string", "trust_tier": "string", "confidence": "double", "order_date": "string", "total": "double", "currency": "string", "product": "string", "category": "string",
    "manufacturer": "string", "model": "string", "relationship_category": "string", "direction": "string", "event_date": "string", **{f"omitted_{k}": "long" for k in KEPT},
}


@dataclass(frozen=True)
class Tables:
    """persons (person_id, completeness); records with extraction_confidence; facts (person_id, record_id, quality_flag, trust_tier, confidence, is_active);
    orders (order_id, person_id, ordered_at, total_amount, currency, is_active); lines (order_id, product_id); products (product_id, display_name, category);
    vehicles (vehicle_id, product, category, manufacturer, model); holders (person_id, vehicle_id, rel_type, is_active); mentions (record_id, vehicle_id, is_active);
    knows (knows_id, src, dst, relationship_category, last_confirmed_at, is_active)."""

    persons: DataFrame
    records: DataFrame
    facts: DataFrame
    orders: DataFrame
    lines: DataFrame
    products: DataFrame
    vehicles: DataFrame
    holders: DataFrame
    mentions: DataFrame
    knows: DataFrame


def _rows(df: DataFrame, kind: str, **given: Column | str) -> DataFrame:
    """Rows of one kind: columns that are not given are null."""
    return df.select("person_id", F.lit(kind).alias("row_kind"), *((given[c] if isinstance(given.get(c), Column) else F.col(given[c]) if c in given else F.lit(None)).cast(kind_of).alias(c) for c, kind_of in COLUMNS.items()))


def _first(df: DataFrame, parent: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("at", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("at") <= n).drop("at")


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def worst(flags: Column) -> Column:
    """The worst flag of a list; valid only where all are, and null where a flag is unknown and none is bad."""
    out = F.when((F.size(flags) > 0) & F.forall(flags, lambda f: f == "valid"), "valid")
    for flag in reversed(WORST_FLAGS):
        out = F.when(F.array_contains(flags, flag), flag).otherwise(out)
    return out


def least_trusted(tiers: Column) -> Column:
    out = F.lit(None).cast("string")
    for tier in reversed(WORST_TIERS):
        out = F.when(F.array_contains(tiers, tier), tier).otherwise(out)
    return out


def band(score: Column) -> Column:
    out = F.when(score.isNull(), "unknown")
    for name, end in BANDS:
        out = out.when(score < end, name)
    return out.otherwise("high")


def held_vehicles(t: Tables, persons: DataFrame) -> DataFrame:
    """(person_id, vehicle_id, relationship_category): a row for each link that holds a vehicle, and one for each vehicle that live records mention."""
    kind = F.lit("other")
    for rel, name in HOLDS.items():
        kind = F.when(F.col("rel_type") == rel, name).otherwise(kind)
    links = t.holders.where(edge_active()).select("person_id", "vehicle_id", kind.alias("relationship_category"))
    said = live(t.records).select("record_id", "person_id").join(t.mentions.where(edge_active()).select("record_id", "vehicle_id"), "record_id")
    said = said.join(persons, "person_id", "left_semi").select("person_id", "vehicle_id", F.lit("inquired").alias("relationship_category")).distinct()
    return links.join(persons, "person_id", "left_semi").union(said).join(t.vehicles, "vehicle_id")


def live(records: DataFrame) -> DataFrame:
    """A snapshot reads records that are active by state: older ones without a state are left out."""
    return records.where((F.col("lifecycle_status") == "active") & is_activity())


def known(t: Tables, persons: DataFrame) -> DataFrame:
    """(person_id, other_id, direction, ...) for both ends of statements whose other end is an active person; a statement of a person about themselves is one row."""
    edges = t.knows.where(edge_active()).select("knows_id", "src", "dst", "relationship_category", "last_confirmed_at")
    rest = ["knows_id", "relationship_category", "last_confirmed_at"]
    out = edges.select(F.col("src").alias("person_id"), F.col("dst").alias("other_id"), F.lit("outgoing").alias("direction"), *rest)
    back = edges.where("src <> dst").select(F.col("dst").alias("person_id"), F.col("src").alias("other_id"), F.lit("incoming").alias("direction"), *rest)
    active = t.persons.where("status = 'active'").select(F.col("person_id").alias("other_id"))
    return out.union(back).join(persons, "person_id", "left_semi").join(active, "other_id", "left_semi")


def profile_snapshot(t: Tables, asked: DataFrame | None = None) -> DataFrame:
    """person_id, row_kind (profile, counts, source, order, vehicle, relationship) and COLUMNS, for the persons asked for (person_id), or all.

    Each person has one profile row and one row of counts. An order has a row for each of its first products, and one without a product where
    it has none. Nulls sort as the largest value. Persons that are not in persons have no row.
    """
    who = t.persons if asked is None else t.persons.join(asked.select("person_id"), "person_id", "left_semi")
    ids = who.select("person_id").distinct()
    mine = lambda df: df.join(ids, "person_id", "left_semi")
    asc, desc = (lambda c: F.col(c).asc_nulls_last()), (lambda c: F.col(c).desc_nulls_first())

    records = mine(live(t.records))
    sources = _first(records, "person_id", [desc("observed_at"), desc("record_id")], KEPT["sources"])
    facts = t.facts.where(edge_active()).groupBy("person_id", "record_id").agg(
        F.collect_set("quality_flag").alias("flags"), F.collect_set("trust_tier").alias("tiers"), F.min("confidence").alias("least")
    )
    sources = sources.join(facts, ["person_id", "record_id"], "left")

    orders = mine(t.orders.where(edge_active())).dropDuplicates(["person_id", "order_id"])
    named = t.products.select("product_id", F.col("display_name").alias("product"), "category")
    items = t.lines.select("order_id", "product_id").join(named, "product_id").select("order_id", "product", "category").distinct()
    first_orders = _first(orders, "person_id", [desc("ordered_at"), desc("order_id")], KEPT["orders"])
    first_items = _first(items.join(first_orders.select("order_id").distinct(), "order_id", "left_semi"), "order_id", [asc("product"), asc("category")], KEPT["order_items"])
    ordered = first_orders.join(first_items, "order_id", "left")

    vehicles = held_vehicles(t, ids)
    first_vehicles = _first(vehicles, "person_id", [asc(c) for c in ("product", "manufacturer", "model", "relationship_category", "vehicle_id")], KEPT["vehicles"])
    related = known(t, ids)
    first_related = _first(related, "person_id", [desc("last_confirmed_at"), desc("knows_id")], KEPT["relationships"])

    held_items = orders.select("person_id", "order_id").join(items.groupBy("order_id").agg(F.count("*").alias("n")), "order_id").groupBy("person_id").agg(F.sum("n").alias("items"))
    kept_items = first_orders.select("person_id", "order_id").join(first_items.groupBy("order_id").agg(F.count("*").alias("n")), "order_id").groupBy("person_id").agg(F.sum("n").alias("kept"))
    counted = ids
    for name, rows in (("sources", records.select("person_id", "record_id").distinct()), ("orders", orders), ("vehicles", vehicles), ("relationships", related)):
        counted = counted.join(rows.groupBy("person_id").agg(F.count("*").alias(name)), "person_id", "left")
    counted = counted.join(held_items, "person_id", "left").join(kept_items, "person_id", "left").na.fill(0)
    left = {f"omitted_{k}": F.greatest(F.col(k) - n, F.lit(0)) for k, n in KEPT.items() if k != "order_items"}

    branches = [
        _rows(who, "profile", internal_id="person_id", completeness_band=band(F.col("completeness")), completeness_score="completeness"),
        _rows(counted, "counts", internal_id=F.lit("counts"), omitted_order_items=F.col("items") - F.col("kept"), **left),
        _rows(
            sources, "source", internal_id="record_id", record_type="record_type", observed_date=_day("observed_at"), quality_flag=worst(F.col("flags")), trust_tier=least_trusted(F.col("tiers")),
            confidence=F.least("least", "extraction_confidence"),
        ),
        _rows(ordered, "order", internal_id="order_id", order_date=_day("ordered_at"), total="total_amount", currency="currency", product="product", category="category"),
        _rows(first_vehicles, "vehicle", internal_id="vehicle_id", product="product", category="category", manufacturer="manufacturer", model="model", relationship_category="relationship_category"),
        _rows(
            first_related, "relationship", internal_id="knows_id", parent_internal_id="other_id", relationship_category=F.coalesce("relationship_category", F.lit("other")), direction="direction",
            event_date=_day("last_confirmed_at"),
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), branches)
