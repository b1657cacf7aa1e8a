"""The person list and the person page in full: every filter, exact totals, sorts by column or metric, and the metrics of a page.

A page is chosen from persons alone, written (a few dozen rows), and only then joined to anything else, so every metric reads its table
once and moves what belongs to the page. A sort by a metric needs that metric for all persons that the filters leave; it is
one grouping of its table, and the two that count other persons go by classes, so things that very many persons hold make no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import all_of, contains_ci, edge_active, is_live, order_nulls_last, phone_confidence
from ..staging import cut
from . import connections as cx
from . import crm, hot
from . import persons as ps

#: Filters over the columns of a person.
COLUMNS = {k: f for k, f in ps.FILTERS.items() if not k.startswith("completeness")} | {
    "has_any_contact": lambda v: (F.col("preferred_email").isNotNull() | F.col("preferred_phone").isNotNull()) == F.lit(v),
    "updated_after": lambda v: F.col("updated_at") >= F.lit(v),
    "updated_before": lambda v: F.col("updated_at") <= F.lit(v),
    "dob_from": lambda v: F.col("preferred_dob") >= v,
    "dob_to": lambda v: F.col("preferred_dob") <= v,
    "has_address": lambda v: F.col("preferred_address_id").isNotNull() == F.lit(v),
    "crm_deal_count_min": lambda v: F.col("crm_deal_count") >= v,
    "crm_deal_count_max": lambda v: F.col("crm_deal_count") <= v,
}
#: Filters over one address where a person lives: all of them must hold for the same one.
ADDRESS = {"addr_street": "street_name", "addr_unit": "unit_number", "addr_city": "city", "addr_postal": "postal_code", "addr_country": "country_code"}
FLAGS = ("has_bankruptcy_case", "has_possible_match", "has_system_match", "has_any_match")
KEYS = ("entity_keys", "source_keys", "source_record_type")
#: Columns that a list may be sorted by. Lists by the second kind hold only persons that have a value.
SORTS = {"preferred_full_name", "preferred_phone", "preferred_email", "preferred_dob", "preferred_nric", "updated_at"}
SORTS_OF_VALUES = {"completeness", "crm_deal_count"}


@dataclass(frozen=True)
class Tables:
    """What a list reads. persons: one row each, with updated_at, crm_deal_count and preferred_address_id; systems: one row a source."""

    persons: DataFrame
    records: DataFrame
    systems: DataFrame
    identified_by: DataFrame
    lives_at: DataFrame
    addresses: DataFrame
    knows: DataFrame
    orders: DataFrame
    bankruptcies: DataFrame
    decisions: DataFrame
    cases: DataFrame


def identifier_things(t: Tables) -> DataFrame:
    """(person_id, kind, thing, is_active): identifiers as things that persons hold."""
    return t.identified_by.select("person_id", F.col("identifier_type").alias("kind"), F.col("normalized_value").alias("thing"), "is_active")


def connection_things(t: Tables) -> DataFrame:
    """Addresses, and statements that one person knows another, as things: a statement is held by its two ends."""
    homes = t.lives_at.select("person_id", F.lit("address").alias("kind"), F.col("address_id").cast("string").alias("thing"), "is_active")
    said = t.knows.select(F.concat_ws("/", F.col("src").cast("string"), F.col("dst").cast("string")).alias("thing"), F.explode(F.array("src", "dst")).alias("person_id"), "is_active")
    return homes.unionByName(said.withColumn("kind", F.lit("knows")))


def _others(things: DataFrame, t: Tables, only: DataFrame | None) -> DataFrame:
    return hot.others_counted(things, ["kind", "thing"], t.persons) if only is None else hot.others_of(only, things, ["kind", "thing"], t.persons)


def _of(df: DataFrame, only: DataFrame | None) -> DataFrame:
    return df if only is None else df.join(only.select("person_id"), "person_id", "left_semi")


def _counted(df: DataFrame, only: DataFrame | None) -> DataFrame:
    return _of(df, only).groupBy("person_id").agg(F.count("*").alias("value"))


def system_matches(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """(person_id, decision_id): open decisions about a pair of persons; decisions about a record are not counted."""
    ends = lambda side: t.persons.select(F.col("person_id").alias(side))
    pairs = t.decisions.join(t.cases.where("queue_state not in ('resolved', 'cancelled')").select("decision_id"), "decision_id", "left_semi")
    pairs = pairs.select("decision_id", "left_id", "right_id").join(ends("left_id"), "left_id", "left_semi").join(ends("right_id"), "right_id", "left_semi")
    return _of(pairs.select("decision_id", F.explode(F.array("left_id", "right_id")).alias("person_id")), only).distinct()


def entities(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """(person_id, entity_key, records): live records that readers see, by the entity that owns them."""
    owned = ps.owner_entity(_of(ps.live_links(t.records), only), t.systems).where("entity_key is not null")
    return owned.groupBy("person_id", "entity_key").agg(F.countDistinct("record_id").alias("records"))


def phone_confidences(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """How far the preferred phone is to be trusted: the best of its active edges, null where none has a known flag."""
    own = _of(t.persons, only).select("person_id", F.col("preferred_phone").alias("normalized_value"))
    edges = t.identified_by.where(edge_active() & (F.col("identifier_type") == "phone"))
    return edges.join(own, ["person_id", "normalized_value"]).groupBy("person_id").agg(F.max(phone_confidence()).alias("value"))


#: Metrics by name: (person_id, value) for the persons in only, or for all. A person without a row has 0, or null for the last.
METRICS = {
    "source_record_count": lambda t, only=None: _counted(ps.live_links(t.records), only),
    "entity_count": lambda t, only=None: _counted(entities(t, only), None),
    "identifier_count": lambda t, only=None: _counted(t.identified_by.where(edge_active()), only),
    "connection_count": lambda t, only=None: _others(connection_things(t), t, only).withColumnRenamed("others", "value"),
    "possible_match_count": lambda t, only=None: _others(identifier_things(t), t, only).withColumnRenamed("others", "value"),
    "system_match_count": lambda t, only=None: _counted(system_matches(t, only), None),
    "order_count": lambda t, only=None: _counted(t.orders, only),
    "bankruptcy_case_count": lambda t, only=None: _counted(t.bankruptcies.where(edge_active()), only),
    "phone_confidence": phone_confidences,
}


def possible_matches(t: Tables) -> DataFrame:
    """Persons who share an active identifier with another who is not merged. Holders are counted by thing, so there are no pairs."""
    held = identifier_things(t).where(edge_active()).select("person_id", "kind", "thing").distinct()
    held = held.join(t.persons.select("person_id", (F.col("status") != "merged").cast("int").alias("other")), "person_id", "left").na.fill(0, ["other"])
    sizes = held.groupBy("kind", "thing").agg(F.sum("other").alias("others"))
    return held.join(sizes, ["kind", "thing"]).where("others > other").select("person_id").distinct()


def matching(t: Tables, entity_mode: str = "or", source_mode: str = "or", **filters) -> DataFrame:
    """Persons that are not merged and pass every filter given; a filter of None is not given. Unknown filters are refused.

    A text or date filter on a column that is null fails. entity_keys and source_keys take persons with a live record of any key ('or') or
    of every key ('and'); an empty list of keys asks for nothing. Stage history counts there, though not in metrics.
    """
    given = {k: v for k, v in filters.items() if v is not None}
    if unknown := sorted(set(given) - {*COLUMNS, *ADDRESS, *FLAGS, *KEYS}):
        raise ValueError(f"no such filters: {unknown}")
    rows = t.persons.where("status <> 'merged'").where(all_of([f(given[k]) for k, f in COLUMNS.items() if k in given]))
    if where := [contains_ci(column, given[k]) for k, column in ADDRESS.items() if k in given]:
        at = t.addresses.where(all_of(where)).select("address_id")
        rows = rows.join(t.lives_at.where(edge_active()).join(at, "address_id", "left_semi").select("person_id"), "person_id", "left_semi")
    holders = {
        "has_bankruptcy_case": lambda: t.bankruptcies.where(edge_active()).select("person_id"),
        "has_possible_match": lambda: possible_matches(t),
        "has_system_match": lambda: system_matches(t).select("person_id"),
        "has_any_match": lambda: possible_matches(t).union(system_matches(t).select("person_id")),
    }
    for name in FLAGS:
        if name in given:
            rows = ps.with_flag(rows, holders[name](), given[name])
    live = t.records.where(is_live() & edge_active("link_active"))
    if "entity_keys" in given:
        keyed = ps.owner_entity(live, t.systems).select("person_id", F.col("entity_key").alias("key"))
        rows = ps.with_keys(rows, keyed, given["entity_keys"], entity_mode)
    if "source_keys" in given:
        rows = ps.with_keys(rows, live.select("person_id", F.col("source_key").alias("key")), given["source_keys"], source_mode)
    if "source_record_type" in given:
        rows = ps.with_flag(rows, live.where(F.col("record_type") == given["source_record_type"]), True)
    return rows


def listed(t: Tables, sort: str = "completeness", **filters) -> DataFrame:
    """The rows that a list pages through, and that its total counts: those that match and, for some sorts, have a value."""
    rows = matching(t, **filters)
    return rows.where(F.col(sort).isNotNull()) if sort in SORTS_OF_VALUES else rows


def total(t: Tables, sort: str = "completeness", **filters) -> DataFrame:
    return listed(t, sort, **filters).agg(F.count("*").alias("total"))


def _zero(name: str, column: str) -> Column:
    return F.col(column).alias(name) if name == "phone_confidence" else F.coalesce(column, F.lit(0)).alias(name)


def page(t: Tables, sort: str = "completeness", descending: bool = True, skip: int = 0, limit: int = 20, **filters) -> DataFrame:
    """One page in a stable order (ties by person_id), with all metrics, entities and the preferred address.

    sort is a column or a metric. Null sorts as the largest value. Column place, from 1, is the order of the page.
    """
    rows = listed(t, sort, **filters)
    if sort in METRICS:
        by = METRICS[sort](t).select("person_id", F.col("value").alias("sort value"))
        rows = rows.join(by, "person_id", "left").withColumn("sort value", _zero(sort, "sort value"))
    elif sort in SORTS | SORTS_OF_VALUES:
        rows = rows.withColumn("sort value", F.col(sort))
    else:
        raise ValueError(f"cannot sort by {sort}")
    chosen = ps.page_of(rows, "sort value", descending, skip, limit, {"sort value"})
    # the limit has cut the rows to one page, which one task can number
    place = F.row_number().over(Window.orderBy(order_nulls_last("sort value", descending), F.col("person_id").asc())) + skip
    return with_metrics(cut(chosen.select(place.alias("place"), *t.persons.columns), "page"), t)


def with_address(rows: DataFrame, t: Tables) -> DataFrame:
    names = ["unit_number", "street_name", "city", "postal_code", "country_code"]
    return rows.join(t.addresses.select(F.col("address_id").alias("preferred_address_id"), *names), "preferred_address_id", "left")


def with_metrics(rows: DataFrame, t: Tables) -> DataFrame:
    """rows of persons with every metric and entities, a sorted list of (entity_key, records)."""
    own = rows.select("person_id")
    out = with_address(rows, t)
    for name, metric in METRICS.items():
        found = metric(t, own).select("person_id", F.col("value").alias("found"))
        out = out.join(found, "person_id", "left").withColumn(name, _zero(name, "found")).drop("found")
    by_person = entities(t, own).groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("entity_key", "records"))).alias("entities"))
    return out.join(by_person, "person_id", "left")


def details(t: Tables, merges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The page of each person asked for (person_id), or of all: a merged person's is that of whom they became.

    asked_id, the columns of the person, the preferred address, live records, distinct persons met by identifier, address or
    statement, and the sum of orders (0 without any). Ids that are no persons have no row. merges: (absorbed, survivor).
    """
    ids = (t.persons if asked is None else asked).select(F.col("person_id").alias("asked_id")).distinct()
    became = cx.canonical(merges).select(F.col("absorbed").alias("asked_id"), "canonical")
    pairs = ids.join(became, "asked_id", "left").select("asked_id", F.coalesce("canonical", "asked_id").alias("person_id"))
    only = None if asked is None else cut(pairs.select("person_id").distinct(), "asked")
    things = connection_things(t).unionByName(identifier_things(t))
    out = pairs.join(with_address(_of(t.persons, only), t), "person_id")
    spent = _of(t.orders, only).groupBy("person_id").agg(F.sum("total_amount").alias("lifetime_value"))
    for name, found in (("source_record_count", METRICS["source_record_count"](t, only).withColumnRenamed("value", "found")), ("connection_count", _others(things, t, only).withColumnRenamed("others", "found"))):
        out = out.join(found.select("person_id", "found"), "person_id", "left").withColumn(name, _zero(name, "found")).drop("found")
    return out.join(spent, "person_id", "left").na.fill(0.0, ["lifetime_value"])
