"""Orders, products, vehicles and their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.facts import json_kind
from ..functions.normalize import normalize_lta_tag, normalize_serial
from ..functions.predicates import edge_active
from ..staging import cut
from .connections import components

#: What an observation is known by.
IDENTITY = ["lta_tag", "serial_number", "product_sku"]


def sales_history(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order: its lines as a list in line order, each with product and total."""
    item = F.struct("line_no", F.col("display_name").alias("product"), "quantity", "line_total")
    detail = lines.join(products.select("product_id", "display_name"), "product_id", "left").groupBy("order_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return orders.join(detail, "order_id", "left").select("person_id", "order_id", "status", "total_amount", "items")


def lifetime_value(orders: DataFrame) -> DataFrame:
    return orders.groupBy("person_id").agg(F.count("*").alias("order_count"), F.coalesce(F.sum("total_amount"), F.lit(0.0)).alias("lifetime_value"))


def envelope_error(payload: Column) -> Column:
    """The first fault of a sales envelope (JSON text), or null: its order object and id, its list of lines, and each line's id, product and product id."""
    v = F.try_parse_json(payload)
    at = lambda x, path: F.try_variant_get(x, path, "variant")
    is_ = lambda x, kind: F.coalesce(json_kind(x) == kind, F.lit(False))
    text = lambda x: is_(x, "string") & (F.trim(F.try_variant_get(x, "$", "string")) != "")
    lines = at(v, "$.line_items")
    given = ~(lines.isNull() | is_(lines, "null"))
    fault = lambda x: (
        F.when(~is_(x, "object"), "line_not_object").when(~text(at(x, "$.source_line_item_id")), "line_id_missing")
        .when(~is_(at(x, "$.product"), "object"), "product_missing").when(~text(at(x, "$.product.source_product_id")), "product_id_missing")
    )
    faults = F.filter(F.transform(F.try_variant_get(lines, "$", "array<variant>"), fault), lambda x: x.isNotNull())
    return (
        F.when(~is_(at(v, "$.order"), "object"), "order_missing").when(~text(at(v, "$.order.source_order_id")), "order_id_missing")
        .when(given & ~is_(lines, "array"), "lines_not_list").otherwise(F.get(faults, F.lit(0)))
    )


def parked(facts: DataFrame, customers: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Facts whose customer is known exactly once, with person_id, and the rest, which wait. customers (key, person_id)."""
    unique = customers.groupBy(key).agg(F.countDistinct("person_id").alias("n"), F.min("person_id").alias("person_id")).where("n = 1").drop("n")
    return facts.join(unique, key), facts.join(unique, key, "left_anti")


def replaced_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines after an update: an order that comes again replaces all of its lines."""
    return old.join(new.select("order_id").distinct(), "order_id", "left_anti").unionByName(new.select(old.columns))


def non_vehicle_lines(lines: DataFrame, products: DataFrame, vehicle_categories: list[str]) -> DataFrame:
    """Per order, the lines outside the vehicle categories as JSON in line order."""
    other = lines.join(products.where(~F.col("category").isin(*vehicle_categories)).select("product_id", "display_name"), "product_id")
    return other.groupBy("order_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("line_no", "display_name")))).alias("lines_json"), F.count("*").alias("n_lines"))


def without(rows: DataFrame, excluded: DataFrame, key: str, drop_null: bool = False) -> DataFrame:
    """Rows but those of excluded keys (sales to staff, say). A null key stays, unless drop_null, as NOT IN would have it."""
    kept = rows.join(excluded.select(key).distinct(), key, "left_anti")
    return kept.where(F.col(key).isNotNull()) if drop_null else kept


def clean_observations(observations: DataFrame) -> DataFrame:
    """Vehicle observations with normalised tag and serial; those without a product or any identifier are dropped."""
    both = F.struct(normalize_lta_tag(F.col("lta_tag")).alias("lta_tag"), normalize_serial(F.col("serial_number")).alias("serial_number"))
    # a generator of one row: a filter over its columns is not worked out a second time below it
    out = observations.select(*(c for c in observations.columns if c not in ("lta_tag", "serial_number")), F.inline(F.array(both))).select(*observations.columns)
    return out.where((F.trim("product_sku") != "") & F.coalesce("lta_tag", "serial_number").isNotNull())


def vehicle_identity(observations: DataFrame) -> DataFrame:
    """Clean observations with vehicle_id: one tag is one vehicle; serials join within source and product.

    Tags and serials are nodes, each observation that has both is an edge; a component is a vehicle. It conflicts where it holds
    more than one tag, which then needs review. vehicle_id is the smallest node of the component.
    """
    tag = F.concat(F.lit("t:"), "lta_tag")
    serial = F.concat_ws("|", F.lit("s:"), "source_key", "product_sku", "serial_number")
    node = cut(observations, "observations").withColumns({"tag_node": F.when(F.col("lta_tag").isNotNull(), tag), "serial_node": F.when(F.col("serial_number").isNotNull(), serial)})
    edges = node.where("tag_node is not null and serial_node is not null").select(F.col("serial_node").alias("a"), F.col("tag_node").alias("b")).distinct()
    found = components(edges)
    # tags of a component are nodes of it, and an observation outside of all has one tag at most, so components are counted and not observations
    tags = found.groupBy("component").agg((F.count_if(F.col("node").startswith("t:")) > 1).alias("identity_conflict"))
    named = node.withColumn("node", F.coalesce("serial_node", "tag_node")).join(found.join(tags, "component"), "node", "left")
    return named.select(*observations.columns, F.coalesce("component", "node").alias("vehicle_id"), F.coalesce("identity_conflict", F.lit(False)).alias("identity_conflict"))


def owner_conflicts(observations: DataFrame) -> DataFrame:
    """Tags with more than one owner: lta_tag, owners."""
    return observations.where("lta_tag is not null and person_id is not null").groupBy("lta_tag").agg(F.countDistinct("person_id").alias("owners")).where("owners > 1")


def tag_or_serial(observations: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ask_id, lta_tag, serial_number, product_sku) to (ask_id, observation_id): by tag, or by serial and product.

    Two equal joins and a union in place of a join with OR, which would compare all with all.
    """
    by_tag = asked.where("lta_tag is not null").select("ask_id", "lta_tag").join(observations.select("observation_id", "lta_tag"), "lta_tag")
    by_serial = asked.where("serial_number is not null").select("ask_id", "serial_number", "product_sku").join(observations.select("observation_id", "serial_number", "product_sku"), ["serial_number", "product_sku"])
    return by_tag.select("ask_id", "observation_id").union(by_serial.select("ask_id", "observation_id")).distinct()


def _by_id(rows: DataFrame, key: str) -> DataFrame:
    """One row an id: tag, serial and product of it, and whether its rows differ in them (mixed)."""
    each = rows.groupBy(key).agg(F.min(F.struct(*IDENTITY)).alias("low"), F.max(F.struct(*IDENTITY)).alias("high"))
    return cut(each.select(key, "low.*", (~F.col("low").eqNullSafe(F.col("high"))).alias("mixed")), "vehicle-ids")


def tag_or_serial_counts(observations: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """How many observations tag_or_serial finds for each ask that finds any: ask_id, found. Without asked, each observation asks for itself.

    Those of the tag and those of the serial less those of both are counted as groups, and no pairs are made. Only ids whose rows differ in tag, serial or product
    are paired, as they may be met in several ways.
    """
    known = _by_id(observations, "observation_id")
    asks = known.withColumnRenamed("observation_id", "ask_id") if asked is None else _by_id(asked, "ask_id")
    one, serial = known.where("not mixed"), ["serial_number", "product_sku"]
    of = lambda keys, name: one.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(name))
    met = asks.where("not mixed").join(of(["lta_tag"], "by_tag"), "lta_tag", "left").join(of(serial, "by_serial"), serial, "left").join(of(IDENTITY, "by_both"), IDENTITY, "left").na.fill(0, ["by_tag", "by_serial", "by_both"])
    found = met.select("ask_id", (F.col("by_tag") + F.col("by_serial") - F.col("by_both")).alias("found")).where("found > 0")
    if not (known.where("mixed").take(1) or asks.where("mixed").take(1)):
        return found
    every = observations.select(F.col("observation_id").alias("ask_id"), *IDENTITY) if asked is None else asked
    mixed = lambda rows, ids, key: rows.join(ids.where("mixed").select(F.col(key).alias("own")), F.col(key).eqNullSafe(F.col("own")), "left_semi")
    single = asks.where("not mixed").select("ask_id", *IDENTITY)
    pairs = tag_or_serial(observations, mixed(every, asks, "ask_id")).union(tag_or_serial(mixed(observations, known, "observation_id"), single))
    return found.union(pairs.groupBy("ask_id").agg(F.count("*").alias("found"))).groupBy("ask_id").agg(F.sum("found").alias("found"))


def vehicle_candidates(sales: DataFrame, contacts: DataFrame, holders: DataFrame, persons: DataFrame, edges: DataFrame, decided: DataFrame) -> DataFrame:
    """Who a waiting sale may belong to: sale_id, person_id, vehicle_id, rel_type, is_active, conflict_flag, last_confirmed_at, channels, nric_blocked.

    sales (sale_id, vehicle_id, nric), contacts (sale_id, identifier_type, normalized_value), holders (person_id, vehicle_id, rel_type, ...). A candidate is an active person who
    holds a vehicle of the sale, shares an email or phone with its customer, and was not decided on before (sale_id, person_id).
    """
    active = persons.where("status = 'active'").select("person_id")
    met = sales.join(holders, "vehicle_id").join(active, "person_id", "left_semi").join(decided, ["sale_id", "person_id"], "left_anti")
    own = edges.select("person_id", "identifier_type", "normalized_value").distinct()
    channels = contacts.join(own, ["identifier_type", "normalized_value"]).groupBy("sale_id", "person_id").agg(F.array_sort(F.collect_set("identifier_type")).alias("channels"))
    ids = own.where("identifier_type = 'nric'").groupBy("person_id").agg(F.collect_set("normalized_value").alias("held"))
    blocked = F.coalesce(F.col("nric") != "", F.lit(False)) & F.coalesce(F.exists("held", lambda x: x != F.col("nric")), F.lit(False))
    return met.join(channels, ["sale_id", "person_id"]).join(ids, "person_id", "left").withColumn("nric_blocked", blocked).drop("nric", "held")


def vehicle_match(candidates: DataFrame) -> DataFrame:
    """One decision for each sale with candidates: sale_id, decision, confidence, person_id, additional (others that are linked, not merged).

    Active owners without conflict come first, then the newest confirmation, then the smaller person. A best candidate whose government id
    disagrees is left out; if none remains, there is no match. One person is merged at 0.90, several are reviewed at 0.70.
    """
    best_tier = (F.col("rel_type") == "OWNS_VEHICLE") & F.coalesce("is_active", F.lit(False)) & ~F.coalesce("conflict_flag", F.lit(False))
    key = F.struct((~best_tier).alias("t"), F.coalesce(-F.unix_micros("last_confirmed_at"), F.lit((1 << 62))).alias("c"), F.col("person_id").alias("p"))
    each = candidates.groupBy("sale_id", "person_id").agg(F.min(key).alias("key"), F.bool_or("nric_blocked").alias("blocked"))
    rank = F.row_number().over(Window.partitionBy("sale_id").orderBy("key"))
    ranked = each.withColumn("rank", rank)
    out = ranked.groupBy("sale_id").agg(
        F.count("*").alias("n"), F.bool_or((F.col("rank") == 1) & F.col("blocked")).alias("veto"), F.min(F.when(F.col("rank") == 1, F.col("person_id"))).alias("first"),
        F.min(F.when(F.col("rank") == 2, F.col("person_id"))).alias("second"), F.array_sort(F.collect_list(F.when(~F.col("blocked"), F.col("person_id")))).alias("open"),
    )
    person = F.when(F.col("veto") & (F.col("n") > 1), F.col("second")).otherwise(F.col("first"))
    left = F.col("n") - F.col("veto").cast("int")
    out = out.select("sale_id", F.when(left == 0, "no_match").when(left == 1, "merge").otherwise("review").alias("decision"), F.when(left == 0, 0.0).when(left == 1, 0.9).otherwise(0.7).alias("confidence"), person.alias("person_id"), "open")
    return out.withColumn("additional", F.when(F.col("decision") == "review", F.array_remove("open", F.col("person_id"))).otherwise(F.array().cast("array<bigint>"))).drop("open")


def vehicles_per_person(owns: DataFrame, bought: DataFrame) -> DataFrame:
    """One row per person and vehicle; owning beats buying. owns and bought (person_id, vehicle_id, is_active)."""
    both = owns.where(edge_active()).select("person_id", "vehicle_id", F.lit(0).alias("rank")).union(bought.where(edge_active()).select("person_id", "vehicle_id", F.lit(1)))
    return both.groupBy("person_id", "vehicle_id").agg(F.when(F.min("rank") == 0, "owns").otherwise("bought").alias("relation"))


def loyalty_balance(records: DataFrame) -> DataFrame:
    """The newest record with a loyalty block for each person and source: its points, whether it is off, and what was spent.

    records (person_id, source_key, record_id, observed_at, payload): fields that are not of their type are null.
    """
    block = F.try_variant_get(F.try_parse_json("payload"), "$.loyalty", "variant")
    rows = records.withColumn("b", block).where(json_kind(F.col("b")) == "object")
    field = lambda name, kind, *kinds: F.when(json_kind(F.try_variant_get("b", f"$.{name}", "variant")).isin(*kinds), F.try_variant_get("b", f"$.{name}", kind)).alias(name)
    fields = [
        field("points", "bigint", "integer"), field("disable_loyalty", "boolean", "boolean"),
        field("current_spend_for_points", "double", "integer", "number"), field("current_sales_for_discount", "double", "integer", "number"),
    ]
    newest = rows.select("person_id", "source_key", "observed_at", "record_id", *fields)
    names = ["points", "disable_loyalty", "current_spend_for_points", "current_sales_for_discount", "observed_at"]
    return newest.groupBy("person_id", "source_key").agg(F.max_by(F.struct(*names), F.struct("observed_at", "record_id")).alias("l")).select("person_id", "source_key", "l.*")


def top_per_parent(rows: DataFrame, parent: str, order: list, n: int) -> DataFrame:
    """The first n rows of each parent, with omitted: how many were left out."""
    w = Window.partitionBy(parent)
    return rows.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)}).where(F.col("rank") <= n).withColumn("omitted", F.greatest(F.col("total") - n, F.lit(0))).drop("total")


def profile_snapshot(person_ids: DataFrame, sources: DataFrame, orders: DataFrame, relations: DataFrame) -> DataFrame:
    """What an analysis of a person reads, as one table: up to 20 sources, 8 orders, 20 relationships, with what each leaves out."""
    only = lambda df: df.join(person_ids, "person_id", "left_semi")
    branch = lambda df, kind, label: df.select("person_id", F.lit(kind).alias("row_kind"), "rank", label.cast("string").alias("label"), "omitted")
    a = branch(top_per_parent(only(sources), "person_id", [F.desc("observed_at"), "record_id"], 20), "source", F.col("record_id"))
    b = branch(top_per_parent(only(orders), "person_id", [F.desc("ordered_at"), "order_id"], 8), "order", F.col("order_id"))
    c = branch(top_per_parent(only(relations), "person_id", ["other_id"], 20), "relation", F.col("other_id"))
    return a.unionByName(b).unionByName(c)
