"""Persons connected by identifiers, addresses or statements, traversal, lineage and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import edge_active
from ..staging import Scope, cut, joined


def shared_by(edges: DataFrame, key: list[str], persons: DataFrame, active: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (person_id, other_id, key...) of persons with an edge to one thing.

    edges (person_id, key..., is_active): a null flag is active. Merged persons are left out as others. Keys of one person are
    dropped before the self join, so only shared things are paired. only (person_id) names the persons asked for: the things that
    they hold are found first, so a page of persons pairs a page's things and not all of them.
    """
    live = edges.where(edge_active() if active is None else active).select("person_id", *key).distinct()
    if only is None:
        many = live.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
        own = live = live.join(many, key, "left_semi")
    else:
        own = live.join(only.select("person_id"), "person_id", "left_semi")
        live = live.join(own.select(*key).distinct(), key, "left_semi")
    others = live.join(persons.where("status <> 'merged'").select("person_id"), "person_id", "left_semi").withColumnRenamed("person_id", "other_id")
    return own.join(others, key).where("person_id <> other_id").select("person_id", "other_id", *key)


def undirected(edges: DataFrame) -> DataFrame:
    """(person_id, other_id, ...) both ways from (src, dst, ...)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("person_id"), F.col("dst").alias("other_id"), *rest).union(edges.select("dst", "src", *rest))


def known_pairs(knows: DataFrame, persons: DataFrame, only: DataFrame | None = None) -> DataFrame:
    active = undirected(knows.where(edge_active()).select("src", "dst")).where("person_id <> other_id")
    if only is not None:
        active = active.join(only.select("person_id"), "person_id", "left_semi")
    return active.distinct().join(persons.where("status <> 'merged'").select(F.col("person_id").alias("other_id")), "other_id", "left_semi").select("person_id", "other_id")


def all_connections(lives_at: DataFrame, knows: DataFrame, persons: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(person_id, other_id, relations): address and KNOWS, regrouped; relations is a sorted list."""
    homes = shared_by(lives_at, ["address_id"], persons, only=only).select("person_id", "other_id", F.lit("address").alias("kind"))
    both = homes.unionByName(known_pairs(knows, persons, only).withColumn("kind", F.lit("knows")))
    return both.groupBy("person_id", "other_id").agg(F.sort_array(F.collect_set("kind")).alias("relations"))


def connection_counts(identified_by: DataFrame, lives_at: DataFrame, knows: DataFrame, persons: DataFrame, with_identifiers: bool, only: DataFrame | None = None) -> DataFrame:
    """(person_id, connection_count): the list counts addresses and KNOWS; the person page counts identifiers too."""
    pairs = all_connections(lives_at, knows, persons, only).select("person_id", "other_id")
    if with_identifiers:
        pairs = pairs.union(shared_by(identified_by, ["identifier_type", "normalized_value"], persons, only=only).select("person_id", "other_id")).distinct()
    return pairs.groupBy("person_id").agg(F.count("*").alias("connection_count"))


def shared_strength(pairs: DataFrame) -> DataFrame:
    """Pairs with identifier_type to one row per pair: how many shared, and strong if one is a government id."""
    return pairs.groupBy("person_id", "other_id").agg(F.count("*").alias("shared"), F.when(F.bool_or(F.col("identifier_type") == "nric"), "strong").otherwise("weak").alias("strength"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, dead_ends: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Nodes within so many hops of each seed: (seed, node, hop), hop the smallest.

    edges (a, b) are read both ways; seeds (node). Nodes in dead_ends (node) are reached but not left. most keeps that many nodes of
    a seed, nearest first, then by id. Each hop joins the frontier alone, against the edges, and the visited set only grows.
    """
    if not 1 <= hops <= 4:
        raise ValueError("hops must be 1 to 4")
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    visited = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    frontier = visited
    for hop in range(1, hops + 1):
        start = frontier if dead_ends is None or hop == 1 else frontier.join(dead_ends.select("node"), "node", "left_anti")
        reached = start.join(both, start.node == both.a).select("seed", F.col("b").alias("node")).distinct()
        frontier = cut(reached.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        visited = visited.union(frontier.select("seed", "node", "hop"))
    if most is None:
        return visited
    return visited.withColumn("at", F.row_number().over(Window.partitionBy("seed").orderBy("hop", "node"))).where(F.col("at") <= most).drop("at")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (seed, node) of a seed."""
    a = nodes.select("seed", F.col("node").alias("a"))
    b = nodes.select("seed", F.col("node").alias("b"))
    return edges.select("a", "b").join(a, "a").join(b, ["seed", "b"]).select("seed", "a", "b").distinct()


def canonical(links: DataFrame, rounds: int = 40) -> DataFrame:
    """links (absorbed, survivor), one for each absorbed id, to (absorbed, canonical, depth): lineage followed to its end.

    Each round replaces a survivor by its own survivor, so chains halve; it ends when nothing moves.
    """
    now = links.select("absorbed", F.col("survivor").alias("canonical"), F.lit(1).alias("depth"))
    for _ in range(rounds):
        up = now.select(F.col("absorbed").alias("canonical"), F.col("canonical").alias("above"), F.col("depth").alias("more"))
        stepped = cut(now.join(up, "canonical", "left").select("absorbed", F.coalesce("above", "canonical").alias("canonical"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "lineage")
        now = stepped.drop("moved")
        if not stepped.where("moved").take(1):
            return now
    raise RuntimeError("lineage has a cycle")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b), any direction, repeats and loops allowed, to (node, component), the smallest id that is reached.

    Each round every node passes its label to its neighbours and then takes the label of its label, so the number of rounds
    follows the logarithm of the longest path. A round is written, which costs a lost executor one round; those before it are deleted.
    Null ends are left out. Rounds of many edges send nothing through the driver.
    """
    spark = edges.sparkSession
    own = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    with Scope(spark) as whole:
        both = cut(own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        far = joined(both.count())
        now = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
        with Scope(spark) as passed:
            for _ in range(rounds):
                near = both.join(far(now), both.b == now.node).groupBy("a").agg(F.min("component").alias("low"))
                stepped = now.join(far(near), now.node == near.a).select("node", F.least("component", "low").alias("component"), (F.col("low") < F.col("component")).alias("moved"))
                stepped = cut(stepped, "near")
                above = stepped.select(F.col("node").alias("component"), F.col("component").alias("above"))
                jumped = stepped.join(far(above), "component").select("node", F.least("component", "above").alias("component"), (F.col("moved") | (F.col("above") < F.col("component"))).alias("moved"))
                jumped = cut(jumped, "jump")
                passed.drop(keep=1)
                now = jumped.drop("moved")
                if not jumped.where("moved").take(1):
                    break
            else:
                raise RuntimeError("components did not settle")
        whole.drop(keep=1)  # the last round holds the result
    return now


def audit_trail(events: DataFrame, lineage: DataFrame) -> DataFrame:
    """Merge events by the person that they ended in: (person_id, event_id, event_type, absorbed, depth)."""
    return events.join(lineage, "absorbed").select(F.col("canonical").alias("person_id"), "event_id", "event_type", "absorbed", "depth")


def events_feed(events: DataFrame, since) -> DataFrame:
    """Merge events after a moment as feed rows: event_id, kind, person_ids (sorted)."""
    kind = F.when(F.col("event_type") == "unmerge", "person.unmerged").when(F.col("event_type").isin("auto_merge", "manual_merge"), "person.merged").otherwise("person.changed")
    return events.where(F.col("created_at") > since).select("event_id", kind.alias("kind"), F.array_sort(F.array_union(F.array("absorbed"), F.array("survivor"))).alias("person_ids"))


def active_merges(events: DataFrame) -> DataFrame:
    """The links that hold after all events: the newest event of an absorbed person counts, an unmerge drops its link."""
    last = events.groupBy("absorbed").agg(F.max_by(F.struct("event_type", "survivor"), F.struct("created_at", "event_id")).alias("e"))
    return last.where("e.event_type <> 'unmerge'").select("absorbed", F.col("e.survivor").alias("survivor"))


def rewired(edges: DataFrame, lineage: DataFrame, person: str = "person_id") -> DataFrame:
    """Edges moved from absorbed persons to their canonical ones; equal edges become one."""
    moved = edges.join(lineage.select(F.col("absorbed").alias(person), "canonical"), person, "left")
    return moved.withColumn(person, F.coalesce("canonical", person)).drop("canonical").distinct()
