"""Queries on edges after merges, possible matches, coverage reports and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging
from .catalog import query
from .views import NAME, Views

EDGES = """
    SELECT 'LINKED_TO' AS kind, person_id, CAST(record_id AS STRING) AS target FROM {source_record} WHERE coalesce(link_active, true)
    UNION ALL SELECT 'IDENTIFIED_BY', person_id, identifier_type || ':' || normalized_value FROM {identified_by}
    UNION ALL SELECT 'LIVES_AT', person_id, CAST(address_id AS STRING) FROM {lives_at}
    UNION ALL SELECT 'HAS_FACT', person_id, CAST(record_id AS STRING) || ':' || attribute_name FROM {fact}
    UNION ALL SELECT 'PURCHASED', person_id, CAST(order_id AS STRING) FROM {sales_order}
    UNION ALL SELECT rel_type, person_id, CAST(vehicle_id AS STRING) FROM {vehicle_holder}
    UNION ALL SELECT 'KNOWS_OUT', src, CAST(dst AS STRING) FROM {knows}
    UNION ALL SELECT 'KNOWS_IN', dst, CAST(src AS STRING) FROM {knows}"""
PLAIN_EDGES = NAME.sub(lambda m: m[1], EDGES).replace("AS STRING", "AS VARCHAR")


@query(f"""
    WITH RECURSIVE live AS (SELECT absorbed, arg_max(survivor, row(created_at, event_id)) AS survivor, arg_max(event_type, row(created_at, event_id)) AS last FROM merge_event GROUP BY absorbed),
    up AS (SELECT absorbed, survivor FROM live WHERE last <> 'unmerge' UNION ALL SELECT u.absorbed, l.survivor FROM up u JOIN live l ON l.absorbed = u.survivor AND l.last <> 'unmerge'),
    ends AS (SELECT absorbed, survivor FROM up WHERE survivor NOT IN (SELECT absorbed FROM live WHERE last <> 'unmerge')),
    held AS (SELECT kind, person_id AS origin, coalesce(a.survivor, person_id) AS person_id, CASE WHEN kind LIKE 'KNOWS%' THEN coalesce(CAST(b.survivor AS VARCHAR), target) ELSE target END AS target
      FROM ({PLAIN_EDGES}) e LEFT JOIN ends a ON a.absorbed = e.person_id LEFT JOIN ends b ON e.kind LIKE 'KNOWS%' AND CAST(b.absorbed AS VARCHAR) = e.target)
    SELECT kind, person_id, target, count(DISTINCT origin) AS origins, bool_or(origin <> person_id) AS moved FROM held WHERE kind NOT LIKE 'KNOWS%' OR target <> CAST(person_id AS VARCHAR) GROUP BY kind, person_id, target""")
def edges_after_merges(v: Views):
    """Edges of all nine kinds after merges and their undoing."""
    return merging.edges_after_merges(v.sql(EDGES), v.merge_event)


@query("""
    WITH i AS (SELECT person_id, identifier_type, normalized_value, array_to_string(list_sort(list(DISTINCT source_key)), ',') AS sources FROM identified_by WHERE coalesce(is_active, true) GROUP BY ALL)
    SELECT a.person_id, b.person_id AS candidate_id, a.identifier_type, a.normalized_value, a.sources AS own_sources, b.sources AS candidate_sources
    FROM i a JOIN person p ON p.person_id = a.person_id AND p.is_high_value JOIN i b USING (identifier_type, normalized_value) JOIN person q ON q.person_id = b.person_id AND q.status <> 'merged' WHERE a.person_id <> b.person_id""")
def possible_match_detail(v: Views):
    """What persons of high value share with others, and which sources say so."""
    found = merging.possible_matches(v.identified_by, v.person, v.person.where("is_high_value").select("person_id"))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("own_sources", "candidate_sources")})


RECORDS = """
    SELECT record_id, source_key, record_type, source_record_id, lifecycle_status, owner_entity_key AS entity_key, history_family, record_id % 9 AS version, CASE WHEN record_id % 27 <> 0 THEN record_id % 50 END AS observed_at,
      CASE WHEN record_id % 41 <> 0 THEN record_id % 60 END AS ingested_at FROM {source_record}"""
PLAIN_RECORDS = NAME.sub(lambda m: m[1], RECORDS)


@query(f"""
    SELECT s.source_key, coalesce(entity_key, -1) AS entity_key, coalesce(record_type, '') AS record_type, count(record_id) AS records, count(*) FILTER (record_id IS NOT NULL AND observed_at IS NULL) AS missing_observed_at,
      count(*) FILTER (record_id IS NOT NULL AND ingested_at IS NULL) AS missing_ingested_at, count(*) FILTER (record_id IS NOT NULL AND coalesce(lifecycle_status, 'active') = 'active') AS active, count(*) FILTER (lifecycle_status = 'superseded') AS superseded
    FROM (SELECT source_key FROM source_system) s LEFT JOIN (SELECT * FROM ({PLAIN_RECORDS}) WHERE ingested_at IS NULL OR ingested_at <= 45) r USING (source_key) GROUP BY 1, 2, 3""")
def discovery_source_coverage(v: Views):
    return merging.source_coverage(v.sql(RECORDS), v.source_system, F.lit(45))


@query(f"""
    WITH n AS (SELECT source_key, record_type, source_record_id, count(*) AS versions, arg_max(coalesce(lifecycle_status, 'active'), row(version, record_id)) AS status FROM ({PLAIN_RECORDS})
      WHERE record_type IN ('conversation', 'call', 'crm_history') AND coalesce(history_family, 'activity') = 'activity' AND ingested_at <= 45 GROUP BY 1, 2, 3)
    SELECT source_key, record_type, count(*) AS interactions, CAST(sum(versions) AS BIGINT) AS versions, count(*) FILTER (status = 'active') AS active FROM n GROUP BY 1, 2""")
def discovery_interactions(v: Views):
    return merging.interaction_coverage(v.sql(RECORDS), F.lit(45))


@query("""
    WITH o AS (SELECT person_id, count(*) AS orders, list_sort(list(DISTINCT status)) AS states, max(priority) AS priority FROM sales_order GROUP BY person_id)
    SELECT person_id, 'sha256:' || sha256('{"orders":' || coalesce(orders, 0) || ',"priority":' || coalesce('"' || priority || '"', 'null') || ',"segment":"' || segment || '","states":[' || coalesce('"' || array_to_string(states, '","') || '"', '') || ']}') AS fingerprint
    FROM person LEFT JOIN o USING (person_id)""")
def snapshot_fingerprint(v: Views):
    """A digest of what a person's snapshot says of their orders; equal snapshots have equal ones."""
    orders = v.sales_order.groupBy("person_id").agg(F.count("*").alias("orders"), F.array_sort(F.collect_set("status")).alias("states"), F.max("priority").alias("priority"))
    fields = [("orders", F.coalesce("orders", F.lit(0))), ("segment", F.col("segment")), ("states", F.coalesce("states", F.array().cast("array<string>"))), ("priority", F.col("priority"))]
    return v.person.join(orders, "person_id", "left").select("person_id", merging.fingerprint(*fields).alias("fingerprint"))
