"""Queries on persons, connections, lineage and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connections as cx
from ..operators import persons as ps
from .catalog import query
from .views import Views

LIVE = "(coalesce(lifecycle_status = 'active', is_latest, false) AND (history_family IS NULL OR history_family = 'activity') AND coalesce(link_active, true))"
OWNED = f"(SELECT r.*, coalesce(r.owner_entity_key, s.entity_key) AS owner FROM source_record r LEFT JOIN source_system s USING (source_key) WHERE {LIVE})"
ADDRESS_PAIRS = "SELECT a.person_id, b.person_id AS other_id FROM lives_at a JOIN lives_at b USING (address_id) JOIN person p ON p.person_id = b.person_id WHERE coalesce(a.is_active, true) AND coalesce(b.is_active, true) AND a.person_id <> b.person_id AND p.status <> 'merged'"
KNOWN_PAIRS = "SELECT k.a AS person_id, k.b AS other_id FROM (SELECT src AS a, dst AS b FROM knows WHERE coalesce(is_active, true) UNION SELECT dst, src FROM knows WHERE coalesce(is_active, true)) k JOIN person p ON p.person_id = k.b WHERE k.a <> k.b AND p.status <> 'merged'"
ID_PAIRS = "SELECT DISTINCT a.person_id, b.person_id AS other_id, a.identifier_type, a.normalized_value FROM identified_by a JOIN identified_by b USING (identifier_type, normalized_value) JOIN person p ON p.person_id = b.person_id WHERE coalesce(a.is_active, true) AND coalesce(b.is_active, true) AND a.person_id <> b.person_id AND p.status <> 'merged'"


@query("""
    SELECT p.person_id, p.preferred_full_name AS name, count(*) AS order_count, round(sum(o.total_amount), 2) AS total_spend, strftime(max(o.ordered_at), '%Y-%m-%d') AS last_order_date
    FROM person p JOIN sales_order o USING (person_id) WHERE p.status = 'active' GROUP BY ALL ORDER BY order_count DESC, p.person_id LIMIT 100""")
def top_buyers(v: Views):
    return ps.top_buyers(v.person, v.sales_order, 100)


@query("SELECT status, count(*) AS person_count FROM person GROUP BY status")
def persons_by_status(v: Views):
    return ps.persons_by_status(v.person)


@query("""
    SELECT normalized_value, count(*) AS shared_count, array_to_string(list_slice(list_sort(list(person_id)), 1, 5), ',') AS sample_ids
    FROM (SELECT DISTINCT normalized_value, person_id FROM identified_by JOIN person p USING (person_id) WHERE identifier_type = 'phone' AND coalesce(is_active, true) AND p.status = 'active')
    GROUP BY normalized_value HAVING count(*) >= 2""")
def shared_identifiers(v: Views):
    return ps.shared_identifiers(v.identified_by, v.person).withColumn("sample_ids", F.array_join(F.col("sample_ids").cast("array<string>"), ","))


@query(f"""
    SELECT p.person_id, p.preferred_full_name AS name, p.status, count(DISTINCT r.record_id) AS source_count, coalesce(any_value(c.n), 0) AS connection_count
    FROM person p
    JOIN (SELECT DISTINCT r.person_id FROM source_record r LEFT JOIN source_system s USING (source_key) WHERE coalesce(r.link_active, true) AND coalesce(r.owner_entity_key, s.entity_key) = 7) own USING (person_id)
    JOIN source_record r ON r.person_id = p.person_id AND coalesce(r.link_active, true)
    LEFT JOIN (SELECT person_id, count(DISTINCT other_id) AS n FROM (SELECT person_id, other_id FROM ({ADDRESS_PAIRS}) UNION SELECT person_id, other_id FROM ({ID_PAIRS})) GROUP BY person_id) c ON c.person_id = p.person_id
    WHERE p.status = 'active' GROUP BY p.person_id, p.preferred_full_name, p.status""")
def entity_person_summary(v: Views):
    chosen = ps.entity_persons(7, v.person, v.source_record, v.source_system)
    pairs = [cx.shared_by(edges, key, v.person, only=chosen).select("person_id", "other_id") for edges, key in ((v.lives_at, ["address_id"]), (v.identified_by, ["identifier_type", "normalized_value"]))]
    return ps.entity_person_summary(chosen, v.source_record, pairs[0].union(pairs[1]))


@query("""
    SELECT count(*) AS all_profiles_count, count(*) FILTER (is_high_risk) AS high_risk_count, count(*) FILTER (is_high_value) AS high_value_count,
      count(*) FILTER (preferred_phone IS NULL AND preferred_email IS NULL) AS no_contact_count FROM person WHERE status <> 'merged'""")
def person_list_summary(v: Views):
    return ps.summary(v.person)


@query(f"""
    WITH page AS (SELECT person_id, preferred_full_name, preferred_phone, completeness FROM person WHERE status = 'active' AND preferred_phone IS NOT NULL AND lower(preferred_full_name) LIKE '%customer%' AND completeness IS NOT NULL
      ORDER BY completeness DESC NULLS FIRST, person_id LIMIT 50 OFFSET 20),
    live AS (SELECT r.*, coalesce(r.owner_entity_key, s.entity_key) AS owner FROM source_record r LEFT JOIN source_system s USING (source_key) WHERE {LIVE}),
    con AS (SELECT person_id, count(DISTINCT other_id) AS n FROM (SELECT * FROM ({ADDRESS_PAIRS}) UNION SELECT * FROM ({KNOWN_PAIRS})) GROUP BY person_id)
    SELECT p.person_id, p.preferred_full_name, p.completeness, (SELECT count(*) FROM live l WHERE l.person_id = p.person_id) AS source_record_count,
      (SELECT count(DISTINCT owner) FROM live l WHERE l.person_id = p.person_id) AS entity_count, (SELECT count(*) FROM identified_by i WHERE i.person_id = p.person_id AND coalesce(i.is_active, true)) AS identifier_count,
      (SELECT count(*) FROM sales_order o WHERE o.person_id = p.person_id) AS order_count, coalesce((SELECT n FROM con WHERE con.person_id = p.person_id), 0) AS connection_count,
      (SELECT max(CASE quality_flag WHEN 'valid' THEN 1.0::DOUBLE WHEN 'partial_parse' THEN 0.8 WHEN 'placeholder_value' THEN 0.1 END) FROM identified_by i WHERE i.person_id = p.person_id AND identifier_type = 'phone' AND normalized_value = p.preferred_phone AND coalesce(i.is_active, true)) AS phone_confidence
    FROM page p""")
def person_list_page(v: Views):
    rows = ps.filtered(v.person, status="active", has_phone=True, name_contains="Customer").where("completeness is not null")
    page = ps.page_of(rows.select("person_id", "preferred_full_name", "preferred_phone", "completeness"), "completeness", True, 20, 50)
    con = cx.connection_counts(v.identified_by, v.lives_at, v.knows, v.person, with_identifiers=False, only=page)
    return ps.metrics(page, v.source_record, v.source_system, v.identified_by, v.sales_order, con).drop("preferred_phone")


@query(f"""
    SELECT person_id FROM person WHERE substring(preferred_dob, 1, 4) = '1963' AND (EXISTS (SELECT 1 FROM sales_order o WHERE o.person_id = person.person_id AND o.priority = '1-URGENT'))
    UNION ALL SELECT p.person_id FROM person p WHERE (SELECT count(DISTINCT owner) FROM {OWNED} r WHERE r.person_id = p.person_id AND owner IN (3, 6)) = 2""")
def person_key_filters(v: Views):
    born = ps.with_flag(ps.filtered(v.person, birth_year=1963), v.sales_order.where("priority = '1-URGENT'"), True)
    keyed = ps.owner_entity(ps.live_links(v.source_record), v.source_system).select("person_id", F.col("entity_key").alias("key"))
    return born.select("person_id").union(ps.with_keys(v.person, keyed, [3, 6], "and").select("person_id"))


@query(f"SELECT source_key, owner AS entity_key, count(*) AS records, count(DISTINCT person_id) AS persons FROM {OWNED} GROUP BY source_key, owner")
def facets(v: Views):
    return ps.facets(v.source_record, v.source_system)


@query(f"SELECT e.entity_key, e.display_name, e.entity_type, count(r.record_id) AS record_count, count(DISTINCT r.person_id) AS person_count FROM entity e LEFT JOIN {OWNED} r ON r.owner = e.entity_key GROUP BY ALL")
def entity_list(v: Views):
    return ps.entity_list(v.entity, v.source_record, v.source_system)


@query("""
    SELECT person_id, identifier_type, normalized_value, array_to_string(list_sort(list(DISTINCT source_key)), ',') AS sources, bool_or(is_verified) AS is_verified, max(confirmed_at) AS confirmed_at
    FROM identified_by WHERE coalesce(is_active, true) GROUP BY ALL""")
def identifier_provenance(v: Views):
    return ps.identifier_provenance(v.identified_by).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


@query(f"SELECT person_id, record_id, record_type, CAST(row_number() OVER (PARTITION BY person_id ORDER BY observed_at DESC, record_id DESC) AS INTEGER) AS rank FROM source_record WHERE {LIVE}")
def person_timeline(v: Views):
    return ps.timeline(v.source_record)


@query("SELECT preferred_phone, min(person_id) AS person_id FROM person WHERE status = 'active' AND substring(preferred_dob, 6, 5) = '08-17' AND preferred_phone IS NOT NULL GROUP BY preferred_phone")
def birthday_recipients(v: Views):
    return ps.birthday_recipients(v.person, "08-17")


@query("""
    WITH w AS (SELECT product_id, display_name, list_distinct(string_split(lower(display_name), ' ')) AS own FROM product)
    SELECT product_id, display_name, len(list_intersect(own, ['red', 'bolt'])) / len(list_distinct(list_concat(own, ['red', 'bolt']))) AS score FROM w WHERE len(list_intersect(own, ['red', 'bolt'])) > 0""")
def name_search(v: Views):
    return ps.name_search(v.product.select("product_id", "display_name"), "display_name", "Red bolt")


@query(f"SELECT person_id, other_id, count(*) AS shared, CASE WHEN bool_or(identifier_type = 'nric') THEN 'strong' ELSE 'weak' END AS strength FROM ({ID_PAIRS}) GROUP BY person_id, other_id")
def connections_identifier(v: Views):
    return cx.shared_strength(cx.shared_by(v.identified_by, ["identifier_type", "normalized_value"], v.person))


@query(f"""
    SELECT person_id, other_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS relations FROM (SELECT *, 'address' AS kind FROM ({ADDRESS_PAIRS}) UNION ALL SELECT *, 'knows' FROM ({KNOWN_PAIRS})) GROUP BY person_id, other_id""")
def connections_all(v: Views):
    return cx.all_connections(v.lives_at, v.knows, v.person).withColumn("relations", F.array_join("relations", ","))


@query(f"SELECT person_id, count(DISTINCT other_id) AS connection_count FROM (SELECT * FROM ({ADDRESS_PAIRS}) UNION SELECT * FROM ({KNOWN_PAIRS}) UNION SELECT person_id, other_id FROM ({ID_PAIRS})) GROUP BY person_id")
def connection_counts(v: Views):
    return cx.connection_counts(v.identified_by, v.lives_at, v.knows, v.person, with_identifiers=True)


_EDGES = "SELECT src AS a, dst AS b FROM knows WHERE coalesce(is_active, true)"


@query(f"""
    WITH RECURSIVE edge AS (SELECT a, b FROM ({_EDGES}) UNION SELECT b, a FROM ({_EDGES})),
    walk AS (SELECT person_id AS seed, person_id AS node, 0 AS hop FROM person UNION SELECT w.seed, e.b, w.hop + 1 FROM walk w JOIN edge e ON e.a = w.node WHERE w.hop < 3)
    SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY seed, node""")
def graph_3hop(v: Views):
    edges = v.knows.where("coalesce(is_active, true)").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return cx.neighbourhood(edges, v.person.select(F.col("person_id").alias("node")), 3)


@query("""
    WITH RECURSIVE up AS (SELECT absorbed, survivor AS pos, 1 AS depth FROM merged_into UNION ALL SELECT u.absorbed, m.survivor, u.depth + 1 FROM up u JOIN merged_into m ON m.absorbed = u.pos)
    SELECT absorbed, arg_max(pos, depth) AS canonical, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY absorbed""")
def merge_canonical(v: Views):
    return cx.canonical(v.merged_into)


@query("""
    WITH RECURSIVE edge AS (SELECT src AS a, dst AS b FROM knows WHERE label = 'Father' UNION SELECT dst, src FROM knows WHERE label = 'Father'),
    reach AS (SELECT DISTINCT a AS node, a AS pos FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.pos)
    SELECT node, min(pos) AS component FROM reach GROUP BY node""")
def family_components(v: Views):
    return cx.components(v.knows.where("label = 'Father'").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("""
    WITH RECURSIVE up AS (SELECT absorbed, survivor AS pos, 1 AS depth FROM merged_into UNION ALL SELECT u.absorbed, m.survivor, u.depth + 1 FROM up u JOIN merged_into m ON m.absorbed = u.pos),
    c AS (SELECT absorbed, arg_max(pos, depth) AS canonical, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY absorbed)
    SELECT c.canonical AS person_id, e.event_id, e.event_type, e.absorbed, c.depth FROM merge_event e JOIN c USING (absorbed)""")
def audit_trail(v: Views):
    return cx.audit_trail(v.merge_event, cx.canonical(v.merged_into))


@query("""
    SELECT event_id, CASE event_type WHEN 'unmerge' THEN 'person.unmerged' ELSE 'person.merged' END AS kind, array_to_string(list_sort([absorbed, survivor]), ',') AS person_ids FROM merge_event WHERE created_at > 20000""")
def events_feed(v: Views):
    return cx.events_feed(v.merge_event, 20000).withColumn("person_ids", F.array_join(F.col("person_ids").cast("array<string>"), ","))


@query("SELECT absorbed, arg_max(survivor, created_at) AS survivor FROM merge_event GROUP BY absorbed HAVING arg_max(event_type, created_at) <> 'unmerge'")
def active_merges(v: Views):
    return cx.active_merges(v.merge_event)


@query("""
    WITH RECURSIVE up AS (SELECT absorbed, survivor AS pos, 1 AS depth FROM merged_into UNION ALL SELECT u.absorbed, m.survivor, u.depth + 1 FROM up u JOIN merged_into m ON m.absorbed = u.pos),
    c AS (SELECT absorbed, arg_max(pos, depth) AS canonical FROM up GROUP BY absorbed)
    SELECT DISTINCT coalesce(c.canonical, i.person_id) AS person_id, identifier_type, normalized_value FROM identified_by i LEFT JOIN c ON c.absorbed = i.person_id""")
def merged_identifiers(v: Views):
    return cx.rewired(v.identified_by.select("person_id", "identifier_type", "normalized_value"), cx.canonical(v.merged_into))


@query("SELECT segment, count(*) AS persons, round(sum(balance), 2) AS balance FROM person WHERE balance > 1000.5 GROUP BY segment HAVING count(*) >= 2")
def stored_report(v: Views):
    text = "SELECT segment, count(*) AS persons, round(sum(balance), 2) AS balance FROM {person} WHERE balance > :floor GROUP BY segment HAVING count(*) >= :least"
    return ps.stored_report(v.spark, text, {"person": v.person}, {"floor": "float", "least": "integer"}, {"floor": "1000.5", "least": "2"})
