"""Queries on what happens between sources and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import relationship_category
from ..operators import intake
from .catalog import query
from .views import Views

CATEGORY = """CASE WHEN regexp_matches(lower(label), 'emergency|next of kin|nok') THEN 'emergency_contact' WHEN regexp_matches(lower(label), 'referrer|referral') THEN 'referrer'
    WHEN regexp_matches(lower(label), 'spouse|parent|child|sibling|brother|sister|family') THEN 'family' ELSE 'social' END"""


@query(f"SELECT label, {CATEGORY} AS category, count(*) AS records FROM contact_record GROUP BY ALL")
def relationship_categories(v: Views):
    return v.contact_record.groupBy("label", relationship_category(F.col("label")).alias("category")).agg(F.count("*").alias("records"))


@query(f"""
    SELECT a.person_id AS src, b.person_id AS dst, label, max(record_id) AS record_id, {CATEGORY} AS category FROM contact_record c JOIN source_link a ON a.source_key = c.source_key AND a.source_record_id = c.declarer_id
    JOIN source_link b ON b.source_key = c.source_key AND b.source_record_id = c.contact_id WHERE a.person_id <> b.person_id GROUP BY ALL""")
def knows_materialised(v: Views):
    return intake.knows_from_contacts(v.contact_record, v.source_link)


@query("""
    WITH p AS (SELECT source_key, source_record_id, record_id, coalesce(lifecycle_status, '') AS s, record_id % 9 AS version FROM source_record WHERE record_type = 'crm_deal' AND lifecycle_status IN ('active', 'pending_review')),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source_key, source_record_id ORDER BY s <> 'active', version DESC, record_id) = 1)
    SELECT c.record_id AS child_id, b.record_id AS parent_id, b.s AS parent_status FROM source_record c LEFT JOIN b USING (source_key, source_record_id) WHERE c.record_type = 'crm_history'""")
def history_parents(v: Views):
    named = v.source_record.withColumnsRenamed({"source_key": "parent_source", "source_record_id": "parent_record_id"})
    parents = named.where("record_type = 'crm_deal'").withColumn("version", F.col("record_id") % 9)
    return intake.preferred_parent(named.where("record_type = 'crm_history'").withColumn("child_id", F.col("record_id")), parents)


HELD = """
    SELECT CAST(event_id AS STRING) AS source_record_id, user_id AS person_id, event_type AS stage, CASE WHEN event_id % 4 <> 0 THEN 'k' END AS kind FROM {events}
    UNION ALL SELECT CAST(event_id AS STRING), user_id + 1, event_type, CASE WHEN event_id % 4 <> 0 THEN 'k' END FROM {events} WHERE event_id % 5 = 0"""
CAME = "SELECT event_id AS record_id, CAST(event_id AS STRING) AS source_record_id, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE event_type END AS stage, CASE WHEN event_id % 8 <> 0 AND event_id % 4 <> 0 THEN 'k' WHEN event_id % 16 = 8 THEN 'x' END AS kind FROM {events}"


@query(f"""
    WITH a AS ({HELD.replace("{events}", "events")}), i AS ({CAME.replace("{events}", "events")}), o AS (SELECT source_record_id, min(person_id) AS person_id FROM a GROUP BY 1 HAVING count(DISTINCT person_id) = 1)
    SELECT i.record_id, o.person_id FROM i JOIN o USING (source_record_id) JOIN a USING (source_record_id) WHERE i.stage IS NOT DISTINCT FROM a.stage AND i.kind IS NOT DISTINCT FROM a.kind""")
def identity_unchanged(v: Views):
    return intake.unchanged_identity(v.sql(CAME), v.sql(HELD), ["stage", "kind"])


REGISTER = "SELECT event_id AS record_id, CASE WHEN event_id % 9 <> 0 THEN 'blk ' || CAST(event_id % 4000 AS STRING) || ', example street' END AS normalized_full FROM {events}"


@query(f"""
    SELECT record_id, coalesce(known, 'new:' || substr(sha256(normalized_full), 1, 16)) AS address_id, known IS NULL AS is_new FROM ({REGISTER.replace("{events}", "events")}) r
    LEFT JOIN (SELECT normalized_full, CAST(min(address_id) AS VARCHAR) AS known FROM lives_at GROUP BY 1) USING (normalized_full) WHERE normalized_full IS NOT NULL""")
def address_only_records(v: Views):
    return intake.address_only(v.sql(REGISTER), v.lives_at)


CASES = """
    SELECT event_id % 4 AS source_key, user_id AS case_id, CASE WHEN event_id % 3 <> 0 THEN 's' || CAST(event_id % 5 AS STRING) END AS status, ts AS filed_at, CASE WHEN event_id % 4 <> 1 THEN 'd' || CAST(event_id AS STRING) END AS document,
      'S' || CAST(1000000 + CAST(floor(user_id / 10) AS BIGINT) AS STRING) || 'A' AS nric FROM {events}"""


@query(f"""
    WITH r AS ({CASES.replace("{events}", "events")}), n AS (SELECT source_key, case_id, arg_max(status, filed_at) FILTER (status IS NOT NULL) AS status, max(filed_at) AS filed_at, max(nric) AS nric FROM r GROUP BY ALL),
    o AS (SELECT normalized_value AS nric, min(person_id) AS person_id FROM identified_by WHERE identifier_type = 'nric' GROUP BY 1 HAVING count(DISTINCT person_id) = 1)
    SELECT n.source_key, n.case_id, n.status, n.filed_at, o.person_id FROM n LEFT JOIN o USING (nric)""")
def bankruptcy_case_edges(v: Views):
    rows = v.sql(CASES)
    owners = v.identified_by.where("identifier_type = 'nric'").select(F.col("normalized_value").alias("nric"), "person_id")
    cases, edges = intake.bankruptcy_cases(rows.limit(0), rows, owners)
    return cases.join(edges, ["source_key", "case_id"], "left").select("source_key", "case_id", "status", "filed_at", "person_id")


@query("""
    SELECT observation_id FROM vehicle_observation WHERE NOT coalesce(product_sku = 'K1' AND lta_tag LIKE '%7', false) AND NOT coalesce(product_sku = 'K2' AND serial_number LIKE '%5  x', false)""")
def vehicles_not_excluded(v: Views):
    o = v.vehicle_observation
    tags = o.where("product_sku = 'K1' and lta_tag like '%7'").select("product_sku", "lta_tag", F.lit(None).cast("string").alias("serial_number"))
    serials = o.where("product_sku = 'K2' and serial_number like '%5  x'").select("product_sku", F.lit(None).cast("string").alias("lta_tag"), "serial_number")
    return intake.vehicles_without(o, tags.union(serials)).select("observation_id")


@query("""
    WITH x AS (SELECT record_id, CASE WHEN record_id % 3 = 0 OR record_id % 5 = 1 THEN 0 ELSE 1 END AS persons, CASE WHEN record_id % 4 = 0 OR record_id % 7 = 2 OR record_id % 2 = 1 THEN 0 ELSE 1 END AS possible, CASE WHEN record_id % 6 = 3 THEN 0 ELSE 1 END AS strong FROM source_record)
    SELECT record_id, persons, possible, strong FROM x WHERE persons + possible + strong > 0""")
def extraction_exclusion(v: Views):
    mod = lambda n, name: F.concat(F.lit(name), (F.col("record_id") % n).cast("string"))
    item = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    person = lambda phone, email, name, *more: F.struct(phone.alias("phone"), email.alias("email"), name.alias("name"), *more)
    none = F.lit(None).cast("string")
    rows = v.source_record.select(
        "record_id", F.array(person(mod(3, "p"), none, mod(5, "n"))).alias("persons"),
        F.array(person(none, mod(4, "e"), none, F.array(item("phone", mod(7, "q")), item("source_customer_ref", mod(2, "c"))).alias("identifiers"))).alias("possible_persons"), F.array(item("email", mod(6, "m"))).alias("strong_identifiers"),
    )
    out = intake.filtered_extractions(rows, ["p0", "q2"], ["e0", "m3"], ["n1"], ["c1"])
    return out.select("record_id", F.size("persons").alias("persons"), F.size("possible_persons").alias("possible"), F.size("strong_identifiers").alias("strong"))


LOGS = """
    SELECT user_id AS chat_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS at, CASE WHEN event_id % 2 = 0 THEN 'personalize' ELSE 'template' END AS origin, event_id AS id, 0 AS part,
      CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'line ' || CAST(event_id AS STRING) END AS line FROM {events} WHERE event_id % 2 = """


@query("""
    WITH l AS (SELECT user_id AS chat_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS at_, CASE WHEN event_id % 2 = 0 THEN 'personalize' ELSE 'template' END AS origin, event_id AS id, 'line ' || event_id AS line FROM events WHERE event_id % 5 <> 0)
    SELECT chat_id, coalesce(string_agg(line, chr(10) ORDER BY at_ NULLS LAST, origin, id), '') AS text FROM (SELECT DISTINCT user_id AS chat_id FROM events) LEFT JOIN l USING (chat_id) GROUP BY chat_id""")
def merged_message_logs(v: Views):
    return intake.chat_text(v.events.select(F.col("user_id").alias("chat_id")).distinct(), v.sql(LOGS + "0"), v.sql(LOGS + "1"))


@query("""
    SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, s.s_name AS merchant, n.n_name AS variant, p.p_name AS product FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_suppkey % 4 <> 0
    LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN part p ON p.p_partkey = n.n_nationkey + 1""")
def product_of_line(v: Views):
    lines = v.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("offer_id"))
    offers = v.supplier.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("offer_id"), F.col("s_name").alias("merchant"), F.col("s_nationkey").alias("variant_id"))
    variants = v.nation.select(F.col("n_nationkey").alias("variant_id"), F.col("n_name").alias("variant"), (F.col("n_nationkey") + 1).alias("product_id"))
    out = intake.product_chain(lines, offers, variants, v.part.select(F.col("p_partkey").cast("long").alias("product_id"), F.col("p_name").alias("product")))
    return out.select("order_id", "line_no", "merchant", "variant", "product")


@query("""
    WITH a AS (SELECT o_custkey AS k, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS l FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1), i AS (SELECT person_id AS k, string_agg(identifier_type, ',' ORDER BY identifier_type, normalized_value) AS l FROM identified_by GROUP BY 1)
    SELECT c_custkey AS person_id, coalesce(a.l, '') AS orders, coalesce(i.l, '') AS identifiers FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN i ON i.k = c_custkey""")
def user_side_lists(v: Views):
    orders = v.sales_order.where("person_id % 3 <> 0").select("person_id", "order_id")
    out = intake.with_side_lists(v.person.select("person_id"), "person_id", orders=(orders, ["order_id"]), identifiers=(v.identified_by, ["identifier_type", "normalized_value"]))
    join = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",").alias(c)
    return out.select("person_id", join("orders", "order_id"), join("identifiers", "identifier_type"))


COVERED = """
    SELECT event_id % 3 AS generation, event_id % 2 AS stream, event_id % 7 <> 0 AS terminal, ts AS updated_at, event_id AS committed_count,
      CASE event_id % 9 WHEN 0 THEN 'created' WHEN 1 THEN 'existing_same_hash' WHEN 2 THEN 'updated_projection' WHEN 3 THEN 'scope_unchanged' WHEN 4 THEN 'excluded_out_of_scope' WHEN 5 THEN 'quarantined_owner_unresolved' WHEN 6 THEN 'conflict' WHEN 7 THEN 'failed' ELSE 'open' END AS disposition FROM {events}"""


@query("SELECT generation, stream, count(*) AS coverage_count, count(*) FILTER (terminal) AS terminal_count, " + ", ".join(f"count(*) FILTER (disposition = '{d}') AS {n}_count" for n, d in intake.COVERAGE.items()) + f", arg_max(committed_count, updated_at) AS checkpoint_committed_count FROM ({COVERED.replace('{events}', 'events')}) GROUP BY ALL")
def backfill_coverage(v: Views):
    rows = v.sql(COVERED)
    return intake.coverage_report(rows, rows.select("generation", "stream", "committed_count", "updated_at"))


@query("""
    SELECT c_custkey AS deal_id, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_nationkey IN (1, 2, 3) THEN 'refreshed' ELSE 'out_of_scope' END WHEN c_custkey % 4 + 1 >= 3 THEN 'failed' ELSE 'absent' END AS outcome, CASE WHEN c_custkey % 5 <> 0 THEN 0 ELSE c_custkey % 4 + 1 END AS absent FROM customer""")
def known_owners_refreshed(v: Views):
    known = v.customer.select(F.col("c_custkey").alias("deal_id"), (F.col("c_custkey") % 4).alias("absent_before"))
    read = v.customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("deal_id"), F.col("c_nationkey").alias("category"))
    return intake.known_owner_refresh(known, read, [1, 2, 3], 3)


@query("""
    SELECT d AS disposition, count(*) AS rows FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'malformed_excluded' WHEN event_id % 7 = 0 THEN 'capture_rejected_valid' WHEN event_id % 10 = 1 THEN 'excluded_out_of_scope' WHEN event_id % 6 = 0 THEN 'same_hash_replay'
      WHEN event_id % 6 = 1 THEN 'differing_hash_conflict' ELSE ['canonical_effective', 'canonical_pending_parent', 'parent_ambiguous', 'parent_waiting', NULL][CAST(event_id % 5 + 1 AS INT)] END AS d FROM events) GROUP BY 1""")
def terminal_dispositions(v: Views):
    k = F.col("event_id")
    scope = F.when(k % 10 == 0, "malformed").when(k % 10 == 1, "out_of_scope").otherwise("in_scope")
    hashes = F.when(k % 6 == 0, "existing_same_hash").when(k % 6 == 1, "new_conflict_variant").otherwise("new_variant")
    parent = F.element_at(F.array(*map(F.lit, ("selected_active", "selected_pending_review", "ambiguous", "waiting", "odd"))), (k % 5 + 1).cast("int"))
    return v.events.groupBy(intake.terminal_disposition(scope, k % 7 != 0, hashes, parent).alias("disposition")).agg(F.count("*").alias("rows"))


OUTPUTS = """
    SELECT event_id AS output_id, CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN ' Limitations: x' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '<b>x</b> Limitations: x' WHEN 4 THEN 'no such part' WHEN 5 THEN 'Cites source-1 and Order-9. Limitations: none' WHEN 6 THEN 'Cites order-9' || chr(10) || 'Limitations: none'
      WHEN 7 THEN 'Mail a.b@example.org' || chr(10) || 'Limitations: x' WHEN 8 THEN 'Call 81234567 now' || chr(10) || 'Limitations: x' WHEN 9 THEN 'About JANE doe' || chr(10) || 'Limitations: x' WHEN 10 THEN repeat('word ', 400) || chr(10) || 'Limitations: x'
      ELSE 'Bought often, see source-1' || chr(10) || 'Limitations: few records' END AS text FROM {events}"""


@query(f"""
    WITH o AS ({OUTPUTS.replace("{events}", "events")})
    SELECT output_id, CASE output_id % 12 WHEN 0 THEN 'not_trimmed' WHEN 1 THEN 'not_trimmed' WHEN 2 THEN 'not_plain_text' WHEN 3 THEN 'not_plain_text' WHEN 4 THEN 'missing_limitations' WHEN 5 THEN 'missing_limitations' WHEN 6 THEN 'unknown_evidence'
      WHEN 7 THEN 'direct_identifier' WHEN 8 THEN 'direct_identifier' WHEN 9 THEN 'sensitive_value' WHEN 10 THEN 'too_large' END AS fault FROM o""")
def generated_text_faults(v: Views):
    return v.sql(OUTPUTS).select("output_id", intake.output_fault(F.col("text"), F.array(F.lit("source-1")), F.array(F.lit("Jane Doe"), F.lit(""))).alias("fault"))


@query("""
    WITH l AS (SELECT DISTINCT o_custkey % 40 AS grp, o_orderkey % 50 AS m FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT DISTINCT o_custkey % 40 AS grp, o_orderkey % 50 AS m FROM orders WHERE o_orderkey % 5 <> 0),
    b AS (SELECT coalesce(l.grp, r.grp) AS grp, l.m AS a, r.m AS b FROM l FULL JOIN r ON l.grp = r.grp AND l.m = r.m)
    SELECT grp, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS is_equal, count(*) FILTER (a IS NULL) = 0 AS is_subset FROM b GROUP BY 1""")
def set_checks(v: Views):
    rows = v.orders.select((F.col("o_custkey") % 40).alias("grp"), (F.col("o_orderkey") % 50).alias("m"), "o_orderkey")
    return intake.set_differences(rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 5 <> 0"), "m", "grp")


@query("""
    SELECT 'sha256:' || sha256(string_agg(r, ',' ORDER BY r)) AS digest FROM (SELECT DISTINCT '{"category_id":"C' || event_id % 3 || '","stage_id":"S' || event_id % 7 || '","state":' || CASE event_type WHEN 'purchase' THEN '"won"' ELSE 'null' END || '}' AS r FROM events)""")
def stage_mapping_digest(v: Views):
    entries = v.stage_event.select("category_id", "stage_id", F.when(F.col("mapped_state") == "won", "won").alias("state"))
    return intake.mapping_digest(entries, ["category_id", "stage_id", "state"])


@query("""
    SELECT analysis_id, completed_at FROM (SELECT event_id AS analysis_id, user_id, ts AS completed_at FROM events) WHERE user_id = 7 ORDER BY completed_at DESC, analysis_id DESC LIMIT 5 OFFSET 2""")
def analysis_history(v: Views):
    rows = v.events.select(F.col("event_id").alias("analysis_id"), F.col("user_id").alias("person_id"), F.col("ts").alias("completed_at"))
    return intake.history_page(rows, 7, 2, 5).select("analysis_id", "completed_at")


@query("SELECT user_id AS person_id, event_id % 3 AS kind, arg_max(event_id, row(ts, event_id)) AS analysis_id FROM events GROUP BY ALL")
def analysis_state(v: Views):
    rows = v.events.select(F.col("user_id").alias("person_id"), (F.col("event_id") % 3).alias("kind"), F.col("event_id").alias("analysis_id"), "ts")
    return intake.newest_per(rows, ["person_id", "kind"], ["ts", "analysis_id"]).select("person_id", "kind", "analysis_id")
