"""Queries on review commands, pending records, staged sales, locks and retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review
from .catalog import query
from .views import Views

COMMANDS = """
    SELECT o_orderkey + 1 AS case_id, seq, CASE (o_orderkey + seq * 3) % 8 WHEN 0 THEN 'assign' WHEN 1 THEN 'unassign' WHEN 2 THEN 'defer' WHEN 3 THEN 'reopen' WHEN 4 THEN 'resolve' WHEN 5 THEN 'cancel' WHEN 6 THEN 'assign' ELSE 'shout' END AS command,
      'user' || CAST(seq AS STRING) AS user FROM {orders}, (SELECT 1 AS seq UNION ALL SELECT 2 UNION ALL SELECT 3) s WHERE o_orderkey % 5 <> seq"""
PLAIN = COMMANDS.replace("{orders}", "orders").replace("AS user", 'AS "user"')


@query(f"""
    WITH c AS (SELECT x.* FROM ({PLAIN}) x SEMI JOIN (SELECT case_id FROM review_case WHERE queue_state <> 'resolved') USING (case_id) WHERE command <> 'shout'), e AS (SELECT case_id, min(seq) AS e FROM c WHERE command IN ('resolve', 'cancel') GROUP BY 1),
    k AS (SELECT c.* FROM c LEFT JOIN e USING (case_id) WHERE e IS NULL OR seq <= e), l AS (SELECT case_id, arg_max(command, seq) AS last, arg_max(struct_pack(u := CASE WHEN command = 'assign' THEN "user" END), seq) FILTER (command IN ('assign', 'unassign', 'reopen')) AS h, count(*) AS n FROM k GROUP BY 1)
    SELECT case_id, CASE last WHEN 'assign' THEN 'assigned' WHEN 'unassign' THEN 'open' WHEN 'reopen' THEN 'open' WHEN 'defer' THEN 'deferred' WHEN 'resolve' THEN 'resolved' WHEN 'cancel' THEN 'cancelled' ELSE queue_state END AS queue_state,
      CASE WHEN h IS NOT NULL THEN h.u ELSE assigned_to END AS assigned_to, coalesce(n, 0) AS applied FROM review_case LEFT JOIN l USING (case_id)""")
def review_actions(v: Views):
    return review.after_commands(v.review_case, v.sql(COMMANDS))


@query("""
    SELECT case_id, priority, sla_due_at FROM (SELECT *, created_at + to_days(CAST(sla_days AS INTEGER)) AS sla_due_at FROM review_case WHERE queue_state NOT IN ('resolved', 'cancelled')) ORDER BY priority, sla_due_at NULLS LAST, created_at, case_id LIMIT 50 OFFSET 20""")
def review_queue_page(v: Views):
    page = review.queue_page(review.due(v.review_case.where("queue_state not in ('resolved', 'cancelled')")), "priority", False, 20, 50)
    return page.select("case_id", "priority", "sla_due_at")


PENDING = """
    SELECT event_id AS record_id, CAST(user_id AS STRING) AS source_record_id, event_id % 9 AS version, CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'pending_review' ELSE 'superseded' END AS lifecycle_status FROM {events}"""
VERDICTS = "SELECT event_id AS record_id, event_id % 3 <> 0 AS approved FROM {events} WHERE event_id % 5 <> 0"


@query(f"""
    WITH r AS ({PENDING.replace("{events}", "events")}), j AS (SELECT r.*, approved, lifecycle_status = 'pending_review' AND coalesce(approved, false) AS yes FROM r LEFT JOIN ({VERDICTS.replace("{events}", "events")}) USING (record_id)),
    b AS (SELECT source_record_id, max(row(version, record_id)) AS best FROM j WHERE yes GROUP BY 1)
    SELECT record_id, j.source_record_id, version, CASE WHEN yes THEN CASE WHEN best = row(version, record_id) THEN 'active' ELSE 'superseded' END WHEN lifecycle_status = 'pending_review' AND NOT approved THEN 'rejected'
      WHEN lifecycle_status = 'active' AND best IS NOT NULL THEN 'superseded' ELSE lifecycle_status END AS lifecycle_status FROM j LEFT JOIN b USING (source_record_id)""")
def pending_records_reviewed(v: Views):
    return review.after_review(v.sql(PENDING), v.sql(VERDICTS))


@query("SELECT DISTINCT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b FROM match_decision JOIN review_case USING (decision_id) WHERE decision = 'review' AND queue_state = 'resolved'")
def review_no_match_locks(v: Views):
    refused = v.match_decision.where("decision = 'review'").join(v.review_case.where("queue_state = 'resolved'").select("decision_id"), "decision_id", "left_semi")
    return review.review_locks(refused)


STAGES = """
    SELECT o_orderkey AS stage_key, 'h' || CAST(o_orderkey % 7 AS STRING) AS stage_hash, CASE WHEN o_orderkey % 23 = 0 THEN 'other' ELSE 'h' || CAST(o_orderkey % 7 AS STRING) END AS record_hash, n AS line_count,
      CASE WHEN o_orderkey % 19 = 0 THEN 9 ELSE m END AS observation_count, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey AS STRING) ELSE '' END AS order_id, 'e' AS entity_key
    FROM {orders} JOIN (SELECT l_orderkey, max(l_linenumber) AS n, sum(CASE WHEN l_linenumber < 3 THEN 1 ELSE 0 END) AS m FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""
LINES = """
    SELECT l_orderkey AS stage_key, CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 2 THEN 1 ELSE l_linenumber END AS line_index, CAST(l_linenumber AS STRING) AS line_id, CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE 'p' END AS product_id, 'h' AS line_hash FROM {lineitem}"""
SEEN = """
    SELECT l_orderkey AS stage_key, l_linenumber AS observation_index, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE 't' END AS lta_tag, CASE WHEN l_linenumber = 1 THEN 's' END AS serial_number, 'k' AS product_sku, 'h' AS observation_hash FROM {lineitem} WHERE l_linenumber < 3"""
_flat = lambda text: text.replace("{orders}", "orders").replace("{lineitem}", "lineitem")
FAULTS = f"""
    SELECT stage_key, CASE WHEN stage_hash <> record_hash THEN 'hash_differs' WHEN order_id = '' THEN 'order_incomplete' WHEN coalesce(a.n, 0) = 0 OR a.n <> line_count THEN 'line_count_differs' WHEN NOT whole THEN 'line_incomplete'
      WHEN places < a.n OR ids < a.n THEN 'line_repeated' WHEN coalesce(b.m, 0) <> observation_count THEN 'observation_count_differs' WHEN b.m > 0 AND NOT seen THEN 'observation_incomplete' END AS fault
    FROM ({_flat(STAGES)}) s LEFT JOIN (SELECT stage_key, count(*) AS n, count(DISTINCT line_index) AS places, count(DISTINCT line_id) AS ids, bool_and(product_id IS NOT NULL) AS whole FROM ({_flat(LINES)}) GROUP BY 1) a USING (stage_key)
      LEFT JOIN (SELECT stage_key, count(*) AS m, bool_and(lta_tag IS NOT NULL OR serial_number IS NOT NULL) AS seen FROM ({_flat(SEEN)}) GROUP BY 1) b USING (stage_key)"""


def faults(v: Views):
    return review.staged_sale_faults(v.sql(STAGES), v.sql(LINES), v.sql(SEEN))


@query(FAULTS)
def staged_sale_check(v: Views):
    return faults(v).select("stage_key", "fault")


@query(f"""
    SELECT stage_key, CASE WHEN stage_key % 3 = 0 THEN 'staged' WHEN stage_key % 4 = 0 THEN 'rejected' WHEN fault IS NOT NULL THEN 'refused' ELSE 'promoted' END AS state FROM ({FAULTS})""")
def staged_sale_outcome(v: Views):
    found = faults(v)
    verdicts = found.where("stage_key % 3 <> 0").select("stage_key", (F.col("stage_key") % 4 != 0).alias("approved"))
    return review.promoted(found.select("stage_key"), found, verdicts)


ANALYSES = "SELECT user_id AS person_id, event_id AS analysis_id, CASE WHEN event_id % 3 = 0 THEN 'failed' WHEN event_id % 3 = 1 THEN 'current' ELSE 'old' END AS status, ts AS completed_at FROM {events}"
REQUESTS = "SELECT user_id AS person_id, CASE WHEN event_id % 50 = 0 THEN 'queued' ELSE 'done' END AS status, event_id % 2 = 0 AS user_retry, event_id % 3 AS actor, ts AS requested_at FROM {events} WHERE event_id % 4 = 0"
NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query(f"""
    WITH a AS ({ANALYSES.replace("{events}", "events")}), r AS ({REQUESTS.replace("{events}", "events")}), p AS (SELECT DISTINCT user_id AS person_id, user_id % 3 AS actor FROM events),
    n AS (SELECT person_id, max(row(completed_at, analysis_id)) FILTER (status = 'failed') AS f, max(row(completed_at, analysis_id)) FILTER (status = 'current') AS c FROM a GROUP BY 1),
    u AS (SELECT person_id, actor, count(*) AS used FROM r WHERE user_retry AND requested_at > {NOW} - INTERVAL 1 HOUR GROUP BY ALL), b AS (SELECT DISTINCT person_id, true AS busy FROM r WHERE status = 'queued'),
    s AS (SELECT p.*, coalesce(used, 0) AS used, CASE WHEN NOT coalesce(f IS NOT NULL AND (c IS NULL OR f > c), false) THEN 'not_failed' WHEN busy THEN 'already_active' WHEN coalesce(used, 0) >= 3 THEN 'retry_limited' ELSE 'queued' END AS state
      FROM p LEFT JOIN n USING (person_id) LEFT JOIN b USING (person_id) LEFT JOIN u ON u.person_id = p.person_id AND u.actor = p.actor)
    SELECT person_id, actor, state, greatest(0, 3 - used - CASE WHEN state = 'queued' THEN 1 ELSE 0 END) AS "left" FROM s""")
def analysis_retries(v: Views):
    asked = v.events.select(F.col("user_id").alias("person_id"), (F.col("user_id") % 3).alias("actor")).distinct()
    return review.retry_admission(asked, v.sql(ANALYSES), v.sql(REQUESTS), F.expr(NOW))
