"""Queries on the person list, the person page and the review list in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import listing as ls
from ..operators import review
from .catalog import query
from .views import Views

LIVE = "(coalesce(lifecycle_status = 'active', is_latest, false) AND coalesce(link_active, true))"
SEEN = f"{LIVE} AND (history_family IS NULL OR history_family = 'activity')"
#: Pairs of persons by what they share, and the metrics of every person, each written as the plain self join or count that it means.
PARTS = f"""
    ids AS (SELECT DISTINCT a.person_id, b.person_id AS other_id FROM identified_by a JOIN identified_by b USING (identifier_type, normalized_value)
      JOIN person p ON p.person_id = b.person_id AND p.status <> 'merged'
      WHERE coalesce(a.is_active, true) AND coalesce(b.is_active, true) AND a.person_id <> b.person_id),
    homes AS (SELECT DISTINCT a.person_id, b.person_id AS other_id FROM residence a JOIN residence b USING (address_id)
      JOIN person p ON p.person_id = b.person_id AND p.status <> 'merged'
      WHERE coalesce(a.is_active, true) AND coalesce(b.is_active, true) AND a.person_id <> b.person_id),
    said AS (SELECT DISTINCT k.a AS person_id, k.b AS other_id
      FROM (SELECT src AS a, dst AS b FROM knows WHERE coalesce(is_active, true) UNION SELECT dst, src FROM knows WHERE coalesce(is_active, true)) k
      JOIN person p ON p.person_id = k.b AND p.status <> 'merged' WHERE k.a <> k.b),
    open_pairs AS (SELECT d.* FROM match_decision d WHERE decision_id IN (SELECT decision_id FROM review_case WHERE queue_state NOT IN ('resolved', 'cancelled'))
      AND left_id IN (SELECT person_id FROM person) AND right_id IN (SELECT person_id FROM person)),
    sys AS (SELECT DISTINCT left_id AS person_id, decision_id FROM open_pairs UNION SELECT right_id, decision_id FROM open_pairs),
    owned AS (SELECT r.person_id, coalesce(r.owner_entity_key, s.entity_key) AS entity_key, count(DISTINCT record_id) AS n
      FROM source_record r LEFT JOIN source_system s USING (source_key) WHERE {SEEN} AND coalesce(r.owner_entity_key, s.entity_key) IS NOT NULL GROUP BY 1, 2),
    ents AS (SELECT person_id, count(*) AS n, string_agg(entity_key || ':' || n, ',' ORDER BY entity_key) AS entities FROM owned GROUP BY 1)"""


def _n(source: str, condition: str = "true") -> str:
    return f"coalesce((SELECT count(*) FROM {source} x WHERE x.person_id = p.person_id AND {condition}), 0)"


METRICS = f"""
    {_n("source_record", SEEN)} AS source_record_count, coalesce((SELECT n FROM ents e WHERE e.person_id = p.person_id), 0) AS entity_count,
    {_n("identified_by", "coalesce(x.is_active, true)")} AS identifier_count, {_n("(SELECT * FROM homes UNION SELECT * FROM said)")} AS connection_count,
    {_n("ids")} AS possible_match_count, {_n("sys")} AS system_match_count, {_n("sales_order")} AS order_count,
    {_n("bankruptcy_edge", "coalesce(x.is_active, true)")} AS bankruptcy_case_count,
    (SELECT max(CASE quality_flag WHEN 'valid' THEN 1.0::DOUBLE WHEN 'partial_parse' THEN 0.8 WHEN 'placeholder_value' THEN 0.1 END) FROM identified_by i
      WHERE i.person_id = p.person_id AND identifier_type = 'phone' AND normalized_value = p.preferred_phone AND coalesce(i.is_active, true)) AS phone_confidence,
    (SELECT entities FROM ents e WHERE e.person_id = p.person_id) AS entities"""
SHOWN = ["place", "person_id", "preferred_full_name", "updated_at", "crm_deal_count", "street_name", "unit_number", "city", "postal_code", "country_code"]
SHOWN_SQL = "place, p.person_id, preferred_full_name, updated_at, crm_deal_count, a.street_name, a.unit_number, a.city, a.postal_code, a.country_code"


def tables(v: Views) -> ls.Tables:
    return ls.Tables(
        persons=v.listed_person, records=v.source_record, systems=v.source_system, identified_by=v.identified_by, lives_at=v.residence, addresses=v.address, knows=v.knows,
        orders=v.sales_order, bankruptcies=v.bankruptcy_edge, decisions=v.match_decision, cases=v.review_case,
    )


def shown(page):
    pairs = F.transform("entities", lambda e: F.concat_ws(":", e["entity_key"].cast("string"), e["records"].cast("string")))
    return page.select(*SHOWN, *ls.METRICS, F.array_join(pairs, ",").alias("entities"))


@query(f"""
    WITH {PARTS},
    page AS (SELECT *, CAST(row_number() OVER (ORDER BY completeness DESC NULLS FIRST, person_id) AS INTEGER) AS place FROM listed_person
      WHERE status <> 'merged' AND completeness IS NOT NULL AND (preferred_phone IS NOT NULL OR preferred_email IS NOT NULL) AND preferred_dob BETWEEN '1955' AND '1990'
        AND updated_at >= TIMESTAMP '1996-01-01' AND crm_deal_count >= 1)
    SELECT {SHOWN_SQL}, {METRICS}
    FROM page p LEFT JOIN address a ON a.address_id = p.preferred_address_id WHERE place BETWEEN 6 AND 45""")
def person_list_full(v: Views):
    asked = {"has_any_contact": True, "dob_from": "1955", "dob_to": "1990", "updated_after": _time("1996-01-01 00:00:00"), "crm_deal_count_min": 1}
    return shown(ls.page(tables(v), skip=5, limit=40, **asked))


def _time(text: str):
    return F.to_timestamp(F.lit(text))


@query(f"""
    WITH {PARTS}, counted AS (SELECT p.*, {_n("ids")} AS matches FROM listed_person p WHERE status <> 'merged' AND preferred_address_id IS NOT NULL),
    page AS (SELECT *, CAST(row_number() OVER (ORDER BY matches DESC, person_id) AS INTEGER) AS place FROM counted)
    SELECT {SHOWN_SQL}, {METRICS} FROM page p LEFT JOIN address a ON a.address_id = p.preferred_address_id WHERE place BETWEEN 11 AND 40""")
def person_list_by_matches(v: Views):
    return shown(ls.page(tables(v), "possible_match_count", True, 10, 30, has_address=True))


@query(f"""
    WITH {PARTS}, counted AS (SELECT p.*, {_n("(SELECT * FROM homes UNION SELECT * FROM said)")} AS met FROM listed_person p WHERE status <> 'merged' AND is_high_value),
    page AS (SELECT *, CAST(row_number() OVER (ORDER BY met, person_id) AS INTEGER) AS place FROM counted)
    SELECT {SHOWN_SQL}, {METRICS} FROM page p LEFT JOIN address a ON a.address_id = p.preferred_address_id WHERE place <= 25""")
def person_list_by_connections(v: Views):
    return shown(ls.page(tables(v), "connection_count", False, 0, 25, is_high_value=True))


def _has_keys(column: str, keys: str) -> str:
    return f"(SELECT count(DISTINCT {column}) FROM source_record r LEFT JOIN source_system s USING (source_key) WHERE r.person_id = p.person_id AND {LIVE} AND {column} IN ({keys}))"


_OWNER = "coalesce(r.owner_entity_key, s.entity_key)"
_AT = "EXISTS (SELECT 1 FROM residence l JOIN address a USING (address_id) WHERE l.person_id = p.person_id AND coalesce(l.is_active, true) AND {})".format
_BANKRUPT = "EXISTS (SELECT 1 FROM bankruptcy_edge b WHERE b.person_id = p.person_id AND coalesce(b.is_active, true))"
_POSSIBLE, _SYSTEM = "p.person_id IN (SELECT person_id FROM ids)", "p.person_id IN (SELECT person_id FROM sys)"
_TYPED = f"EXISTS (SELECT 1 FROM source_record r WHERE r.person_id = p.person_id AND {LIVE} AND r.record_type = 'call')"

#: Filters as a list is asked for them, next to what they mean.
ASKED = {
    "contact": ({"has_any_contact": False}, "preferred_phone IS NULL AND preferred_email IS NULL"),
    "address": ({"addr_street": "machinery r", "addr_country": "asia"}, _AT("lower(a.street_name) LIKE '%machinery r%' AND lower(a.country_code) LIKE '%asia%'")),
    "city": ({"addr_city": "A", "addr_unit": "#1", "addr_postal": "0001"}, _AT("a.city LIKE '%A%' AND a.unit_number LIKE '%#1%' AND a.postal_code LIKE '%0001%'")),
    "no_address": ({"has_address": False}, "preferred_address_id IS NULL"),
    "deals": ({"crm_deal_count_max": 1}, "crm_deal_count <= 1"),
    "bankrupt": ({"has_bankruptcy_case": True}, _BANKRUPT),
    "solvent": ({"has_bankruptcy_case": False, "is_high_risk": True}, f"is_high_risk AND NOT {_BANKRUPT}"),
    "possible": ({"has_possible_match": True}, _POSSIBLE),
    "alone": ({"has_possible_match": False}, f"NOT ({_POSSIBLE})"),
    "system": ({"has_system_match": True}, _SYSTEM),
    "any": ({"has_any_match": True}, f"({_POSSIBLE} OR {_SYSTEM})"),
    "none": ({"has_any_match": False}, f"NOT ({_POSSIBLE} OR {_SYSTEM})"),
    "entities": ({"entity_keys": [3, 6], "entity_mode": "and"}, f"{_has_keys(_OWNER, '3, 6')} = 2"),
    "entity": ({"entity_keys": [3, 6]}, f"{_has_keys(_OWNER, '3, 6')} >= 1"),
    "sources": ({"source_keys": [1, 4], "source_mode": "and"}, f"{_has_keys('r.source_key', '1, 4')} = 2"),
    "type": ({"source_record_type": "call"}, _TYPED),
}


@query(
    f"WITH {PARTS} "
    + " UNION ALL ".join(f"SELECT '{name}' AS asked, count(*) AS total, coalesce(sum(person_id), 0)::BIGINT AS ids FROM listed_person p WHERE status <> 'merged' AND {sql}" for name, (_, sql) in ASKED.items())
)
def person_list_totals(v: Views):
    t = tables(v)
    one = lambda name, asked: ls.listed(t, "person_id", **asked).agg(F.count("*").alias("total"), F.coalesce(F.sum("person_id"), F.lit(0)).alias("ids")).select(F.lit(name).alias("asked"), "total", "ids")
    return reduce(lambda a, b: a.union(b), [one(name, asked) for name, (asked, _) in ASKED.items()])


@query(f"""
    WITH RECURSIVE up AS (SELECT absorbed, survivor AS pos, 1 AS depth FROM merged_into UNION ALL SELECT u.absorbed, m.survivor, u.depth + 1 FROM up u JOIN merged_into m ON m.absorbed = u.pos),
    c AS (SELECT absorbed, arg_max(pos, depth) AS canonical FROM up GROUP BY absorbed), {PARTS},
    met AS (SELECT person_id, count(*) AS n FROM (SELECT * FROM ids UNION SELECT * FROM homes UNION SELECT * FROM said) GROUP BY 1),
    r AS (SELECT person_id, count(*) AS n FROM source_record WHERE {SEEN} GROUP BY 1), o AS (SELECT person_id, sum(total_amount) AS n FROM sales_order GROUP BY 1)
    SELECT q.person_id AS asked_id, p.person_id, p.status, p.preferred_full_name, a.city, a.postal_code, coalesce(r.n, 0) AS source_record_count, coalesce(met.n, 0) AS connection_count,
      round(coalesce(o.n, 0), 2) AS lifetime_value
    FROM person q LEFT JOIN c ON c.absorbed = q.person_id JOIN listed_person p ON p.person_id = coalesce(c.canonical, q.person_id) LEFT JOIN address a ON a.address_id = p.preferred_address_id
      LEFT JOIN met ON met.person_id = p.person_id LEFT JOIN r ON r.person_id = p.person_id LEFT JOIN o ON o.person_id = p.person_id""")
def person_detail(v: Views):
    out = ls.details(tables(v), v.merged_into)
    return out.select("asked_id", "person_id", "status", "preferred_full_name", "city", "postal_code", "source_record_count", "connection_count", F.round("lifetime_value", 2).alias("lifetime_value"))


#: Cases with their decision, without those whose records no longer wait for review.
CASES = """
    cases AS (SELECT c.*, c.created_at + to_days(CAST(c.sla_days AS INTEGER)) AS sla_due_at, d.left_id, d.right_id, d.confidence, d.decision, d.engine FROM review_case c JOIN match_decision d USING (decision_id)
      WHERE NOT EXISTS (SELECT 1 FROM involved_record i WHERE i.decision_id = c.decision_id
        AND ((lifecycle_status IS NOT NULL AND lifecycle_status <> 'pending_review') OR (lifecycle_status IS NULL AND NOT coalesce(is_latest, false)))))"""
CASE_COLUMNS = ["place", "case_id", "queue_state", "priority", "assigned_to", "sla_due_at", "confidence", "left_id", "left_name", "left_status", "right_id", "right_name", "right_status"]
CASE_SQL = """
    SELECT place, case_id, queue_state, priority, assigned_to, sla_due_at, confidence, CASE WHEN l.person_id IS NOT NULL THEN left_id END AS left_id, l.preferred_full_name AS left_name, l.status AS left_status,
      CASE WHEN r.person_id IS NOT NULL THEN right_id END AS right_id, r.preferred_full_name AS right_name, r.status AS right_status
    FROM page LEFT JOIN person l ON l.person_id = left_id LEFT JOIN person r ON r.person_id = right_id"""


def case_rows(v: Views, **asked):
    return review.listed(v.review_case, v.match_decision, v.person, v.involved_record, **asked)


def case_page(v: Views, rows, *args, **kwargs):
    out = review.list_page(rows, v.person, *args, **kwargs)
    for side in ("left", "right"):
        out = out.withColumn(f"{side}_id", F.when(F.col(f"{side}_known"), F.col(f"{side}_id"))).withColumnRenamed(f"{side}_preferred_full_name", f"{side}_name")
    return out.select(*CASE_COLUMNS)


@query(f"""
    WITH {CASES}, page AS (SELECT *, CAST(row_number() OVER (ORDER BY confidence DESC, sla_due_at NULLS LAST, created_at, case_id) AS INTEGER) AS place FROM cases
      WHERE sla_due_at < TIMESTAMP '1998-01-01' AND queue_state NOT IN ('resolved', 'cancelled') AND priority BETWEEN 2 AND 3 AND confidence <= 0.35 AND created_at >= TIMESTAMP '1993-01-01' AND engine = 'heuristic')
    {CASE_SQL} WHERE place BETWEEN 4 AND 33""")
def review_list_overdue(v: Views):
    rows = case_rows(v, overdue_at=_time("1998-01-01 00:00:00"), priority_gte=2, priority_lte=3, confidence_lte=0.35, created_after=_time("1993-01-01 00:00:00"), engine="heuristic")
    return case_page(v, rows, "confidence", skip=3, limit=30)


#: Searches and filters of the list next to what they mean.
REVIEWED = {
    "id": ({"q": "77"}, "case_id LIKE '%77%' OR l.preferred_full_name LIKE '%77%' OR l.preferred_phone LIKE '%77%' OR l.preferred_email LIKE '%77%' OR r.preferred_full_name LIKE '%77%' OR r.preferred_phone LIKE '%77%' OR r.preferred_email LIKE '%77%'"),
    "engine": ({"q": "DETERM"}, "engine = 'deterministic'"),
    "assignee": ({"q": "USER3", "queue_state": "assigned"}, "queue_state = 'assigned' AND (assigned_to = 'user3' OR l.preferred_email LIKE 'user3%' OR r.preferred_email LIKE 'user3%')"),
    "person": ({"person_id": 44}, "l.person_id = 44 OR r.person_id = 44"),
    "resolved": ({"resolved": True, "decision": "review"}, "queue_state IN ('resolved', 'cancelled') AND decision = 'review'"),
    "mine": ({"assigned_to": "user1", "confidence_gte": 0.21}, "assigned_to = 'user1' AND confidence >= 0.21"),
    "due": ({"sla_due_after": "1995-01-01", "sla_due_before": "1996-01-01", "created_before": "1995-12-20"}, "sla_due_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND cases.created_at <= TIMESTAMP '1995-12-20'"),
}


@query(
    f"WITH {CASES} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS asked, count(*) AS total, coalesce(sum(case_id), 0)::BIGINT AS ids FROM cases LEFT JOIN person l ON l.person_id = left_id LEFT JOIN person r ON r.person_id = right_id WHERE {sql.replace('case_id LIKE', 'CAST(case_id AS VARCHAR) LIKE')}"
        for name, (_, sql) in REVIEWED.items()
    )
)
def review_list_totals(v: Views):
    timed = lambda asked: {k: _time(x) if k.startswith(("sla", "created")) else x for k, x in asked.items()}
    one = lambda name, asked: case_rows(v, **timed(asked)).agg(F.count("*").alias("total"), F.coalesce(F.sum("case_id"), F.lit(0)).alias("ids")).select(F.lit(name).alias("asked"), "total", "ids")
    return reduce(lambda a, b: a.union(b), [one(name, asked) for name, (asked, _) in REVIEWED.items()])
