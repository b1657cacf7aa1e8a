"""The graph as tables over the driver's parquet files.

Definitions are SQL that Spark and DuckDB both read, so a query and its oracle see the same graph. {name} is another
view or a file. Groups that share a phone, an address or a vehicle have a fixed size, so nothing grows faster than the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession



def _json(text: str) -> str:
    """An SQL text of JSON, whose braces are written as ( and ): braces name views here."""
    return f"replace(replace('{text}', '(', chr(123)), ')', chr(125))"


FILES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "person": """
        SELECT c_custkey AS person_id, c_name AS preferred_full_name,
          CASE WHEN c_custkey > 0 AND (c_custkey % 29 = 0 OR c_custkey % 58 = 28) THEN 'merged' WHEN c_custkey % 31 = 5 THEN 'suppressed' ELSE 'active' END AS status,
          CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 25 = 7 THEN '+65' || CAST(89000000 + CAST(floor(c_custkey / 1500) AS BIGINT) AS STRING)
            ELSE '+65' || CAST(80000000 + CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) END AS preferred_phone,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'user' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) || '@example.org' END AS preferred_email,
          '19' || CAST(50 + c_custkey % 50 AS STRING) || '-' || CASE WHEN c_custkey % 12 < 9 THEN '0' ELSE '' END || CAST(1 + c_custkey % 12 AS STRING) || '-' || CAST(10 + c_custkey % 19 AS STRING) AS preferred_dob,
          CASE WHEN c_custkey % 5 = 0 THEN 'S' || CAST(1000000 + CAST(floor(c_custkey / 10) AS BIGINT) AS STRING) || 'A' END AS preferred_nric,
          c_acctbal > 8000 AS is_high_value, c_acctbal < 0 AS is_high_risk, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS entity_key,
          CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE (c_custkey % 6) / CAST(5 AS DOUBLE) END AS completeness, c_custkey * 60 AS created_at
        FROM {customer}""",
    "identified_by": """
        SELECT person_id, 'phone' AS identifier_type, preferred_phone AS normalized_value, person_id % 2 = 0 AS is_verified,
          CASE WHEN person_id % 11 = 0 THEN 'partial_parse' WHEN person_id % 19 = 0 THEN 'placeholder_value' ELSE 'valid' END AS quality_flag,
          CASE WHEN person_id % 7 = 0 THEN NULL ELSE person_id % 23 <> 0 END AS is_active, person_id % 10 AS source_key, person_id * 60 AS confirmed_at
        FROM {person} WHERE preferred_phone IS NOT NULL
        UNION ALL
        SELECT person_id, 'email', preferred_email, person_id % 3 = 0, 'valid', person_id % 21 <> 0, person_id % 10, person_id * 61 FROM {person} WHERE preferred_email IS NOT NULL
        UNION ALL
        SELECT person_id, 'nric', preferred_nric, true, CASE WHEN person_id % 35 = 0 THEN 'invalid_format' ELSE 'valid' END, true, person_id % 10, person_id * 62 FROM {person} WHERE preferred_nric IS NOT NULL""",
    "lives_at": """
        SELECT person_id, CAST(floor(person_id / 4) AS BIGINT) AS address_id, 'blk ' || CAST(CAST(floor(person_id / 4) AS BIGINT) AS STRING) || ', example street' AS normalized_full,
          CASE WHEN person_id % 6 = 0 THEN NULL ELSE person_id % 9 <> 0 END AS is_active, person_id % 2 = 1 AS is_verified, person_id * 63 AS confirmed_at
        FROM {person}""",
    "knows": """
        SELECT a.person_id AS src, b.person_id AS dst, CASE WHEN a.person_id % 5 = 0 THEN 'Father' WHEN a.person_id % 5 = 1 THEN 'old friend' WHEN a.person_id % 5 = 2 THEN 'colleague' ELSE 'neighbour' END AS label,
          CASE WHEN a.person_id % 8 = 0 THEN NULL ELSE a.person_id % 10 <> 0 END AS is_active
        FROM {person} a JOIN {person} b ON b.person_id = a.person_id + 1 + a.person_id % 3""",
    "merged_into": "SELECT person_id AS absorbed, person_id - 1 AS survivor FROM {person} WHERE status = 'merged'",
    "no_match_lock": "SELECT person_id AS a, person_id + 1 AS b, CASE WHEN person_id % 24 = 0 THEN 100 END AS expires_at FROM {person} WHERE segment = 'FURNITURE'",
    "entity": "SELECT n_nationkey AS entity_key, n_name AS display_name, r_name AS entity_type FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "source_system": "SELECT s_suppkey AS source_key, s_name AS source_name, s_nationkey AS entity_key FROM {supplier}",
    "source_record": """
        SELECT event_id AS record_id, user_id * 10 + event_id % 3 AS person_id,
          CASE event_type WHEN 'purchase' THEN 'crm_deal' WHEN 'view' THEN 'crm_history' WHEN 'click' THEN 'conversation' WHEN 'error' THEN 'call' ELSE 'identity' END AS record_type,
          event_id % 10 AS source_key, CAST(user_id AS STRING) || '-' || CAST(event_id % 5 AS STRING) AS source_record_id, ts AS observed_at,
          CASE WHEN event_id % 10 = 0 THEN 'superseded' WHEN event_id % 10 = 1 THEN 'pending_review' WHEN event_id % 10 = 2 THEN NULL ELSE 'active' END AS lifecycle_status,
          event_id % 20 = 2 AS is_latest, CASE WHEN event_id % 13 = 0 THEN 'stage' WHEN event_id % 3 = 0 THEN 'activity' END AS history_family,
          CASE WHEN event_id % 4 <> 0 THEN 'kind' || CAST(event_id % 4 AS STRING) END AS history_kind, CASE WHEN event_id % 3 = 0 THEN event_id % 25 END AS owner_entity_key,
          CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 37 <> 0 END AS link_active, 'S' || CAST(event_id % 7 AS STRING) AS stage_id,
          'h' || CAST(CAST(floor(event_id / 40) AS BIGINT) % 3 AS STRING) AS record_hash, value, props
        FROM {events}""",
    "fact": """
        SELECT person_id, CASE record_id % 4 WHEN 0 THEN 'full_name' WHEN 1 THEN 'dob' WHEN 2 THEN 'preferred_name' ELSE 'legal_name' END AS attribute_name,
          'v' || CAST(record_id % 11 AS STRING) AS attribute_value, CASE WHEN record_id % 5 = 0 THEN 'partial_parse' WHEN record_id % 17 = 0 THEN 'invalid_format' ELSE 'valid' END AS quality_flag,
          'tier_' || CAST(1 + record_id % 4 AS STRING) AS trust_tier, observed_at, record_id
        FROM {source_record}""",
    "sales_order": "SELECT o_orderkey AS order_id, o_custkey AS person_id, o_orderkey % 10 AS source_key, o_totalprice AS total_amount, o_orderstatus AS status, o_orderdate AS ordered_at, o_orderpriority AS priority FROM {orders}",
    "line_item": "SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_quantity AS quantity, l_extendedprice AS line_total, l_suppkey AS seller_key, l_shipdate AS shipped_at FROM {lineitem}",
    "product": "SELECT p_partkey AS product_id, p_name AS display_name, p_brand AS manufacturer, p_type AS category, p_size AS size, p_retailprice AS price FROM {part}",
    "vehicle_observation": """
        SELECT l_orderkey * 10 + l_linenumber AS observation_id, o_custkey AS person_id, l_suppkey % 10 AS source_key, 'K' || CAST(l_orderkey % 7 AS STRING) AS product_sku,
          CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN NULL WHEN l_orderkey % 90 = 0 THEN 'n/a' ELSE 'sg-t ' || CAST(CAST(floor(l_orderkey / 4) AS BIGINT) AS STRING) END AS lta_tag,
          CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN NULL ELSE ' sn' || CAST(CAST(floor(l_orderkey / 2) AS BIGINT) AS STRING) || '  x' END AS serial_number, l_shipdate AS observed_at
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "match_decision": """
        SELECT o_orderkey AS decision_id, o_custkey AS left_id, o_custkey + 1 AS right_id, (o_orderkey % 100) / CAST(100 AS DOUBLE) AS confidence,
          CASE WHEN o_orderkey % 100 >= 40 THEN 'merge' WHEN o_orderkey % 100 >= 20 THEN 'review' ELSE 'no_match' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN 'deterministic' ELSE 'heuristic' END AS engine
        FROM {orders}""",
    "review_case": """
        SELECT o_orderkey + 1 AS case_id, decision_id, CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'assigned' WHEN 2 THEN 'resolved' ELSE 'deferred' END AS queue_state,
          1 + o_orderkey % 3 AS priority, o_orderdate AS created_at, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 30 END AS sla_days, CASE WHEN o_orderkey % 4 = 1 THEN 'user' || CAST(o_orderkey % 6 AS STRING) END AS assigned_to
        FROM {orders} JOIN {match_decision} ON decision_id = o_orderkey WHERE decision = 'review'""",
    "merge_event": "SELECT person_id AS event_id, person_id AS absorbed, person_id - 1 AS survivor, CASE WHEN person_id % 87 = 0 THEN 'unmerge' WHEN person_id % 2 = 0 THEN 'auto_merge' ELSE 'manual_merge' END AS event_type, created_at FROM {person} WHERE status = 'merged'",
    "ingest_run": "SELECT event_id AS run_id, event_id % 10 AS source_key, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'running' ELSE 'completed' END AS status, ts AS started_at, CAST(floor(value) AS BIGINT) AS record_count FROM {events}",
    "stage_event": """
        SELECT user_id AS parent, event_id, CASE event_type WHEN 'purchase' THEN 'won' WHEN 'error' THEN 'lost' ELSE 'open' END AS mapped_state, ts AS event_at, event_id % 3 AS head_version,
          'C' || CAST(event_id % 3 AS STRING) AS category_id, 'S' || CAST(event_id % 7 AS STRING) AS stage_id
        FROM {events}""",
    "deal_version": """
        SELECT user_id AS parent, event_id AS version_key, event_id % 9 AS version, CASE event_id % 12 WHEN 0 THEN 'rejected' WHEN 4 THEN 'superseded' WHEN 8 THEN 'pending_review' ELSE 'active' END AS lifecycle_status, ts AS observed_at,
          CASE WHEN user_id % 20 = 3 AND event_id % 2 = 1 THEN 99 WHEN user_id % 20 = 4 THEN NULL ELSE user_id % 5 END AS entity_key, user_id % 23 <> 1 AS timestamps_valid,
          CASE WHEN event_id % 16 = 4 THEN NULL ELSE value END AS amount_value, CASE WHEN event_id % 16 = 4 THEN 'missing' ELSE 'known' END AS amount_state,
          CASE WHEN user_id % 19 = 2 THEN 'unsupported' WHEN user_id % 19 = 7 THEN 'invalid' ELSE 'supported' END AS currency_status, user_id * 10 AS linked_person_id, 1 + event_id % 2 AS contact_count
        FROM {events}""",
}

_TEXT = "CAST({} AS STRING)".format
VIEWS |= {
    "deal_payload": f"""
        SELECT event_id AS record_id, user_id AS person_id, CASE event_id % 24 WHEN 0 THEN NULL WHEN 1 THEN 'no json' WHEN 2 THEN '[1]' WHEN 3 THEN {_json('("amount": 0, "currency": "sgd")')}
          WHEN 4 THEN {_json('("amount": "1,000", "currency": "EUR")')} WHEN 5 THEN {_json('("amount": "12.5", "currency_id": " usd ")')} WHEN 6 THEN {_json('("amount": true, "currency": 5)')}
          WHEN 7 THEN {_json('("amount": null, "opportunity": 7, "currency": "")')} WHEN 8 THEN {_json('("deal": ("OPPORTUNITY": 99.25, "CURRENCY_ID": "MYR", "ASSIGNED_BY_ID": 7, "CONTACT_IDS": ["1", 2, " ", null]))')}
          WHEN 9 THEN {_json('("opportunity": -5, "CONTACT_ID": "0", "assigned_by_id": "0")')} WHEN 10 THEN {_json('("amount": " 3e2 ", "ASSIGNED_BY_ID": "u1", "CONTACT_ID": 4)')}
          WHEN 11 THEN {_json('("amount": [1], "currency": "12A", "assigned_by_id": false)')}
          ELSE {_json('("amount": ')} || {_TEXT("event_id")} || {_json(', "currency": "SGD", "CONTACT_IDS": ["7"])')} END AS payload
        FROM {{events}}""",
    "loyalty_record": f"""
        SELECT event_id AS record_id, user_id * 10 + event_id % 2 AS person_id, event_id % 3 AS source_key, ts AS observed_at, CASE event_id % 7 WHEN 0 THEN 'none' WHEN 1 THEN {_json('("loyalty": 5)')}
          WHEN 2 THEN {_json('("loyalty": ("points": "many", "disable_loyalty": true))')}
          ELSE {_json('("loyalty": ("points": ')} || {_TEXT("event_id % 1000")} || {_json(', "disable_loyalty": false, "current_spend_for_points": 12.5, "current_sales_for_discount": 3))')} END AS payload
        FROM {{events}}""",
    "sales_envelope": f"""
        SELECT o_orderkey AS order_id, CASE o_orderkey % 12 WHEN 0 THEN 'no json' WHEN 1 THEN {_json('("order": [])')} WHEN 2 THEN {_json('("order": ("source_order_id": " "))')}
          WHEN 3 THEN {_json('("order": ("source_order_id": "a"), "line_items": 5)')} WHEN 4 THEN {_json('("order": ("source_order_id": "a"), "line_items": [7])')}
          WHEN 5 THEN {_json('("order": ("source_order_id": "a"), "line_items": [("source_line_item_id": "1", "product": ("source_product_id": "p")), ("source_line_item_id": "")])')}
          WHEN 6 THEN {_json('("order": ("source_order_id": "a"), "line_items": [("source_line_item_id": "1", "product": 3)])')}
          WHEN 7 THEN {_json('("order": ("source_order_id": "a"), "line_items": [("source_line_item_id": "1", "product": ("source_product_id": 9))])')}
          WHEN 8 THEN {_json('("order": ("source_order_id": "a"), "line_items": null)')} WHEN 9 THEN {_json('("order": ("source_order_id": 4))')}
          ELSE {_json('("order": ("source_order_id": "')} || {_TEXT("o_orderkey")} || {_json('"), "line_items": [("source_line_item_id": "1", "product": ("source_product_id": "p"))])')} END AS payload
        FROM {{orders}}""",
    "waiting_sale": """
        SELECT o_orderkey AS sale_id, CAST(floor(o_custkey / 4) AS BIGINT) AS vehicle_id, CASE WHEN o_orderkey % 3 = 0 THEN 'S' || CAST(1000000 + CAST(floor(o_custkey / 10) AS BIGINT) AS STRING) || 'A' WHEN o_orderkey % 3 = 1 THEN 'S0000000Z' END AS nric,
          'user' || CAST(CAST(floor(o_custkey / 2) AS BIGINT) AS STRING) || '@example.org' AS email, '+65' || CAST(80000000 + CAST(floor(o_custkey / 3) AS BIGINT) AS STRING) AS phone
        FROM {orders} WHERE o_orderstatus <> 'F'""",
    "vehicle_holder": """
        SELECT person_id, CAST(floor(person_id / 4) AS BIGINT) AS vehicle_id, CASE WHEN person_id % 3 = 0 THEN 'OWNS_VEHICLE' ELSE 'BOUGHT_VEHICLE' END AS rel_type, CASE WHEN person_id % 11 <> 0 THEN person_id % 5 <> 0 END AS is_active,
          CAST(floor(person_id / 4) AS BIGINT) % 6 = 0 AS conflict_flag, CASE WHEN person_id % 7 = 0 THEN NULL WHEN person_id % 2 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_confirmed_at
        FROM {person}""",
    "known_event": """
        SELECT user_id AS parent, event_id, CASE event_type WHEN 'purchase' THEN 'won' WHEN 'error' THEN 'lost' ELSE 'open' END AS mapped_state, ts AS event_at, event_id % 3 AS head_version, user_id % 29 <> 1 AS valid,
          ts + CASE event_id % 4 WHEN 0 THEN INTERVAL 30 HOUR WHEN 1 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END AS available_at
        FROM {events}""",
    "known_version": """
        SELECT user_id AS parent, event_id AS version_key, ts AS observed_at, ts + INTERVAL 1 HOUR AS ingested_at, CASE WHEN event_id % 31 <> 0 THEN ts + INTERVAL 2 HOUR END AS activated_at,
          CASE WHEN event_id % 17 <> 0 THEN lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS superseded_at, CASE WHEN event_id % 19 = 0 THEN ts + INTERVAL 5 HOUR END AS rejected_at, CAST(NULL AS TIMESTAMP) AS link_failed_at,
          user_id % 23 <> 1 AS timestamps_valid, CASE WHEN user_id % 20 = 4 THEN NULL ELSE user_id % 5 END AS entity_key, CASE WHEN user_id % 19 = 2 THEN 'unsupported' WHEN user_id % 19 = 7 THEN 'invalid' ELSE 'supported' END AS currency_status,
          CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS linked_persons, 1 AS active_persons, ts + INTERVAL 1 HOUR AS linked_at
        FROM {events}""",
    "contact_record": """
        SELECT event_id AS record_id, event_id % 4 AS source_key, CAST(user_id AS STRING) AS declarer_id, CAST(user_id + event_id % 5 - 2 AS STRING) AS contact_id,
          CASE event_id % 9 WHEN 0 THEN 'Spouse' WHEN 1 THEN 'Next of Kin' WHEN 2 THEN 'a Referral' WHEN 3 THEN 'half-brother' WHEN 4 THEN 'friend' WHEN 5 THEN '' ELSE 'knows' END AS label
        FROM {events}""",
    "source_link": "SELECT DISTINCT event_id % 4 AS source_key, CAST(user_id AS STRING) AS source_record_id, user_id AS person_id FROM {events} WHERE user_id % 6 <> 0",
}

VIEWS |= {
    # households of eight whose members share phones and mail addresses and hold different government ids; a tenth of them share one phone
    "new_record": """
        SELECT c_custkey AS record_id, CAST(floor(c_custkey / 8) AS BIGINT) AS home, c_custkey % 8 AS member,
          CASE WHEN c_custkey % 8 IN (0, 1, 2, 3, 7) THEN '1980-01-01' WHEN c_custkey % 8 IN (4, 5) THEN '1990-02-02' END AS dob,
          CASE WHEN c_custkey % 8 = 5 THEN 'Zoltan Quist' WHEN c_custkey % 2 = 0 THEN 'Anna Lim' ELSE 'Ana Lim' END AS name,
          CASE WHEN c_custkey % 8 <> 3 THEN CAST(floor(c_custkey / 8) AS BIGINT) END AS address_id
        FROM {customer}""",
    "new_identifier": """
        SELECT record_id, 'phone' AS identifier_type, CASE WHEN home % 10 = 0 THEN '+6599999999' WHEN member = 6 THEN '+65' || CAST(80000001 + home * 10 AS STRING) ELSE '+65' || CAST(80000000 + home * 10 AS STRING) END AS normalized_value,
          member % 2 = 0 AS is_verified, 'valid' AS quality_flag, 2 AS position
        FROM {new_record} WHERE member < 7
        UNION ALL
        SELECT record_id, 'email', 'household' || CAST(home AS STRING) || 'x' || CAST(CAST(floor(member / 2) AS BIGINT) AS STRING) || CASE WHEN member = 7 THEN '@gmial.com' ELSE '@gmail.com' END,
          member < 4, CASE WHEN home % 7 = 5 THEN 'placeholder_value' ELSE 'valid' END, 3
        FROM {new_record}
        UNION ALL
        SELECT record_id, 'nric', 'S' || CAST(1000000 + home AS STRING) || CASE WHEN member = 3 THEN 'B' ELSE 'A' END, true, 'valid', 1
        FROM {new_record} WHERE member IN (0, 3) OR (member = 4 AND home % 3 = 0)""",
}

VIEWS |= {
    # one phone that a fifth of all persons hold, another that a seventh hold, and the identifiers that they have besides
    "crowded_identifier": """
        SELECT person_id, identifier_type, normalized_value, is_active FROM {identified_by}
        UNION ALL SELECT person_id, 'phone', '+6560000001', true FROM {person} WHERE person_id % 5 = 0
        UNION ALL SELECT person_id, 'phone', '+6560000002', person_id % 49 <> 0 FROM {person} WHERE person_id % 7 = 0""",
}

VIEWS |= {
    "address": """
        SELECT CAST(floor(c_custkey / 4) AS BIGINT) AS address_id, min(c_mktsegment) || ' Road' AS street_name, '#' || CAST(min(c_custkey % 30) AS STRING) AS unit_number, max(n_name) AS city,
          CAST(100000 + CAST(floor(min(c_custkey) / 4) AS BIGINT) AS STRING) AS postal_code, min(r_name) AS country_code
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY CAST(floor(c_custkey / 4) AS BIGINT)""",
    # every tenth person has a second address, that of the next household
    "residence": """
        SELECT person_id, address_id, is_active FROM {lives_at}
        UNION ALL SELECT person_id, address_id + 1, CASE WHEN person_id % 20 = 3 THEN true ELSE person_id % 3 = 0 END FROM {lives_at} WHERE person_id % 10 = 3""",
    "listed_person": """
        SELECT p.*, o.updated_at, d.crm_deal_count, CASE WHEN p.person_id % 14 <> 0 THEN CAST(floor(p.person_id / 4) AS BIGINT) END AS preferred_address_id
        FROM {person} p LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS updated_at FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = p.person_id
          LEFT JOIN (SELECT person_id, count(*) AS crm_deal_count FROM {source_record} WHERE record_type = 'crm_deal' GROUP BY person_id) d ON d.person_id = p.person_id""",
    "bankruptcy_edge": """
        SELECT c_custkey AS person_id, o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_active
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE c_acctbal < 0""",
    "involved_record": """
        SELECT decision_id, record_id, lifecycle_status, is_latest FROM {match_decision} JOIN {source_record} ON record_id = decision_id WHERE engine = 'deterministic'""",
}

VIEWS |= {
    # several facts a record, with flags and tiers of their own; a third have no confidence, some are withdrawn
    "snapshot_fact": """
        SELECT person_id, record_id, CASE (record_id + k) % 9 WHEN 0 THEN 'stale' WHEN 1 THEN 'source_untrusted' WHEN 2 THEN 'odd' WHEN 3 THEN NULL WHEN 4 THEN 'shared_suspected' ELSE 'valid' END AS quality_flag,
          CASE WHEN record_id % 8 <> 7 THEN 'tier_' || CAST(1 + (record_id + 3 * k) % 4 AS STRING) END AS trust_tier, CASE WHEN (record_id + k) % 3 <> 0 THEN (record_id % 11 + k) / CAST(20 AS DOUBLE) END AS confidence,
          CASE WHEN record_id % 6 = 0 THEN NULL ELSE (record_id + k) % 5 <> 0 END AS is_active
        FROM {source_record} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t WHERE record_id % 10 >= k * 3""",
    "snapshot_order": """
        SELECT o_orderkey AS order_id, o_custkey AS person_id, CASE WHEN o_orderkey % 41 <> 0 THEN o_orderdate END AS ordered_at, o_totalprice AS total_amount, CASE WHEN o_orderkey % 5 <> 0 THEN 'SGD' END AS currency,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 13 <> 1 END AS is_active
        FROM {orders}""",
    "vehicle": """
        SELECT p_partkey AS vehicle_id, CASE WHEN p_partkey % 15 <> 0 THEN p_name END AS product, p_type AS category, p_brand AS manufacturer, CASE WHEN p_partkey % 4 <> 0 THEN 'M' || CAST(p_size AS STRING) END AS model
        FROM {part}""",
    "mention": "SELECT record_id, CAST(floor(person_id / 3) AS BIGINT) + record_id % 6 AS vehicle_id, CASE WHEN record_id % 5 <> 0 THEN record_id % 7 <> 0 END AS is_active FROM {source_record} WHERE record_type IN ('conversation', 'crm_deal')",
    # what is said of the same two persons again has an id of its own; those who order much know many
    "known_edge": """
        SELECT 'k' || CAST(src AS STRING) || '-' || CAST(dst AS STRING) AS knows_id, src, dst, CASE label WHEN 'Father' THEN 'family' WHEN 'old friend' THEN 'friend' END AS relationship_category,
          CASE WHEN src % 9 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS last_confirmed_at, is_active FROM {knows}
        UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), o_custkey, CAST(floor(o_custkey / 5) AS BIGINT) * 5, 'colleague', o_orderdate, o_orderkey % 12 <> 5 FROM {orders}""",
}

NAME = re.compile(r"\{(\w+)\}")


class Views:
    """Views and files by name, as frames of one session over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.sql(VIEWS[name])
            elif name in FILES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str, **args) -> DataFrame:
        """A statement over {views}."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(NAME.findall(text))}, args=args or None)


def oracle(body: str) -> str:
    """A DuckDB statement over the views that body names, which come first as common tables."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(body)
    parts = [f"{n} AS ({NAME.sub(lambda m: m[1], VIEWS[n]).strip()})" for n in order]
    body = body.strip()
    if not parts:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[14:]
    return "WITH " + ",\n".join(parts) + (",\n" + body[4:] if body[:4].upper() == "WITH" else "\n" + body)
