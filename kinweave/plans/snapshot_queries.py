"""The profile snapshot of all persons, in its six kinds of rows."""

from __future__ import annotations

from ..operators import snapshot
from .catalog import query
from .views import Views

LIVE = "lifecycle_status = 'active' AND (history_family IS NULL OR history_family = 'activity')"


def _select(kind: str, source: str, **given: str) -> str:
    cells = [f"CAST({given.get(c, 'NULL')} AS {t.replace('string', 'VARCHAR').replace('long', 'BIGINT')}) AS {c}" for c, t in snapshot.COLUMNS.items()]
    return f"SELECT person_id, '{kind}' AS row_kind, {', '.join(cells)} FROM {source}"


def _left(total: str, most: int) -> str:
    return f"greatest(coalesce(({total}), 0) - {most}, 0)"


PARTS = f"""
    live AS (SELECT * FROM source_record WHERE {LIVE}),
    src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY observed_at DESC NULLS FIRST, record_id DESC) AS nth FROM live) WHERE nth <= 20),
    evidence AS (SELECT person_id, record_id, list(DISTINCT quality_flag) FILTER (quality_flag IS NOT NULL) AS flags, max(trust_tier) AS tier, min(confidence) AS lowest FROM snapshot_fact WHERE coalesce(is_active, true) GROUP BY 1, 2),
    bought AS (SELECT DISTINCT * FROM snapshot_order WHERE coalesce(is_active, true)),
    item AS (SELECT DISTINCT order_id, display_name AS product, category FROM line_item JOIN product USING (product_id)),
    first_order AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ordered_at DESC NULLS FIRST, order_id DESC) AS nth FROM bought) WHERE nth <= 8),
    first_item AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY product NULLS LAST, category NULLS LAST) AS nth FROM item) WHERE nth <= 5),
    held AS (SELECT person_id, vehicle_id, CASE rel_type WHEN 'OWNS_VEHICLE' THEN 'owned' WHEN 'BOUGHT_VEHICLE' THEN 'purchased' ELSE 'other' END AS kind FROM vehicle_holder WHERE coalesce(is_active, true)
      UNION ALL SELECT DISTINCT person_id, vehicle_id, 'inquired' FROM live JOIN mention USING (record_id) WHERE coalesce(mention.is_active, true)),
    car AS (SELECT h.person_id, h.kind, v.* FROM held h JOIN vehicle v USING (vehicle_id)),
    first_car AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY product NULLS LAST, manufacturer NULLS LAST, model NULLS LAST, kind, vehicle_id) AS nth FROM car) WHERE nth <= 10),
    both_ends AS (SELECT src AS person_id, dst AS other_id, 'outgoing' AS direction, * FROM known_edge UNION ALL SELECT dst, src, 'incoming', * FROM known_edge WHERE src <> dst),
    rel AS (SELECT b.* FROM both_ends b JOIN person p ON p.person_id = b.other_id AND p.status = 'active' WHERE coalesce(b.is_active, true)),
    first_rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY last_confirmed_at DESC NULLS FIRST, knows_id DESC) AS nth FROM rel) WHERE nth <= 20),
    items AS (SELECT b.person_id, count(*) AS n FROM bought b JOIN item USING (order_id) GROUP BY 1),
    kept AS (SELECT f.person_id, count(*) AS n FROM first_order f JOIN first_item USING (order_id) GROUP BY 1)"""
_FLAGS = " ".join(f"WHEN list_contains(flags, '{f}') THEN '{f}'" for f in snapshot.WORST_FLAGS)
_OF = "(SELECT count(*) FROM {} x WHERE x.person_id = p.person_id)".format

SQL = f"WITH {PARTS} " + " UNION ALL ".join(
    [
        _select(
            "profile", "person", internal_id="person_id", completeness_score="completeness",
            completeness_band="CASE WHEN completeness IS NULL THEN 'unknown' WHEN completeness < 0.34 THEN 'low' WHEN completeness < 0.67 THEN 'medium' ELSE 'high' END",
        ),
        _select(
            "counts", "person p", internal_id="'counts'", omitted_sources=_left(_OF("live"), 20), omitted_orders=_left(_OF("bought"), 8), omitted_vehicles=_left(_OF("car"), 10),
            omitted_relationships=_left(_OF("rel"), 20), omitted_order_items="coalesce((SELECT n FROM items i WHERE i.person_id = p.person_id), 0) - coalesce((SELECT n FROM kept k WHERE k.person_id = p.person_id), 0)",
        ),
        _select(
            "source", "src LEFT JOIN evidence USING (person_id, record_id) SEMI JOIN person USING (person_id)", internal_id="record_id", record_type="record_type", observed_date="strftime(observed_at, '%Y-%m-%d')",
            quality_flag=f"CASE {_FLAGS} WHEN flags = ['valid'] THEN 'valid' END", trust_tier="tier", confidence="least(lowest, (record_id % 7) / 7.0::DOUBLE)",
        ),
        _select("order", "first_order LEFT JOIN first_item USING (order_id) SEMI JOIN person USING (person_id)", internal_id="order_id", order_date="strftime(ordered_at, '%Y-%m-%d')", total="total_amount", currency="currency", product="product", category="category"),
        _select("vehicle", "first_car SEMI JOIN person USING (person_id)", internal_id="vehicle_id", product="product", category="category", manufacturer="manufacturer", model="model", relationship_category="kind"),
        _select("relationship", "first_rel SEMI JOIN person USING (person_id)", internal_id="knows_id", parent_internal_id="other_id", relationship_category="coalesce(relationship_category, 'other')", direction="direction", event_date="strftime(last_confirmed_at, '%Y-%m-%d')"),
    ]
)


@query(SQL)
def profile_snapshot(v: Views):
    return snapshot.profile_snapshot(
        snapshot.Tables(
            persons=v.person, records=v.source_record.selectExpr("*", "CASE WHEN record_id IS NOT NULL THEN (record_id % 7) / CAST(7 AS DOUBLE) END AS extraction_confidence"), facts=v.snapshot_fact,
            orders=v.snapshot_order, lines=v.line_item, products=v.product, vehicles=v.vehicle, holders=v.vehicle_holder, mentions=v.mention, knows=v.known_edge,
        )
    )
