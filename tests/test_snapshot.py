"""The profile snapshot: what is kept, what is counted as left out, and the worst of several flags."""

import pytest
from pyspark.sql import functions as F

from kinweave.operators import snapshot


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    records = [(i, 1, "call", f"2024-01-{1 + i:02d}", "active", None, 0.5) for i in range(25)] + [(90, 1, "call", "2024-03-01", None, None, 0.1), (91, 1, "call", None, "active", "stage", 0.1), (92, 9, "call", None, "active", None, None)]
    at = lambda df, c: df.withColumn(c, F.to_timestamp(c))
    return snapshot.Tables(
        persons=make([(1, "active", 0.34), (2, "active", None), (3, "merged", 0.9)], "person_id long, status string, completeness double"),
        records=at(make(records, "record_id long, person_id long, record_type string, observed_at string, lifecycle_status string, history_family string, extraction_confidence double"), "observed_at"),
        facts=make(
            [(1, 24, "valid", "tier_1", 0.9, True), (1, 24, "stale", "tier_3", 0.2, None), (1, 24, "source_untrusted", "tier_4", 0.0, False), (1, 23, "valid", None, None, True), (1, 22, "odd", "tier_9", None, True), (1, 22, "valid", None, None, True)],
            "person_id long, record_id long, quality_flag string, trust_tier string, confidence double, is_active boolean",
        ),
        orders=at(make([(i, 1, None if i == 3 else f"2024-02-{i:02d}", 1.0 * i, "SGD", i != 9) for i in range(1, 11)], "order_id long, person_id long, ordered_at string, total_amount double, currency string, is_active boolean"), "ordered_at"),
        lines=make([(10, p) for p in range(7)] + [(10, 0), (2, 1), (1, 1), (1, 2), (9, 1)], "order_id long, product_id long"),
        products=make([(p, f"p{p}" if p else None, "c") for p in range(7)], "product_id long, display_name string, category string"),
        vehicles=make([(v, None if v == 1 else f"v{v}", "c", "m", None) for v in range(1, 14)], "vehicle_id long, product string, category string, manufacturer string, model string"),
        holders=make([(1, v, "OWNS_VEHICLE", True) for v in range(1, 11)] + [(1, 1, "BOUGHT_VEHICLE", None), (1, 2, "LENT_VEHICLE", True), (1, 3, "BOUGHT_VEHICLE", False)], "person_id long, vehicle_id long, rel_type string, is_active boolean"),
        mentions=make([(0, 13, True), (1, 13, None), (90, 12, True), (2, 12, False)], "record_id long, vehicle_id long, is_active boolean"),
        knows=at(make([("a", 1, 2, "family", "2024-01-01", True), ("b", 2, 1, None, None, None), ("c", 1, 3, "friend", None, True), ("d", 1, 1, "self", "2023-01-01", True), ("e", 1, 2, "x", None, False)], "knows_id string, src long, dst long, relationship_category string, last_confirmed_at string, is_active boolean"), "last_confirmed_at"),
    )


def test_branches(spark, tables):
    rows = [r for r in snapshot.profile_snapshot(tables).collect()]
    of = lambda p, kind: [r for r in rows if r["person_id"] == p and r["row_kind"] == kind]
    assert {r["person_id"] for r in rows} == {1, 2, 3}
    assert [(of(p, "profile")[0]["completeness_band"]) for p in (1, 2, 3)] == ["medium", "unknown", "high"]
    counts = of(1, "counts")[0]
    assert [counts[f"omitted_{k}"] for k in snapshot.KEPT] == [5, 1, 4, 3, 0]  # nine orders; of items, two of order 10 and two of order 1
    assert [of(2, "counts")[0][f"omitted_{k}"] for k in snapshot.KEPT] == [0, 0, 0, 0, 0]

    sources = {r["internal_id"]: r for r in of(1, "source")}
    assert set(sources) == {str(i) for i in range(5, 25)}
    assert (sources["24"]["quality_flag"], sources["24"]["trust_tier"], sources["24"]["confidence"]) == ("stale", "tier_3", 0.2)
    assert (sources["23"]["quality_flag"], sources["23"]["confidence"]) == ("valid", 0.5) and sources["22"]["quality_flag"] is None and sources["22"]["trust_tier"] is None

    orders = of(1, "order")
    assert {r["internal_id"] for r in orders} == {"3", "10", "8", "7", "6", "5", "4", "2"}  # an order without a day comes first, so order 1 is cut
    assert [r["product"] for r in sorted((r for r in orders if r["internal_id"] == "10"), key=lambda r: r["product"])] == ["p1", "p2", "p3", "p4", "p5"]
    assert [r["product"] for r in orders if r["internal_id"] == "3"] == [None] and [r["order_date"] for r in orders if r["internal_id"] == "3"] == [None]

    vehicles = sorted((r["product"] or "~", r["relationship_category"]) for r in of(1, "vehicle"))
    assert len(vehicles) == 10 and ("v13", "inquired") in vehicles and ("v2", "other") in vehicles and ("~", "owned") not in vehicles
    known = {(r["internal_id"], r["direction"], r["relationship_category"], r["event_date"]) for r in of(1, "relationship")}
    assert known == {("a", "outgoing", "family", "2024-01-01"), ("b", "incoming", "other", None), ("d", "outgoing", "self", "2023-01-01")}


def test_only_those_asked_for_and_empty_tables(spark, tables):
    asked = spark.createDataFrame([(2,), (2,), (77,)], "person_id long")
    got = snapshot.profile_snapshot(tables, asked).collect()
    assert {r["person_id"] for r in got} == {2} and sorted(r["row_kind"] for r in got) == ["counts", "profile", "relationship", "relationship"]
    none = snapshot.Tables(**{k: getattr(tables, k).limit(0) for k in snapshot.Tables.__dataclass_fields__})
    assert snapshot.profile_snapshot(none).count() == 0


def test_the_first_few_are_cut_before_the_shuffle(spark, tables):
    plan = snapshot.profile_snapshot(tables)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
