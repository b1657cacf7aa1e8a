"""The person list, the person page and the review list: filters, sorts, pages, metrics, and persons met through very common things."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators import hot, review
from kinweave.operators import listing as ls

NOW = "2024-01-01 00:00:00"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def tables(spark):
    persons = [
        (1, "active", "Ann", "p1", None, "1980-01-01", None, True, False, 0.5, 3, 10, "2024-01-01"),
        (2, "active", "Bob", None, None, None, None, False, False, None, None, None, None),
        (3, "merged", "Cy", "p1", "c@x.y", "1990-05-05", None, False, True, 0.9, 0, 11, "2023-01-01"),
        (4, "active", None, None, "d@x.y", "1985-01-02", "S1", None, None, 0.5, 1, 11, "2022-01-01"),
    ]
    schema = "person_id long, status string, preferred_full_name string, preferred_phone string, preferred_email string, preferred_dob string, preferred_nric string, is_high_value boolean, is_high_risk boolean, completeness double, crm_deal_count int, preferred_address_id long, updated_at string"
    empty = lambda s: spark.createDataFrame([], s)
    return ls.Tables(
        persons=frame(spark, persons, schema).withColumn("updated_at", F.to_timestamp("updated_at")),
        records=empty("record_id long, person_id long, record_type string, source_key long, lifecycle_status string, is_latest boolean, history_family string, owner_entity_key long, link_active boolean"),
        systems=empty("source_key long, entity_key long"),
        identified_by=frame(
            spark,
            [(1, "phone", "p1", None, "partial_parse"), (1, "phone", "p1", True, "valid"), (2, "phone", "p1", True, "valid"), (3, "phone", "p1", True, "valid"), (4, "phone", "p1", False, "valid"), (2, "email", "p1", True, "odd"), (4, "email", None, True, "valid"), (2, "email", None, True, "valid")],
            "person_id long, identifier_type string, normalized_value string, is_active boolean, quality_flag string",
        ),
        lives_at=frame(spark, [(1, 10, None), (2, 10, False), (4, 11, True), (1, 11, True)], "person_id long, address_id long, is_active boolean"),
        addresses=frame(spark, [(10, "High Road", "#1", "Town", "111", "SG"), (11, "Low Road", "#2", None, "222", "MY")], "address_id long, street_name string, unit_number string, city string, postal_code string, country_code string"),
        knows=frame(spark, [(1, 2, True), (2, 1, None), (4, 4, True), (3, 4, True), (2, 4, False)], "src long, dst long, is_active boolean"),
        orders=frame(spark, [(1, 5.0), (1, 7.0)], "person_id long, total_amount double"),
        bankruptcies=frame(spark, [(1, 1, True), (2, 2, False)], "person_id long, case_id long, is_active boolean"),
        decisions=frame(spark, [(1, 1, 4), (2, 4, 9), (3, 1, 4)], "decision_id long, left_id long, right_id long"),
        cases=frame(spark, [(1, "open"), (1, "resolved"), (2, "open"), (3, "cancelled")], "decision_id long, queue_state string"),
    )


def ids(rows):
    return sorted(r["person_id"] for r in rows.collect())


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ({}, [1, 2, 4]),
        ({"is_high_value": None}, [1, 2, 4]),
        ({"is_high_value": False}, [2]),
        ({"has_any_contact": True}, [1, 4]),
        ({"has_any_contact": False}, [2]),
        ({"addr_street": "ROAD", "addr_city": "town"}, [1]),
        ({"addr_street": "low", "addr_city": "town"}, []),  # both must hold for one address
        ({"addr_country": "m"}, [1, 4]),
        ({"dob_from": "1980-01-01", "dob_to": "1985-01-01"}, [1]),
        ({"has_address": False}, [2]),
        ({"has_bankruptcy_case": False}, [2, 4]),
        ({"has_possible_match": True}, [1, 2]),  # an identifier without a value is shared by none
        ({"has_system_match": True}, [1, 4]),  # decision 2 is about an id that is no person
        ({"has_any_match": False}, []),
        ({"crm_deal_count_min": 1, "crm_deal_count_max": 2}, [4]),
        ({"entity_keys": [1]}, []),
        ({"source_record_type": "call"}, []),
    ],
)
def test_filters(tables, asked, want):
    assert ids(ls.matching(tables, **asked)) == want


def test_unknown_filters_and_sorts_are_refused(tables):
    with pytest.raises(ValueError):
        ls.matching(tables, has_boat=True)
    with pytest.raises(ValueError):
        ls.page(tables, "status")


def test_totals_count_what_the_list_pages_through(tables):
    assert ls.total(tables).first()["total"] == 2  # a list by completeness holds those that have one
    assert ls.total(tables, "preferred_full_name").first()["total"] == 3


@pytest.mark.parametrize(
    ("sort", "descending", "want"),
    [("completeness", True, [1, 4]), ("preferred_full_name", False, [1, 2, 4]), ("preferred_full_name", True, [4, 2, 1]), ("order_count", True, [1, 2, 4]), ("connection_count", False, [2, 4, 1]), ("phone_confidence", True, [2, 4, 1])],
)
def test_pages_are_in_order_with_ties_by_id(tables, sort, descending, want):
    got = sorted(ls.page(tables, sort, descending, 0, 10).collect(), key=lambda r: r["place"])
    assert [r["person_id"] for r in got] == want and [r["place"] for r in got] == list(range(1, len(want) + 1))


def test_metrics_of_a_page(tables):
    got = {r["person_id"]: r for r in ls.page(tables, "preferred_full_name", False, 0, 10).collect()}
    names = ["identifier_count", "connection_count", "possible_match_count", "system_match_count", "order_count", "bankruptcy_case_count", "phone_confidence", "entities"]
    assert [got[1][n] for n in names] == [2, 2, 1, 1, 2, 1, 1.0, None]
    assert [got[2][n] for n in names] == [3, 1, 1, 0, 0, 0, None, None]
    assert [got[4][n] for n in names] == [1, 1, 0, 1, 0, 0, None, None]
    assert got[1]["city"] == "Town" and got[2]["street_name"] is None


def test_the_page_of_a_merged_person_is_that_of_whom_they_became(spark, tables):
    merges = frame(spark, [(3, 1)], "absorbed long, survivor long")
    asked = frame(spark, [(3,), (2,), (77,), (3,)], "person_id long")
    got = {r["asked_id"]: r for r in ls.details(tables, merges, asked).collect()}
    assert set(got) == {2, 3} and got[3]["person_id"] == 1 and got[3]["lifetime_value"] == 12.0 and got[2]["lifetime_value"] == 0.0
    assert got[3]["connection_count"] == 2 and got[2]["connection_count"] == 1
    every = {r["asked_id"]: r["connection_count"] for r in ls.details(tables, merges).collect()}
    assert every[3] == 2 and every[2] == 1 and set(every) == {1, 2, 3, 4}


def test_empty_tables(spark, tables):
    none = ls.Tables(**{k: getattr(tables, k).limit(0) for k in ls.Tables.__dataclass_fields__})
    assert ls.page(none, "possible_match_count").count() == 0 and ls.total(none).first()["total"] == 0
    assert ls.details(none, frame(spark, [], "absorbed long, survivor long")).count() == 0


def test_a_page_counts_others_as_the_whole_does(spark):
    r = random.Random(9)
    edges = [(p, "phone" if t % 2 else "email", f"h{t}" if t != 5 else None, r.choice([True, None, False])) for p in range(120) for t in range(30) if r.random() < (0.5 if t < 4 else 0.04)]
    merged = {p for p in range(120) if p % 7 == 0}
    live, want = {(p, k, v) for p, k, v, active in edges if active is not False}, defaultdict(set)
    for p, k, v in live:
        want[p] |= {q for q, a, b in live if v is not None and (a, b) == (k, v) and q != p and q not in merged}
    things = frame(spark, edges, "person_id long, kind string, thing string, is_active boolean")
    persons = frame(spark, [(p, "merged" if p in merged else "active") for p in range(120)], "person_id long, status string")
    page = frame(spark, [(p,) for p in (0, 3, 7, 8, 50, 119, 500)], "person_id long")
    got = {x["person_id"]: x["others"] for x in hot.others_of(page, things, ["kind", "thing"], persons).collect()}
    assert got == {p: len(want[p]) for p in (0, 3, 7, 8, 50, 119) if want[p]}


def test_a_page_makes_no_pairs_of_a_common_thing(spark):
    things = spark.range(20000).select(F.col("id").alias("person_id"), F.lit("phone").alias("kind"), F.lit("one").alias("thing"), F.lit(True).alias("is_active"))
    persons = spark.range(20000).select(F.col("id").alias("person_id"), F.lit("active").alias("status"))
    page = persons.where("person_id < 50").select("person_id")
    counted = hot.others_of(page, things, ["kind", "thing"], persons)
    assert counted.where("others = 19999").count() == 50


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        (1, 1, "open", 1, "2023-12-01", 5, "Zed", 1, 4, 0.4, "review", "heuristic"),
        (2, 2, "resolved", 2, "2023-12-02", None, None, 4, 9, 0.2, "review", "deterministic"),
        (3, 3, "assigned", 1, "2023-12-30", 50, "amy", None, 2, 0.3, "merge", "heuristic"),
        (4, 4, "open", 3, "2023-11-01", 1, None, 2, 1, 0.4, "review", "heuristic"),
    ]
    df = frame(spark, rows, "case_id long, decision_id long, queue_state string, priority int, created_at string, sla_days int, assigned_to string, left_id long, right_id long, confidence double, decision string, engine string")
    df = df.withColumn("created_at", F.to_timestamp("created_at"))
    one = ["case_id", "decision_id", "queue_state", "priority", "created_at", "sla_days", "assigned_to"]
    return df.select(*one), df.select("decision_id", "left_id", "right_id", "confidence", "decision", "engine")


def involved(spark, rows=()):
    return frame(spark, list(rows), "decision_id long, lifecycle_status string, is_latest boolean")


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ({}, [1, 2, 3, 4]),
        ({"q": "ZED"}, [1]),
        ({"q": "ann"}, [1, 4]),
        ({"q": "C@X"}, []),
        ({"q": "d@x"}, [1, 2]),
        ({"q": "merge"}, [3]),
        ({"q": "%"}, []),
        ({"person_id": 9}, []),  # the other side of decision 2 is no person
        ({"person_id": 2}, [3, 4]),
        ({"resolved": False, "engine": "heuristic", "confidence_gte": 0.4}, [1, 4]),
        ({"priority_lte": 2, "priority_gte": 2}, [2]),
        ({"assigned_to": "amy", "decision": "merge", "queue_state": "assigned", "confidence_lte": 0.3}, [3]),
        ({"overdue_at": NOW}, [1, 4]),
        ({"created_after": "2023-12-01", "created_before": "2023-12-05"}, [1, 2]),
        ({"sla_due_after": "2023-12-06", "sla_due_before": "2023-12-07"}, [1]),
    ],
)
def test_review_filters_and_search(spark, tables, cases, asked, want):
    timed = {k: F.to_timestamp(F.lit(v)) if k.startswith(("created", "sla", "overdue")) else v for k, v in asked.items()}
    got = review.listed(*cases, tables.persons, involved(spark), **timed)
    assert sorted(r["case_id"] for r in got.collect()) == want


def test_cases_whose_records_no_longer_wait_are_not_listed(spark, tables, cases):
    seen = involved(spark, [(1, "pending_review", None), (2, None, True), (3, None, None), (4, "pending_review", None), (4, "active", True)])
    assert sorted(r["case_id"] for r in review.listed(*cases, tables.persons, seen).collect()) == [1, 2]
    with pytest.raises(ValueError):
        review.listed(*cases, tables.persons, seen, colour="red")


@pytest.mark.parametrize(("sort", "want"), [(None, [1, 3, 2, 4]), ("confidence", [4, 1, 3, 2]), ("nonsense", [1, 3, 2, 4]), ("created_at", [3, 2, 1, 4])])
def test_review_pages(spark, tables, cases, sort, want):
    got = sorted(review.list_page(review.listed(*cases, tables.persons, involved(spark)), tables.persons, sort).collect(), key=lambda r: r["place"])
    assert [r["case_id"] for r in got] == want
    names = {r["case_id"]: (r["left_preferred_full_name"], r["right_status"]) for r in got}
    assert names[1] == ("Ann", "active") and names[2] == (None, None) and names[3] == (None, "active")
