"""Records of a batch resolved among themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import batch as bt

IDENTIFIERS = "record_id long, identifier_type string, normalized_value string, is_verified boolean, quality_flag string, position int"
RECORDS = "record_id long, record_type string, dob string, names array<string>, address_id long"
EDGES = "person_id long, identifier_type string, normalized_value string, is_verified boolean, quality_flag string, is_active boolean"


def clusters(spark, records, identifiers, forbidden=None):
    frame = spark.createDataFrame([(r, "identity", dob, names, home) for r, dob, names, home in records], RECORDS)
    own = spark.createDataFrame([(r, k, v, ok, q, {"S2B": 2}.get(v, {"nric": 1, "phone": 3, "email": 4}[k])) for r, k, v, ok, q in identifiers], IDENTIFIERS)
    apart = None if forbidden is None else spark.createDataFrame(forbidden, "a long, b long")
    return {r["record_id"]: r["cluster"] for r in bt.batch_clusters(own, frame, spark.createDataFrame([], EDGES), apart).collect()}


def phone(r, value="+6581234567", ok=True, q="valid"):
    return (r, "phone", value, ok, q)


def nric(r, value, q="valid"):
    return (r, "nric", value, True, q)


ANNA = ("1980-01-01", ["Anna Lim"], 5)


def test_one_phone_and_different_government_ids_are_two_persons(spark):
    assert clusters(spark, [(1, *ANNA), (2, *ANNA)], [phone(1), phone(2), nric(1, "S1A"), nric(2, "S2B")]) == {1: 1, 2: 2}


def test_one_government_id_is_one_person_whatever_else(spark):
    assert clusters(spark, [(1, "1980-01-01", ["Anna"], 1), (2, "1999-09-09", ["Zoltan Q"], 2)], [nric(1, "S1A"), nric(2, "S1A")]) == {1: 1, 2: 1}


def test_an_unverified_phone_alone_is_not_enough(spark):
    assert clusters(spark, [(1, None, None, None), (2, None, None, None)], [phone(1, ok=False), phone(2)]) == {1: 1, 2: 2}


def test_ids_of_bad_quality_neither_join_nor_part(spark):
    got = clusters(spark, [(1, *ANNA), (2, *ANNA)], [phone(1), phone(2), nric(1, "S1A", "invalid_format"), nric(2, "S2B")])
    assert got == {1: 1, 2: 1}


def test_a_record_between_two_ids_goes_to_the_stronger_link(spark):
    """2 has no id: it shares a verified phone and the address with 1, and with 3 an unverified phone."""
    records = [(1, "1980-01-01", ["Anna Lim"], 5), (2, "1980-01-01", ["Anna Lim"], 5), (3, "1980-01-01", ["Anna Lim"], 6)]
    own = [nric(1, "S1A"), nric(3, "S3C"), phone(1), phone(2), phone(2, "+6587654321", False), phone(3, "+6587654321", False)]
    assert clusters(spark, records, own) == {1: 1, 2: 1, 3: 3}
    assert clusters(spark, records[::-1], own[::-1]) == {1: 1, 2: 1, 3: 3}


def test_a_lock_parts_what_scores_would_join(spark):
    assert clusters(spark, [(1, *ANNA), (2, *ANNA)], [phone(1), phone(2)]) == {1: 1, 2: 1}
    assert clusters(spark, [(1, *ANNA), (2, *ANNA)], [phone(1), phone(2)], [(2, 1)]) == {1: 1, 2: 2}


def test_ids_of_one_record_are_one_class(spark):
    got = clusters(spark, [(i, *ANNA) for i in (1, 2, 3)], [nric(1, "S1A"), nric(2, "S1A"), nric(2, "S2B"), nric(3, "S2B")])
    assert got == {1: 1, 2: 1, 3: 1}


def greedy(links, classes, forbidden):
    """One link after the other."""
    nodes = {n for a, b, _ in links for n in (a, b)}
    at = {n: n for n in nodes}
    key = lambda x: (x[2], hashlib.md5(f"{min(x[:2])}-{max(x[:2])}".encode()).hexdigest())
    for a, b, _ in sorted(links, key=key, reverse=True):
        x, y = sorted((at[a], at[b]))
        inside = [n for n in nodes if at[n] in (x, y)]
        held = {classes[n] for n in inside if n in classes}
        if x != y and len(held) < 2 and not any(p in inside and q in inside for p, q in forbidden):
            at.update(dict.fromkeys([n for n in inside if at[n] == y], x))
    return at


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_have_the_rows_of_one_link_after_the_other(spark, seed):
    r = random.Random(seed)
    links = {tuple(sorted(r.sample(range(120), 2))): r.choice([0.4, 0.5, 0.5, 0.7, 1.0]) for _ in range(160)}
    links |= {(200, k): 0.5 for k in range(201, 240)}  # a star
    links |= {(k, k + 1): 0.4 for k in range(300, 360)}  # a chain of equal links
    links = [(a, b, w) for (a, b), w in links.items()]
    classes = {n: f"c{r.randrange(4)}" for n in [*range(0, 120, 3), *range(200, 240, 5), 300, 330, 360]}
    forbidden = [tuple(r.sample(range(120), 2)) for _ in range(15)] + [(210, 211)]
    frame = spark.createDataFrame(links, "a long, b long, weight double").orderBy(F.rand(seed))
    held = spark.createDataFrame(list(classes.items()), "node long, cls string")
    got = bt.constrained_components(frame, held, spark.createDataFrame(forbidden, "a long, b long"))
    assert {x["node"]: x["component"] for x in got.collect()} == greedy(links, classes, forbidden)


def test_an_empty_batch(spark):
    assert clusters(spark, [], []) == {}
    assert clusters(spark, [(1, None, None, None)], []) == {1: 1}


def test_a_hot_phone_is_no_key_and_makes_no_pairs(spark):
    frame = spark.createDataFrame([(i, "identity", None, None, 1) for i in range(300)], RECORDS)
    own = spark.createDataFrame([(i, "phone", "+6599999999", True, "valid", 2) for i in range(300)], IDENTIFIERS)
    assert bt.batch_pairs(own, frame).count() == 0


def test_a_large_batch_is_joined_without_the_driver(spark, monkeypatch):
    """Beyond a number of rows no table is broadcast, be its file ever so small; the rows stay the same."""
    from kinweave import staging
    from kinweave.operators import connections

    records = [(i, "1980-01-01" if i % 2 else None, ["Anna Lim"], i // 4) for i in range(1, 41)]
    own = [nric(i, f"S{i // 4}{'AB'[i % 8 == 3]}") for i in range(1, 41) if i % 4 in (0, 3)] + [phone(i, f"+658{i // 4:07d}") for i in range(1, 41)]
    want, plans = clusters(spark, records, own), []

    def seen(df, name="round"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return staging.cut(df, name)

    monkeypatch.setattr(staging, "FEW_ROWS", -1, raising=False)
    monkeypatch.setattr(bt, "cut", seen)
    monkeypatch.setattr(connections, "cut", seen)
    assert clusters(spark, records, own) == want
    assert {"batch-best", "batch-round", "jump"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
