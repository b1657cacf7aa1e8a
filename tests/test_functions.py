"""Scalar functions against tables of fixed cases."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import facts, normalize, similarity, transcript


def values(spark, make, cases):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"x{k} string" for k in range(len(cases[0]))))
    return [r[1] for r in sorted(rows.select("i", make(*(F.col(f"x{k}") for k in range(len(cases[0])))).alias("y")).collect())]


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("", "abc", 0.0), ("abc", "xyz", 0.0), ("MARTHA", "MARHTA", 0.9444), ("DIXON", "DICKSONX", 0.7667), ("aaabc", "aabcaa", 0.8444)])
def test_jaro(a, b, want):
    assert round(similarity.jaro_of(a, b), 4) == want


@pytest.mark.parametrize(("a", "b", "want"), [("  MARTHA  ", "marhta", 0.9611), ("Axxxxx", "Ayyyyy", 0.5), ("aaabc", "aabcaa", 0.8756)])
def test_jaro_winkler(a, b, want):
    assert round(similarity.jaro_winkler_of(a, b), 4) == want


def test_one_edit_apart(spark):
    cases = [("CA", "ABC"), ("abcd", "abxd"), ("abcd", "abdc"), ("abcd", "abcde"), ("abcd", "acd"), ("abcd", "axxd"), ("abcd", "abcd"), ("ab", "ba"), ("a", "b")]
    assert values(spark, similarity.one_edit_apart, cases) == [False, True, True, True, True, False, False, True, True]


def test_near_matches(spark):
    phones = [("+6591234567", "+6591234568"), ("+6591234567", "+85291234567"), ("+87012345678", "+87012345679"), ("+6591234567", "+6591234567")]
    assert values(spark, similarity.phone_near_match, phones) == [True, False, False, False]
    emails = [("a@gmial.com", "a@gmail.com"), ("johnsmith@x.com", "jonhsmith@x.com"), ("johnsmith@gmial.com", "jonhsmith@gmail.com"), ("a@foo.bar", "a@fooo.bar"), ("abc@x.com", "abd@x.com"), ("nothing", "a@gmail.com")]
    assert values(spark, similarity.email_near_match, emails) == [True, True, False, False, False, False]


def test_emails(spark):
    cases = [(" John.Doe+x@GoogleMail.com ",), ("a.b@hotmail.com",), ("test@test.com",), ("broken@",), ("",), (None,), ("+x@gmail.com",)]
    got = values(spark, normalize.normalize_email, cases)
    assert [g and (g["value"], g["quality"]) for g in got] == [("johndoe@gmail.com", "valid"), ("a.b@hotmail.com", "valid"), (None, "placeholder_value"), (None, "invalid_format"), (None, "invalid_format"), None, ("+x@gmail.com", "valid")]


def test_phones(spark):
    cases = [("xxx+6589251818",), ("9123 4567",), ("12345678",), ("call",), ("+442079460958",), ("0044 2079460958",), ("+6512345678",), ("",), (None,)]
    got = values(spark, normalize.normalize_phone, cases)
    assert [g and (g["value"], g["quality"]) for g in got] == [("+6589251818", "valid"), ("+6591234567", "valid"), (None, "placeholder_value"), (None, "invalid_format"), ("+442079460958", "valid"), ("+442079460958", "valid"), (None, "invalid_format"), (None, "invalid_format"), None]


def test_names_and_ids(spark):
    got = values(spark, normalize.normalize_name, [("  Ann   Lee ",), ("N/A",), ("é",), ("",), (None,)])
    assert [g and g["value"] for g in got] == ["Ann Lee", None, "é", None, None]
    assert [g and g["value"] for g in values(spark, normalize.normalize_nric, [("xxxf1234567X",), ("xx",), (None,)])] == ["F1234567X", None, None]
    assert values(spark, normalize.normalize_lta_tag, [(" sg-1 2 ",), ("n/a",), (None,), ("--",)]) == ["SG12", None, None, None]
    assert values(spark, normalize.normalize_serial, [(" a  b ",), ("nil",)]) == ["A B", None]


def test_addresses(spark):
    got = values(spark, normalize.normalize_address, [("#05-123 10 Example  Street Singapore 123456",), ("Blk 10 Example Street, SG 123456",), ("who knows 123456 x",), ("tba",), ("no place",), (None,)])
    assert [g and g["normalized_full"] for g in got] == ["#05-123, 10, example street, singapore 123456, sg", "10, example street, singapore 123456, sg", "who knows 123456 x", None, None, None]
    assert [g and g["quality"] for g in got] == ["valid", "valid", "partial_parse", "placeholder_value", "invalid_format", None]


def test_address_text(spark):
    rows = spark.sql("select named_struct('unit_number', ' 5 ', 'street_number', cast(null as string), 'street_name', 'A', 'building_name', '', 'city', 'S', 'state_province', cast(null as string), 'postal_code', '1', 'country_code', 'SG', 'raw', 'r') as a union all select named_struct('unit_number', '', 'street_number', null, 'street_name', null, 'building_name', null, 'city', 'S', 'state_province', null, 'postal_code', null, 'country_code', null, 'raw', ' raw text ')")
    assert sorted(r[0] for r in rows.select(normalize.address_text(F.col("a"))).collect()) == ["5, A, S, 1, SG", "raw text"]


INTEGRAL = [
    ("none", None, None, None), ("bool", "true", None, "boolean"), ("int", "5", 5, None), ("int", "9223372036854775808", None, "out_of_range"), ("str", " 12.0 ", 12, None), ("str", "1.5", None, "non_integral"),
    ("str", "x", None, "malformed"), ("str", "", None, "malformed"), ("str", "9" * 200, None, "string_too_long"), ("str", "NaN", None, "non_finite"), ("decimal", "1e3", 1000, None), ("float", "9007199254740992", None, "unsafe_float"),
    ("float", "inf", None, "non_finite"), ("float", "2.5", None, "non_integral"), ("list", "[]", None, "unsupported_type"), ("str", "1e400", None, "out_of_range"), ("str", "-9223372036854775808", -9223372036854775808, None),
]


def test_convert_integral(spark):
    got = values(spark, facts.convert_integral, [(k, t) for k, t, *_ in INTEGRAL])
    assert [(g["value"], g["error"]) for g in got] == [(v, e) for *_, v, e in INTEGRAL]


def test_payload_facts(spark):
    cases = [('{"amount": null, "deal": {"amount": 5}}',), ('{"deal": {"amount": 5}}',), ('{"x": 1}',), ("no json",), (None,)]
    got = values(spark, lambda p: facts.payload_fact(p, "amount"), cases)
    assert [(g["present"], g["value"]) for g in got] == [(True, None), (True, "5"), (False, None), (False, None), (False, None)]
    cases = {'{"amount": 0}': "zero", '{"amount": "1,000"}': "invalid", '{"opportunity": "1_0.5"}': "known", '{"amount": true}': "invalid", '{"amount": "inf"}': "invalid", '{"amount": -1}': "invalid", "{}": "missing", "[1]": "invalid", "no json": "invalid", '{"deal": {"OPPORTUNITY": 5}, "amount": null}': "missing"}
    got = values(spark, facts.payload_facts, [(c,) for c in cases] + [(None,)])
    assert [g["amount_state"] for g in got] == [*cases.values(), "missing"] and got[2]["amount_value"] == 10.5
    cases = {'{"currency": " usd "}': "supported", '{"CURRENCY_ID": "EUR"}': "unsupported", '{"currency": "US1"}': "invalid", '{"currency": 7}': "invalid", '{"currency": ""}': "missing"}
    assert [g["currency_status"] for g in values(spark, facts.payload_facts, [(c,) for c in cases])] == list(cases.values())


def test_keys_times_and_forms(spark):
    assert values(spark, facts.key_of, [("ab", "c"), ("a", "bc")]) == ["sv1:2:ab1:c", "sv1:1:a2:bc"]
    got = values(spark, lambda t: facts.parse_timestamp(t).cast("string"), [("2024-01-01T00:00:00+08:00",), ("2024-01-01T00:00:00",), ("x",)])
    assert got == ["2023-12-31 16:00:00", None, None]
    assert values(spark, lambda p: facts.display_percent(p.cast("double")), [("0.125",), ("0.135",), ("1",)]) == ["12%", "14%", "100%"]
    assert values(spark, lambda t: facts.display_datetime(t.cast("timestamp"), "Asia/Singapore"), [("2024-01-01 04:05:00",), ("2024-01-01 16:30:00",), (None,)]) == ["01 Jan 2024, 12:05 PM", "02 Jan 2024, 12:30 AM", ""]
    dob = values(spark, lambda d: facts.display_dob(d, F.to_date(F.lit("2024-06-01"))), [("1990-13-45",), ("1990-01-05",), ("2025-01-01",), ("1893-01-01",), (None,), ("",)])
    assert [tuple(d) for d in dob] == [("1990-13-45", True), ("05 Jan 1990", False), ("2025-01-01", True), ("1893-01-01", True), ("—", False), ("—", False)]
    labels = {"Next of Kin": "emergency_contact", "Referral by": "referrer", "half-brother": "family", "Father": "social", "": "social", None: "social"}
    assert values(spark, normalize.relationship_category, [(x,) for x in labels]) == list(labels.values())


def test_digests(spark):
    a = spark.range(10_000).select("id", (F.col("id") % 7).alias("x"))
    b = a.repartition(5).select("x", "id")
    assert facts.same_rows(a, b).first()["equal"] is True
    assert facts.same_rows(a, b.where("id > 0")).first()["equal"] is False
    assert facts.ordered_digest(a, "id", ["id", "x"]).first()["digest"] == facts.ordered_digest(b, "id", ["id", "x"]).first()["digest"]


def test_transcripts(spark):
    text = "[Deal] head\n[2024-01-01 10:00:00] Ann (+65 9123): hi[BR]there\nmore\n[2024-01-01 10:01:00] Bob: [B]yo[/B]\n[2024-01-01 10:02:00] note:"
    rows = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "conv_id int, text string")
    got = transcript.messages(rows, "text", ["conv_id"]).orderBy("message").collect()
    assert [(r["message"], r["speaker"], r["phone"], r["text"]) for r in got] == [(1, "Ann", "+659123", "hi\nthere\nmore"), (2, "Bob", None, "yo"), (3, "note", None, "")]
    members = spark.createDataFrame([(1, "ann lee", "buyer")], "conv_id int, name string, role string")
    roles = transcript.with_roles(transcript.messages(rows, "text", ["conv_id"]), members, ["conv_id"])
    assert {r["speaker"]: r["role"] for r in roles.collect()} == {"Ann": "buyer", "Bob": None, "note": None}


def test_character_batches(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 4, 4, 20, 1])], "c int, i int, n int")
    got = transcript.batches(rows, ["c"], "i", "n", 10).orderBy("i").collect()
    assert [r["batch"] for r in got] == [0, 0, 1, 2, 3]


def test_addresses_work_out_each_step_once(spark):
    plan = spark.range(1).select(normalize.normalize_address(F.col("id").cast("string")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2
