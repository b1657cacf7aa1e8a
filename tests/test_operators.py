"""Operators on small graphs, and properties of plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinweave.operators import connections as cx
from kinweave.operators import crm, merging, sales
from kinweave.operators import lifecycle as lc
from kinweave.operators import matching as mt
from kinweave.operators import persons as ps
from kinweave.operators import prediction as pr
from kinweave.sources import dumps
from kinweave.streaming import incremental as inc


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_components_and_lineage(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = dict(rows(cx.components(edges), "node", "component"))
    assert (got[3], got[5], got[160]) == (1, 4, 100) and 7 not in got
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 30)], "absorbed long, survivor long")
    assert set(r[1] for r in rows(cx.canonical(links), "absorbed", "canonical")) == {0}
    assert max(r[0] for r in rows(cx.canonical(links), "depth")) == 29
    assert cx.components(edges.limit(0)).count() == 0


def test_neighbourhood_stops_at_dead_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 9), (9, 8)], "a long, b long")
    seeds = spark.createDataFrame([(1,)], "node long")
    dead = spark.createDataFrame([(9,)], "node long")
    assert rows(cx.neighbourhood(edges, seeds, 2, dead), "node", "hop") == [(1, 0), (2, 1), (3, 2), (9, 1)]
    assert rows(cx.neighbourhood(edges, seeds, 4, most=3), "node") == [(1,), (2,), (9,)]
    with pytest.raises(ValueError, match="hops"):
        cx.neighbourhood(edges, seeds, 5)
    assert rows(cx.induced_edges(edges, cx.neighbourhood(edges, seeds, 1)), "a", "b") == [(1, 2), (1, 9)]


def test_shared_by_leaves_out_inactive_and_merged(spark):
    edges = spark.createDataFrame([(1, "x", None), (2, "x", True), (3, "x", False), (4, "x", True), (1, "y", True)], "person_id long, k string, is_active boolean")
    persons = spark.createDataFrame([(1, "active"), (2, "active"), (3, "active"), (4, "merged")], "person_id long, status string")
    assert rows(cx.shared_by(edges, ["k"], persons), "person_id", "other_id") == [(1, 2), (2, 1), (4, 1), (4, 2)]


def test_pages_cursors_and_filters(spark):
    persons = spark.createDataFrame([(1, 0.5, "1990-08-17"), (2, None, "1990-01-01"), (3, 0.9, None)], "person_id long, completeness double, preferred_dob string")
    assert [r["person_id"] for r in ps.page_of(persons, "completeness", True, 0, 9).collect()] == [2, 3, 1]
    assert [r["person_id"] for r in ps.page_of(persons, "completeness", False, 1, 1).collect()] == [3]
    assert rows(ps.filtered(persons, birth_month=8, completeness_min=None), "person_id") == [(1,)]
    assert ps.decode_cursor(ps.encode_cursor(40)) == 40 and ps.decode_cursor(None) == 0
    with pytest.raises(ValueError, match="cursor"):
        ps.decode_cursor("!!")
    with pytest.raises(ValueError, match="sort"):
        ps.page_of(persons, "salary", True, 0, 1)
    page, more = ps.look_ahead(persons, 2)
    assert page.count() == 2 and more


def test_reports_are_one_select(spark):
    with pytest.raises(ValueError, match="SELECT"):
        ps.stored_report(spark, "DROP TABLE x", {}, {}, {})
    with pytest.raises(ValueError, match="SELECT"):
        ps.stored_report(spark, "SELECT 1; DROP TABLE x", {}, {}, {})


def test_bands():
    from kinweave.operators.matching import BANDS

    assert BANDS == {"relationship": (0.20, 0.10), None: (0.40, 0.20)}


def test_band_edges(spark):
    cases = [(0.099, "relationship", False, "no_match"), (0.10, "relationship", False, "review"), (0.199, "relationship", False, "review"), (0.20, "relationship", False, "merge"), (0.20, "relationship", True, "review"),
             (0.199, "identity", False, "no_match"), (0.20, "identity", False, "review"), (0.399, "identity", False, "review"), (0.40, "identity", False, "merge"), (0.40, "identity", True, "merge")]
    df = spark.createDataFrame(cases, "c double, t string, x boolean, want string")
    assert df.where(mt.band(F.col("c"), F.col("t"), F.col("x")) != F.col("want")).count() == 0


def signals(spark, **given):
    base = {"record_id": 1, "person_id": 2, "record_type": "identity", "evidence": 0.0, "phone_exact": False, "email_exact": False, "high_fanout": False, "corroborated": False, "dob": None, "held_dobs": [], "name_similarity": None, "address_match": False} | given
    schema = "record_id long, person_id long, record_type string, evidence double, phone_exact boolean, email_exact boolean, high_fanout boolean, corroborated boolean, dob string, held_dobs array<string>, name_similarity double, address_match boolean"
    r = mt.scored(spark.createDataFrame([tuple(base.values())], schema)).first()
    return round(r["confidence"], 4), r["decision"]


def test_scores(spark):
    assert signals(spark, evidence=0.35) == (0.35, "review")
    assert signals(spark, evidence=1.05, name_similarity=0.9) == (1.0, "merge")
    assert signals(spark, evidence=0.2, name_similarity=0.4) == (0.0, "no_match")
    assert signals(spark, evidence=0.35, dob="d", held_dobs=["d"]) == (0.6, "merge")
    assert signals(spark, evidence=0.35, dob="d", held_dobs=["e"]) == (0.05, "no_match")
    assert signals(spark, evidence=0.7, phone_exact=True, email_exact=True, record_type="conversation") == (0.39, "review")
    assert signals(spark, evidence=0.7, phone_exact=True, email_exact=True, corroborated=True, record_type="conversation") == (0.91, "merge")
    assert signals(spark, evidence=0.2, phone_exact=True, name_similarity=0.5, record_type="relationship") == (0.91, "merge")


def test_evidence_counts_fanout_and_near_misses(spark):
    edges = spark.createDataFrame([(p, "phone", "+6591234567", True, "valid", True) for p in range(10, 17)] + [(10, "email", "ann@gmail.com", False, "valid", True)], "person_id long, identifier_type string, normalized_value string, is_verified boolean, quality_flag string, is_active boolean")
    mine = spark.createDataFrame([(1, "phone", "+6591234567", True, "valid", 1), (1, "email", "ann@gmial.com", True, "valid", 2)], "record_id long, identifier_type string, normalized_value string, is_verified boolean, quality_flag string, position int")
    pairs = spark.createDataFrame([(1, 10)], "record_id long, person_id long")
    r = mt.identifier_evidence(pairs, mine, edges).first()
    assert (round(r["evidence"], 6), r["high_fanout"], r["phone_exact"], r["email_near"]) == (round(0.35 - 0.25 + 0.10, 6), True, True, True)


def test_best_match_links_all_merges(spark):
    pairs = spark.createDataFrame([(1, 5, "merge", 0.9), (1, 4, "merge", 0.9), (1, 3, "review", 0.3), (2, 8, "review", 0.2), (2, 9, "review", 0.3), (3, 1, "no_match", 0.1)], "record_id long, person_id long, decision string, confidence double")
    got = {r["record_id"]: (r["decision"], r["person_id"], r["also_linked"]) for r in mt.best_match(pairs).collect()}
    assert got == {1: ("merge", 4, [5]), 2: ("review", 9, []), 3: ("no_match", None, [])}
    prior = spark.createDataFrame([(2, 7), (3, 6), (3, 5)], "record_id long, prior_id long")
    moved = {r["record_id"]: (r["decision"], r["person_id"]) for r in mt.continuity(mt.best_match(pairs), prior, pairs).collect()}
    assert moved == {1: ("merge", 4), 2: ("review", 7), 3: ("review", 5)}


def test_new_records_cluster_with_each_other(spark):
    best = spark.createDataFrame([(1, "merge", 50), (2, "no_match", None), (3, "no_match", None), (4, "no_match", None), (5, "review", 9)], "record_id long, decision string, person_id long")
    ids = spark.createDataFrame([(2, "phone", "a", "valid"), (3, "phone", "a", "valid"), (4, "phone", "b", "invalid_format")], "record_id long, identifier_type string, normalized_value string, quality_flag string")
    clusters = spark.createDataFrame([(2, 2), (3, 2)], "record_id long, cluster long")
    assert rows(mt.person_assignment(best, clusters), "record_id", "person") == [(1, "p:50"), (2, "n:2"), (3, "n:2"), (4, "n:4")]


def test_versions(spark):
    held = spark.createDataFrame([("a", "h1", 1, "superseded"), ("a", "h2", 2, "active"), ("a", "h3", 3, "pending_review"), ("b", "h1", 1, "rejected")], "source_record_id string, record_hash string, version long, lifecycle_status string")
    incoming = spark.createDataFrame([("a", "h2"), ("a", "h3"), ("a", "h1"), ("b", "h1"), ("c", "h9")], "source_record_id string, record_hash string")
    got = rows(lc.planned_versions(incoming, held), "source_record_id", "record_hash", "plan", "version", "rejects_pending")
    assert got == sorted([("a", "h2", "duplicate", None, False), ("a", "h3", "duplicate", None, False), ("a", "h1", "next", 4, True), ("b", "h1", "next", 2, False), ("c", "h9", "first", 1, False)], key=str)


def test_exclusion_by_subdomain(spark):
    people = spark.createDataFrame([("a@x.com", "1"), ("b@mail.x.com", "2"), ("c@notx.com", "3"), (None, "4")], "email string, phone string")
    assert rows(lc.excluded(people, domains=["x.com"]), "phone") == [("3",), ("4",)]


def test_contacts_must_agree(spark):
    contacts = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (2, "a", 5), (2, "b", 6), (3, "a", None)], "record_id long, contact string, person_id long")
    assert rows(lc.unambiguous_contacts(contacts), "record_id", "person_id") == [(1, 5)]


def test_tag_or_serial_has_no_nested_loop(spark):
    obs = spark.createDataFrame([(1, "T", None, "K"), (2, "T", "S", "K"), (3, None, "S", "K"), (4, None, "S", "L")], "observation_id long, lta_tag string, serial_number string, product_sku string")
    out = sales.tag_or_serial(obs, obs.withColumnRenamed("observation_id", "ask_id").where("ask_id = 2"))
    assert rows(out, "observation_id") == [(1,), (2,), (3,)]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_admission(spark):
    t = dt.datetime(2024, 1, 2, 12)
    asked = [(1, t, False, "none", t - dt.timedelta(hours=2), True), (2, t, False, "queued", None, None), (3, t, False, "none", t - dt.timedelta(hours=30), True)] + [(4, t + dt.timedelta(minutes=m), True, "none", None, None) for m in range(5)]
    df = spark.createDataFrame(asked, "person_id long, requested_at timestamp, force boolean, state string, current_at timestamp, same_revision boolean")
    got = [r["outcome"] for r in crm.admission(df, F.lit(t)).orderBy("person_id", "requested_at").collect()]
    assert got == ["already_valid", "already_queued", "queued", "queued", "queued", "queued", "force_limit", "force_limit"]


def event(parent, n, state, day, head=0):
    return (parent, n, state, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), head, "C", "S")


EVENTS = "parent long, event_id long, mapped_state string, event_at timestamp, head_version int, category_id string, stage_id string"
VERSIONS = "parent long, version_key long, version int, lifecycle_status string, observed_at timestamp, entity_key long, timestamps_valid boolean, amount_value double, amount_state string, currency_status string, contact_count int"


def version(parent, key, day, entity=1, amount=5.0):
    return (parent, key, key, "active", dt.datetime(2024, 1, 1) + dt.timedelta(days=day), entity, True, amount, "known", "supported", 1)


def test_labels_and_no_leakage(spark):
    base = [event(1, 1, "open", 0), event(1, 2, "won", 10), event(1, 3, "open", 20), event(2, 4, "open", 0), event(3, 5, "open", 100), event(4, 6, "open", 5), event(5, 7, "open", 1)]
    versions = spark.createDataFrame([version(1, 1, -1), version(2, 2, -1), version(3, 3, 0), version(4, 4, 0, 9), version(5, 5, 0, 1), version(5, 6, 0, 2)], VERSIONS)
    cutoff = F.expr("TIMESTAMP '2024-04-01 00:00:00'")
    label = lambda e: {(r["parent"], r["event_id"]): r["reason"] for r in pr.retrospective_labels(spark.createDataFrame(e, EVENTS), versions, [1], cutoff).collect()}
    assert label(base) == {(1, 1): "first_won_in_horizon", (1, 3): "mature_no_first_won", (2, 4): "mature_no_first_won", (3, 5): "immature_horizon", (4, 6): "unsupported_entity", (5, 7): "selected_parent_ambiguity"}
    feats = lambda e, v: {r["event_id"]: tuple(r) for r in pr.features(spark.createDataFrame(e, EVENTS), v).collect() if r["event_id"] in (1, 3)}
    later = versions.union(spark.createDataFrame([version(1, 9, 50, 1, 99.0)], VERSIONS))
    assert feats(base, versions) == feats([*base, event(1, 90, "lost", 60)], later)


def test_metrics(spark):
    scores = spark.createDataFrame([(i, 1, p, y) for i, (p, y) in enumerate([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)])], "row_id long, bucket int, p double, label int")
    r = pr.binary_metrics(scores, ["bucket"]).first()
    assert (r["capacity"], r["precision_at_capacity"], r["lift_at_capacity"]) == (1, 1.0, 2.0)
    assert abs(r["pr_auc"] - (1 / 2 + 2 / 3 / 2)) < 1e-9 and abs(r["brier"] - (0.01 + 0.64 + 0.09 + 0.01) / 4) < 1e-9


def test_logistic_finds_the_direction(spark):
    data = spark.range(2000).select((F.col("id") % 10).alias("x"), ((F.col("id") % 10 >= 5) != (F.col("id") % 7 == 0)).cast("int").alias("label"))
    w = {r["name"]: r["weight"] for r in pr.logistic_model(data, ["x"]).collect()}
    assert w["x"] > 0.2 and w["intercept"] < 0
    scored = pr.score_model(data, w)
    assert scored.where("x = 9").first()["p"] > 0.7


DUMP = """-- dump
CREATE TABLE `users` (
  `id` int NOT NULL,
  `name` varchar(20),
  `score` double
);
INSERT INTO `users` VALUES (1,'O''Neil; (x), y',1.5),(2,'tab\\there',NULL),
(3,'line
break',-2);
INSERT INTO `other` (`a`) VALUES ('INSERT INTO users');
COPY public.people (id, name, ok) FROM stdin;
1\tAnn\tt
2\t\\N\tf
3\tN\tt
\\.
INSERT INTO `users` VALUES (4,'last',4);
"""


def test_dumps(spark, tmp_path):
    path = str(tmp_path / "dump.sql")
    (tmp_path / "dump.sql").write_text(DUMP)
    users = dumps.read_dump(spark, path, "users", "id long, name string, score double")
    want = [(1, "O'Neil; (x), y", 1.5), (2, "tab\there", None), (3, "line\nbreak", -2.0), (4, "last", 4.0)]
    assert rows(users, "id", "name", "score") == want
    people = dumps.read_dump(spark, path, "people", "id long, name string, ok boolean")
    assert rows(people, "id", "name", "ok") == [(1, "Ann", True), (2, None, False), (3, "N", True)]
    with pytest.raises(ValueError, match="relative"):
        dumps.relative_path("../x")
    for size in (40, 97, 150):  # ranges of any size give every row once
        spark.dataSource.register(dumps.DumpSource)
        parts = spark.read.format("sqldump").schema("id long, name string, score double").option("table", "users").option("columns", "id,name,score").option("rangeBytes", size).load(path)
        assert rows(parts, "id", "name", "score") == want


def test_edges_follow_merges_and_come_back(spark):
    edges = spark.createDataFrame(
        [("LIVES_AT", 1, "a"), ("LIVES_AT", 2, "a"), ("LIVES_AT", 3, "b"), ("LIVES_AT", 5, "c"), ("LIVES_AT", 5, "c"), ("KNOWS_OUT", 2, "1"), ("KNOWS_OUT", 7, "3"), ("KNOWS_IN", 1, "2")], "kind string, person_id long, target string"
    )
    log = "event_id long, absorbed long, survivor long, event_type string, created_at long"
    merges = [(1, 2, 1, "auto_merge", 1), (2, 3, 2, "manual_merge", 2), (3, 5, 1, "auto_merge", 3), (4, 5, 1, "unmerge", 4)]
    got = merging.edges_after_merges(edges, spark.createDataFrame(merges, log))
    assert rows(got, "kind", "person_id", "target", "origins", "moved") == [("KNOWS_OUT", 7, "1", 1, False), ("LIVES_AT", 1, "a", 2, True), ("LIVES_AT", 1, "b", 1, True), ("LIVES_AT", 5, "c", 1, False)]
    undone = merging.edges_after_merges(edges, spark.createDataFrame([*merges, (5, 2, 1, "unmerge", 5)], log))
    assert rows(undone.where("kind = 'LIVES_AT'"), "person_id", "target") == [(1, "a"), (2, "a"), (2, "b"), (5, "c")]
    assert merging.edges_after_merges(edges.limit(0), spark.createDataFrame(merges, log)).count() == 0


@pytest.mark.parametrize("size", [37, 400, 1000, 1 << 20])
def test_lines_that_look_like_statements_and_ranges_of_any_size(spark, tmp_path, size):
    """200 rows of a COPY block, many of which begin like statements, then strings over lines; any range starts right."""
    looks = ["INSERT INTO docs VALUES (1,'x');", "COPY docs (id) FROM stdin;", "CREATE TABLE docs (", "it's", "plain"]
    lines = [f"{looks[i % 5]}\t{i}" for i in range(200)]
    texts = ["it\\'s; INSERT INTO notes VALUES (9,''no'');", "COPY docs (text, id) FROM stdin;\n", "\\.\n'' quoted '' \n;", "-- end"]
    inserts = [f"INSERT INTO notes (id, text) VALUES ({i},'{texts[i % 4]}\nline {i}'),\n  ({i + 100},NULL);" for i in range(40)]
    dump = "\n".join(["-- it's a dump", "COPY docs (text, id) FROM stdin;", *lines, "\\.", "", *inserts, "COPY docs (text, id) FROM stdin;", "last\t999", "\\."]) + "\n"
    (tmp_path / "dump.sql").write_text(dump)
    docs = dumps.read_dump(spark, str(tmp_path / "dump.sql"), "docs", "id long, text string", range_bytes=size)
    held = docs.collect()
    assert {r["id"]: r["text"] for r in held} == {i: looks[i % 5] for i in range(200)} | {999: "last"} and len(held) == 201
    if size <= 1000:
        assert docs.where("id < 200").select(F.spark_partition_id()).distinct().count() > 3  # one block, many tasks
    notes = dumps.read_dump(spark, str(tmp_path / "dump.sql"), "notes", "id long, text string", range_bytes=size).collect()
    want = {i: texts[i % 4].replace("\\'", "'").replace("''", "'").replace("\\.", ".") + f"\nline {i}" for i in range(40)} | {i + 100: None for i in range(40)}
    assert {r["id"]: r["text"] for r in notes} == want and len(notes) == 80


def test_dump_folders_find_their_columns_and_ranges(spark, tmp_path):
    texts = ["it's", "a\\b\tc\nd\re", "INSERT INTO `t` VALUES (9,'x');", "", None, "\\N", "'); --", "x" * 5000]
    given = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "id long, text string, ok boolean").repartition(3)
    dumps.write_copy(given, "t", str(tmp_path / "copy"))
    dumps.write_inserts(given.select("id", "text"), "t", str(tmp_path / "insert"))
    want = [(i, t) for i, t in enumerate(texts)]
    for size in (64, 300, 1 << 20):
        copied = dumps.read_dump(spark, "copy", "t", "id long, text string, ok boolean", root=str(tmp_path), range_bytes=size)
        assert rows(copied, "id", "text") == want and copied.where("ok").count() == 4
        assert rows(dumps.read_dump(spark, str(tmp_path / "insert"), "t", "id long, text string", range_bytes=size), "id", "text") == want
    with pytest.raises(ValueError, match="relative"):
        dumps.read_dump(spark, "../copy", "t", "id long", root=str(tmp_path))


def test_envelopes(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"source_system":"a","source_record_id":"1","record_type":"identity","record_hash":"h"}\n{"source_system":"a","source_record_id":"2","record_type":"call","record_hash":"h"}\n{"source_system":"a","source_record_id":"3","record_type":"conversation","record_hash":"h"}\n{"source_system":"","source_record_id":"4"}\n')
    got = dumps.checked(dumps.read_landed(spark, str(tmp_path / "page.json")))
    assert rows(got, "source_record_id", "error") == [("1", None), ("2", "no_parent"), ("3", "no_extraction"), ("4", "no_source")]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, schema = tmp_path / "in", "source_system string, source_record_id string, record_hash string, observed_at timestamp"
    src.mkdir()
    line = '{"source_system":"s","source_record_id":"%s","record_hash":"%s","observed_at":"2024-01-01T00:00:0%d"}\n'
    (src / "1.json").write_text(line % ("a", "h1", 0) + line % ("a", "h1", 1) + line % ("b", "h1", 0))
    run = lambda: inc.ingest(inc.file_stream(spark, str(src), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (src / "2.json").write_text(line % ("a", "h1", 2) + line % ("a", "h2", 3))
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "source_record_id", "record_hash") == [("a", "h1"), ("a", "h2"), ("b", "h1")]


def test_stream_allocates_versions(spark, tmp_path):
    src, schema = tmp_path / "in", "source_system string, source_record_id string, record_hash string, observed_at timestamp"
    src.mkdir()
    line = '{"source_system":"s","source_record_id":"a","record_hash":"%s","observed_at":"2024-01-01T00:00:0%d"}\n'
    (src / "1.json").write_text(line % ("h1", 0) + line % ("h1", 1) + line % ("h2", 2))
    q = inc.allocate_versions(inc.file_stream(spark, str(src), schema)).writeStream.format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("versions"), "record_hash", "version") == [("h1", 1), ("h2", 2)]


def test_incremental_tables(spark):
    prev = spark.createDataFrame([("a", 0), ("b", 2)], "k string, missing int")
    now = spark.createDataFrame([("a",), ("c",)], "k string")
    assert rows(inc.absence(prev, now, "k"), "k", "missing") == [("a", 0), ("b", 3), ("c", 0)]
    failed = spark.createDataFrame([("a",), ("b",)], "k string")
    again, given_up = inc.dead_letters(failed, spark.createDataFrame([("b", 5)], "k string, tries int"), "k")
    assert rows(again, "k") == [("a",)] and rows(given_up, "k") == [("b",)]
    talks = spark.createDataFrame([(1, "mail a@b.com or +65 9123 4567"), (2, None)], "conv_id long, text string")
    assert rows(inc.extracted(talks, inc.rule_extractor, "conv_id long, identifier_type string, raw string"), "identifier_type", "raw") == [("email", "a@b.com"), ("phone", "+65 9123 4567")]
    with pytest.raises(ValueError, match="add up"):
        inc.asserted(now, spark.createDataFrame([("a", 2)], "k string, stored long"), ["k"])


def test_platt_scaling_meets_its_targets(spark):
    rows = [(i / 40, int((i * 7) % 40 < i)) for i in range(40)] + [(None, 1), (0.5, None)]
    scores = spark.createDataFrame(rows, "p double, label int")
    w = {r["name"]: r["weight"] for r in pr.platt_scaling(scores).collect()}
    got = pr.score_model(scores.where("p is not null and label is not null").withColumn("raw", F.col("p")), w).collect()
    n1 = sum(r["label"] for r in got)
    gap = [((n1 + 1) / (n1 + 2) if r["label"] else 1 / (len(got) - n1 + 2)) - r["p"] for r in got]
    assert w["p"] > 0 and abs(sum(gap)) < 1e-4
    assert abs(sum(g * r["raw"] for g, r in zip(gap, got, strict=True))) < 1e-4
    assert {r["weight"] for r in pr.platt_scaling(scores.limit(0)).collect()} == {0.0}
