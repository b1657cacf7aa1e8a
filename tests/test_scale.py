"""Hot keys, one large group, ranked search, digest trees, versions of a large micro-batch, addresses."""

import math
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.functions import normalize, trees
from kinweave.operators import hot, sales
from kinweave.operators import prediction as pr
from kinweave.operators import search as se
from kinweave.streaming import incremental as inc


@pytest.mark.parametrize("limit", [1, 6, 1000])
def test_others_are_counted_exactly_at_any_limit(spark, limit):
    r = random.Random(5)
    edges = [(p, "phone", f"h{t}", r.choice([True, None, False])) for p in range(90) for t in range(40) if r.random() < (0.4 if t < 3 else 0.03)]
    merged = {p for p in range(90) if p % 11 == 0}
    want = defaultdict(set)
    live = {(p, t) for p, _, t, active in edges if active is not False}
    for p, t in live:
        want[p] |= {q for q, u in live if u == t and q != p and q not in merged}
    frame = spark.createDataFrame(edges, "person_id long, identifier_type string, normalized_value string, is_active boolean")
    persons = spark.createDataFrame([(p, "merged" if p in merged else "active") for p in range(90)], "person_id long, status string")
    got = {x["person_id"]: x["others"] for x in hot.others_counted(frame, ["identifier_type", "normalized_value"], persons, limit).collect()}
    assert got == {p: len(o) for p, o in want.items() if o}


def test_hot_things_make_no_pairs(spark):
    edges = spark.range(5000).select(F.col("id").alias("person_id"), F.lit("phone").alias("identifier_type"), F.lit("one").alias("normalized_value"), F.lit(True).alias("is_active"))
    persons = spark.range(5000).select(F.col("id").alias("person_id"), F.lit("active").alias("status"))
    pairs, classes = hot.sharing(edges, ["identifier_type", "normalized_value"], persons, limit=100)
    assert pairs.count() == 0 and classes.count() == 5000
    counted = hot.others_counted(edges, ["identifier_type", "normalized_value"], persons, limit=100)
    assert counted.where("others = 4999").count() == 5000


def test_one_group_is_ranked_by_all_ranges(spark):
    scores = spark.range(20000).select(F.col("id").alias("row_id"), F.lit(None).cast("string").alias("g"), F.round(F.rand(3), 2).alias("p"), (F.rand(4) < 0.3).cast("int").alias("label"))
    scores = pr.saved(scores, "scores")
    got = pr.ranked(scores, ["g"]).orderBy("rank").toPandas()
    want = scores.toPandas().sort_values(["p", "row_id"], ascending=[False, True])
    assert got["row_id"].tolist() == want["row_id"].tolist() and got["rank"].tolist() == list(range(1, 20001))
    assert got["tp"].tolist() == want["label"].cumsum().tolist() and set(got["n"]) == {20000} and set(got["pos"]) == {int(want["label"].sum())}
    plan = pr.ranked(scores, ["g"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "range#" in plan


def bm25(rows, query):
    docs = {k: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for k, t in rows}
    docs = {k: c for k, c in docs.items() if c}
    mean, n = sum(sum(c.values()) for c in docs.values()) / len(docs), len(docs)
    out = {}
    for k, c in docs.items():
        for w in set(re.findall(r"[^\W_]+", query.lower())) & set(c):
            df = sum(w in x for x in docs.values())
            out[k] = out.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return sorted(((k, round(s, 6)) for k, s in out.items()), key=lambda x: (-x[1], x[0]))


def test_search_gives_the_best_by_bounds_and_follows_batches(spark, tmp_path):
    r = random.Random(9)
    names = ["common", "usual", "rare1", "rare2", "Lim", "Tan", "José"]
    rows = [(i, " ".join(["common"] * (i % 3) + r.choices(names, [9, 7, 1, 1, 4, 4, 2], k=r.randint(1, 6)))) for i in range(200)] + [(500, None), (501, ""), (502, "--")]
    frame = spark.createDataFrame(rows, "id long, name string")
    se.write_index(frame, "id", "name", f"{tmp_path}/a")
    changed = [(3, "Rare1 zed"), (4, None), (900, "zed common")]
    se.update_index(spark, f"{tmp_path}/a", spark.createDataFrame(changed, "id long, name string"), "id", "name", f"{tmp_path}/b")
    after = [x for x in rows if x[0] not in (3, 4)] + changed
    queries = {"q1": "rare1 common usual", "q2": "josé", "q3": "zed zed", "q4": "none such", "q5": "common usual lim tan"}
    for path, held in ((f"{tmp_path}/a", rows), (f"{tmp_path}/b", after)):
        got = defaultdict(list)
        for x in se.search(spark, path, list(queries.items()), 5).orderBy("place").collect():
            got[x["query_id"]].append((x["key"], round(x["score"], 6)))
        assert {q: got[q] for q in queries} == {q: bm25(held, text)[:5] for q, text in queries.items()}


def test_search_reads_the_buckets_of_its_words(spark, tmp_path):
    se.write_index(spark.createDataFrame([(i, f"word{i}") for i in range(300)], "id long, name string"), "id", "name", f"{tmp_path}/a")
    own = spark.read.parquet(f"{tmp_path}/a/postings").where(F.col("bucket").isin([3]))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", own._jdf.queryExecution().toString())


def test_trees_of_equal_tables_and_what_differs(spark):
    rows = [(i, f"t{i}", None if i % 7 == 0 else i) for i in range(400)] + [(None, "x", 1), (5000, "twice", 1), (5000, "twice", 1)]
    a = spark.createDataFrame(rows, "id long, t string, n long")
    changed = [(i, "other" if i == 17 else t, n) for i, t, n in rows if i != 100] + [(7000, None, None)]
    b = spark.createDataFrame(changed[:-2] + changed[-1:], "id long, t string, n long")  # one of the two equal rows is gone
    got = sorted((x["id"], x["what"]) for x in trees.differences(a, b, ["id"], ["t", "n"], depth=2).collect())
    assert got == [(17, "changed"), (100, "only_left"), (5000, "changed"), (7000, "only_right")]
    assert trees.differences(a, a.repartition(5), ["id"], ["t", "n"]).count() == 0
    one, two = (trees.root(x, ["id"], ["t", "n"], 2).first() for x in (a, a.orderBy(F.desc("t"))))
    assert one == two and one["rows"] == 403 and trees.root(b, ["id"], ["t", "n"], 2).first()["digest"] != one["digest"]
    blank = [spark.createDataFrame([(1, x)], "id long, t string") for x in (None, "")]
    assert len({trees.root(x, ["id"], ["t"], 1).first()["digest"] for x in blank}) == 2


def test_versions_of_one_identity_over_many_arrow_batches(spark, tmp_path):
    """25,000 rows of one identity in one micro-batch, five hashes one after the other, in mixed order."""
    rows = spark.range(25000).select(F.lit("s").alias("source_system"), F.lit("r").alias("source_record_id"), F.timestamp_seconds(F.col("id")).alias("observed_at"), F.concat(F.lit("h"), F.floor(F.col("id") / 5000)).alias("record_hash"))
    rows.orderBy(F.rand(1)).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = inc.allocate_versions(stream).writeStream.format("memory").queryName("versions_many").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("versions_many").orderBy("version").toPandas()
    assert got["version"].tolist() == [1, 2, 3, 4, 5] and got["record_hash"].tolist() == ["h0", "h1", "h2", "h3", "h4"]
    assert got["observed_at"].tolist() == [pd.Timestamp(5000 * k, unit="s") for k in range(5)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("#05-123 10 Orchard Road Singapore 238863", ("05-123", "10", "orchard road", "238863", "valid")),
        ("20 Second Street Singapore 654321", (None, "20", "second street", "654321", "valid")),
        ("Lucky Plaza #05-123, 10 Orchard Road Singapore 238863", (None, "", "lucky plaza #05-123, 10 orchard road singapore 238863", "238863", "partial_parse")),
        ("#04-242 163A Rivervale Crescent Singapore 541163", ("04-242", "163a", "rivervale crescent", "541163", "valid")),
        ("  Blk  7  Long   Lane , SG  123456 ", (None, "7", "long lane", "123456", "valid")),
        ("block 7 Long Lane,singapore 123456", (None, "7", "long lane", "123456", "valid")),
        ("04-1 Blk 7B Lane 123456", ("04-1", "7b", "lane", "123456", "valid")),
        ("10 Orchard Road, 238863", (None, "10", "orchard road,", "238863", "valid")),
        ("10 Singapore 238863", (None, "10", "singapore", "238863", "valid")),
        ("10 238863", (None, "", "10 238863", "238863", "partial_parse")),
        ("238863", (None, "", "238863", "238863", "partial_parse")),
        ("10 Orchard Road", (None, None, None, None, "invalid_format")),
        ("", (None, None, None, None, "invalid_format")),
        ("n/a", (None, None, None, None, "placeholder_value")),
        (None, None),
    ],
)
def test_addresses_word_by_word(spark, text, want):
    a = spark.createDataFrame([(text,)], "x string").select(normalize.normalize_address(F.col("x")).alias("a")).first()["a"]
    assert (a and (a["unit_number"], a["street_number"], a["street_name"], a["postal_code"], a["quality"])) == want


def test_tag_or_serial_counts_make_no_pairs(spark):
    """One tag of 20,000 observations, which are 400,000,000 pairs; and ids that come again with other tags, which are met once."""
    many = spark.range(20000).select(F.col("id").alias("observation_id"), F.lit("T").alias("lta_tag"), F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("serial_number"), F.lit("K").alias("product_sku"))
    got = sales.tag_or_serial_counts(many)
    assert [tuple(r) for r in got.groupBy("found").count().collect()] == [(20000, 20000)]
    rows = [(1, "a", "s", "K"), (1, "b", "s", "K"), (1, "a", "s", "K"), (2, "b", None, "K"), (3, None, "s", "K"), (4, None, "s", "L"), (None, "a", None, "K"), (None, "a", "u", None), (5, "c", "s", "K"), (5, "c", "s", "K")]
    few = spark.createDataFrame(rows, "observation_id long, lta_tag string, serial_number string, product_sku string")
    asks = few.withColumnRenamed("observation_id", "ask_id")
    want = {(r["ask_id"], r["count"]) for r in sales.tag_or_serial(few, asks).groupBy("ask_id").count().collect()}
    assert {tuple(r) for r in sales.tag_or_serial_counts(few).collect()} == {tuple(r) for r in sales.tag_or_serial_counts(few, asks).collect()} == want


def test_vehicle_conflicts_are_told_from_components(spark):
    """Tags are counted among the nodes, and rows of observations are dealt out by their node alone."""
    rows = [(1, "a", "s"), (2, "b", "s"), (3, "c", None), (4, None, "s"), (5, None, "u"), (6, "b", None), (7, "d", "v")]
    seen = spark.createDataFrame(rows, "observation_id long, lta_tag string, serial_number string").withColumns({"source_key": F.lit(1), "product_sku": F.lit("K")})
    out = sales.vehicle_identity(seen)
    assert {r["observation_id"]: (r["vehicle_id"], r["identity_conflict"]) for r in out.collect()} == {
        **{i: ("s:|1|K|s", True) for i in (1, 2, 4, 6)}, 3: ("t:c", False), 5: ("s:|1|K|u", False), 7: ("s:|1|K|v", False),
    }
    assert "hashpartitioning(vehicle_id" not in out._jdf.queryExecution().toString() and "count(distinct" not in out._jdf.queryExecution().toString()
