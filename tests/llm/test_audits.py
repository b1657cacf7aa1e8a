"""Decontamination, filter audit and clustering against their SQL on edge cases, and against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("kinweave.llm")

from pyspark.sql import functions as F  # noqa: E402

from kinweave.llm import op11_decontaminate, op12_filter_audit, op13_clusters  # noqa: E402
from tests.llm.test_corpus import EDGE, documents, prose, rows_of  # noqa: E402

ITEM = "item_id long, text string, w string, window int, label int"


def by_sql(tmp_path, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    return rows_of(con.sql(sql))


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], ITEM)


def contaminated_documents(spark):
    passage, other = prose(7, 25), prose(8, 12)
    texts = [
        *EDGE, passage, f"Before, {passage.upper()} after", passage + " " + passage, " ".join(passage.split()[3:13]), " ".join(passage.split()[3:12]), f"{other} x {other} {passage}",
        "alpha", "beta alpha", "Alpha-alpha alpha", "one two", "a one b two one two", passage.replace(" ", "\n\t"), "x " * 3000 + passage + " y" * 3000,
    ]
    docs = documents(spark, texts + [passage] * 4, [*range(len(texts)), 500, 500, None, None])
    bench = items(spark, [(1, passage), (2, other), (2, "alpha"), (3, "one two"), (4, None), (5, " ,;"), (None, passage), (6, " ".join(passage.split()[:11])), (7, passage), (10, prose(99, 40))])
    return docs, bench


def test_decontamination_equals_its_sql_on_edges(spark, tmp_path):
    docs, bench = contaminated_documents(spark)
    got = rows_of(op11_decontaminate.audit(docs, bench))
    assert got == by_sql(tmp_path, op11_decontaminate.ORACLE, documents=docs, benchmark=bench)
    assert sum(r[0] for r in got[1]) > 12


def test_decontamination_in_blocks_has_the_same_rows(spark, monkeypatch):
    docs, bench = contaminated_documents(spark)
    whole = rows_of(op11_decontaminate.audit(docs, bench))
    monkeypatch.setattr(op11_decontaminate, "BLOCK_BYTES", 2000)
    assert op11_decontaminate.windows_of(bench)[0].select("block").distinct().count() > 3
    assert rows_of(op11_decontaminate.audit(docs, bench)) == whole


def test_decontamination_without_items_or_documents(spark):
    docs, bench = contaminated_documents(spark)
    clean = op11_decontaminate.audit(docs, bench.where("false"))
    assert clean.count() == docs.count() and clean.where("contaminated or n_items > 0").count() == 0
    assert op11_decontaminate.audit(docs.where("false"), bench).count() == 0


def test_decontamination_stays_in_the_jvm_and_shuffles_no_text(spark):
    docs, bench = contaminated_documents(spark)
    rows, _ = op11_decontaminate.occurrences(docs, bench)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def audited(spark):
    rows = [
        (1, "word " * 300, None), (2, "Ab cd " * 150, "en"), (3, "Ab cd " * 150, "de"), (4, None, "en"), (5, "", "en"), (6, " ".join(f"w{i}" for i in range(250)), "en"), (7, " ".join(f"w{i}" for i in range(250)), "en"),
        (7, " ".join(f"w{i}" for i in range(250)), "en"), (None, " ".join(f"w{i}" for i in range(250)), "en"), (None, "#", "fr"), (9, "Tab\x0b\x1cApart 100% sure", "fr"), (10, "ÀÉ É ÀÉÀ", ""), (11, prose(3, 20000), "es"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "x", True) for i, t, lang in rows], "doc_id long, text string, lang string, part string, n long, digest string, a boolean")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (3, 1, None), (7, 1, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_filter_audit_equals_its_sql_on_edges(spark, tmp_path):
    docs, labels = audited(spark)
    got = op12_filter_audit.interactions(docs, labels)
    assert got.groupBy("part").count().where("count <> 600").count() == 0 and got.select("part").distinct().count() == 5
    assert rows_of(got) == by_sql(tmp_path, op12_filter_audit.ORACLE, documents=docs, labels=labels)


def test_filter_audit_shares_add_up(spark, data):
    rows = op12_filter_audit.query(spark, data).toPandas()
    whole = rows[rows.filter_order == "ABCDE"].groupby("part")["removed"].sum()
    shares = rows.drop_duplicates(["part", "filter"]).groupby("part")["shapley"].sum()
    assert (shares == 120 * whole).all()


def test_filter_audit_of_empty_tables(spark):
    docs, labels = audited(spark)
    assert op12_filter_audit.interactions(docs.where("false"), labels).count() == 0
    alone = op12_filter_audit.interactions(docs, labels.where("false"))
    assert alone.count() == 3000 and alone.where("good_lost + toxic_lost > 0").count() == 0


VECTOR = "vec_id long, embedding array<float>, q string, n int, cluster string"


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], VECTOR.replace("float", kind))


def uneven(spark):
    r = random.Random(4)
    point = lambda: [r.gauss(0, 1) for _ in range(64)]
    hot = point()
    rows = [(i, hot if i % 3 == 0 else point()) for i in range(200)]
    rows += [(7, point()), (7, point()), (None, point()), (None, hot), (300, None), (301, []), (302, point()[:63]), (303, [*point()[:63], None]), (304, [*point()[:63], math.nan]), (305, [*point()[:63], -math.inf])]
    return vectors(spark, rows)


def test_clusters_equal_their_sql_on_edges(spark, tmp_path):
    frame = uneven(spark)
    got = rows_of(op13_clusters.cluster(frame))
    assert got == by_sql(tmp_path, op13_clusters.ORACLE, embeddings=frame) and len(got[1]) == 204


def clusters_by_hand(rows, dim, clusters, rounds):
    """Every row for itself, with Python's whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    mean = [q for _, q in sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept))[:clusters]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c, strict=True))
    near = lambda q: min(range(len(mean)), key=lambda k: (far(q, mean[k]), k))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q), []).append(q)
        mean = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(mean)]
    return sorted((i, near(q), min(far(q, mean[near(q)]), (1 << 63) - 1)) for i, q in kept)


@pytest.mark.parametrize("scale", [1.0, 5000.0, 1e12])
def test_clusters_of_large_components(spark, scale):
    r = random.Random(int(scale))
    rows = [(i, [r.uniform(-scale, scale) for _ in range(3)]) for i in range(60)]
    got = op13_clusters.cluster(vectors(spark, rows, "double"), clusters=5, dim=3)
    assert sorted((x["vec_id"], x["cluster"], x["distance"]) for x in got.collect()) == clusters_by_hand(rows, 3, 5, 5)


def test_clusters_beyond_a_long_and_without_rows(spark):
    got = op13_clusters.cluster(vectors(spark, [(1, [1e300] * 2), (2, [-1e300] * 2), (3, [0.5] * 2)], "double"), clusters=2, dim=2).collect()
    assert len(got) == 3 and all(0 <= x["distance"] < 1 << 63 for x in got)
    assert op13_clusters.cluster(vectors(spark, [])).count() == 0
    assert op13_clusters.cluster(vectors(spark, [(None, [0.5] * 64)])).count() == 0
    few = op13_clusters.cluster(vectors(spark, [(1, [0.5] * 64), (2, [0.25] * 64)])).collect()
    assert {(x["vec_id"], x["distance"]) for x in few} == {(1, 0), (2, 0)} and len({x["cluster"] for x in few}) == 2


def test_clusters_lloyd_runs_over_distinct_vectors(spark):
    frame = uneven(spark).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x).cast("float")))
    q = op13_clusters.quantised(frame)
    distinct = q.groupBy("q").agg(F.count("*").alias("n"))
    start = op13_clusters.initial(q, 4, "2")
    rows = np.array([np.frombuffer(r["q"], "<i8") for r in q.collect()])
    at, _ = op13_clusters.nearest(rows, start)
    rows = rows.astype(object)  # an infinite component has become a very large one here
    want = [[int(v) for v in rows[at == k].sum(0) // (at == k).sum()] if (at == k).any() else start[k] for k in range(4)]
    assert op13_clusters.moved(distinct, start) == want and distinct.count() < len(rows)
