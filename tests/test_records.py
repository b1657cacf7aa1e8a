"""Histories under review, the outbox, known values in texts, intervals of metrics."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import bootstrap as bs
from kinweave.operators import history as hi
from kinweave.operators import prediction as pr
from kinweave.operators import privacy as pv

ROW = "identity string, moment long, seq long, kind string, hash string, association string, parent string, expected_version long, expected_state string, status string"


def outcomes(spark, rows):
    frame = spark.createDataFrame([(*x, "clash") for x in rows], ROW)
    return {(r["identity"], r["seq"]): r for r in hi.folded(frame).collect()}


def test_commands_apply_to_the_head_that_they_saw(spark):
    rows = [
        ("a", 1, 1, "observed", "h1", "waiting", "p1", None, None),
        ("a", 2, 2, "resolve_parent", None, "selected_active", "p1", 1, "withheld_parent"),
        ("a", 3, 3, "resolve_parent", None, "selected_active", "p1", 1, "withheld_parent"),
        ("a", 4, 4, "observed", "h2", "selected_active", "p1", None, None),
        ("a", 5, 5, "resolve_conflict", "h9", "selected_active", "p1", 3, "withheld_conflict"),
        ("a", 6, 6, "resolve_conflict", "h2", "selected_active", "p2", 3, "withheld_conflict"),
        ("a", 7, 7, "observed", "h2", "selected_active", "p1", None, None),
        ("a", 8, 8, "apply_correction", "h1", "waiting", "p3", 4, "effective"),
        ("a", 9, 9, "apply_correction", "h1", "selected_active", "p3", 4, "effective"),
        ("b", 1, 1, "reject_parent", None, None, None, 1, "withheld_parent"),
        (None, 1, 1, "observed", None, "ambiguous", None, None, None),
        (None, 2, 2, "reject_parent", None, None, None, 1, "withheld_conflict"),
        (None, 3, 3, "forget", None, None, None, 2, "rejected"),
    ]
    got = outcomes(spark, rows[::-1])
    said = {k: (r["status"], r["refusal"], r["version"], r["state"], r["invalidates"]) for k, r in got.items()}
    assert said == {
        ("a", 1): ("written", None, 1, "withheld_parent", []),
        ("a", 2): ("written", None, 2, "effective", ["p1"]),
        ("a", 3): ("refused", "stale_version", 2, "effective", []),
        ("a", 4): ("written", None, 3, "withheld_conflict", ["p1"]),
        ("a", 5): ("refused", "unknown_variant", 3, "withheld_conflict", []),
        ("a", 6): ("written", None, 4, "effective", ["p2"]),
        ("a", 7): ("unchanged", None, 4, "effective", []),
        ("a", 8): ("refused", "parent_not_active", 4, "effective", []),
        ("a", 9): ("written", None, 5, "corrected", ["p2", "p3"]),
        ("b", 1): ("refused", "no_head", 0, None, []),
        (None, 1): ("written", None, 1, "withheld_conflict", []),
        (None, 2): ("written", None, 2, "rejected", []),
        (None, 3): ("refused", "unknown_command", 2, "rejected", []),
    }
    assert got["a", 9]["decision_kind"] == "correction" and got["a", 6]["reason"] == "conflict_resolved"


def test_a_long_history_is_one_stream(spark):
    rows = spark.range(30000).select(
        F.lit("one").alias("identity"), F.col("id").alias("moment"), F.col("id").alias("seq"), F.lit("observed").alias("kind"), F.lit("h").alias("hash"), F.lit("selected_active").alias("association"),
        F.concat(F.lit("p"), F.floor(F.col("id") / 10000)).alias("parent"), F.lit(None).cast("long").alias("expected_version"), F.lit(None).cast("string").alias("expected_state"),
    )
    done = hi.folded(rows.orderBy(F.rand(2))).where("status = 'written'").orderBy("version").collect()
    assert [(r["seq"], r["version"], r["invalidates"]) for r in done] == [(0, 1, ["p0"]), (10000, 2, ["p0", "p1"]), (20000, 3, ["p1", "p2"])]


def test_known_values_are_found_however_they_are_written(spark):
    r = random.Random(3)
    values = [(i, f"+65{r.randrange(80000000, 99999999)}") for i in range(80)] + [(90, "Ａnna Lim"), (91, "S1234567A"), (92, "ab"), (93, None), (94, ""), (95, "blk 10, example street"), (96, "+6580000000"), (97, "+6580000000"), (98, "straße 12")]
    texts = [(i, f"call {values[i][1][:3]} {values[i][1][3:7]}-{values[i][1][7:]}, order {i}") for i in range(60)]
    texts += [(100, "ANNA-LIM, id s1234567a"), (101, "Blk 10 Example Street"), (102, "ab"), (103, "cab abs"), (104, None), (105, ""), (106, "x" * 20000 + "65 8000 0000" + "y" * 20000), (107, "STRASSE12")]
    compact = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum())
    want = set()
    for t, text in texts:
        words = {compact(w) for w in "".join(c if c.isalnum() else " " for c in text or "").split()}
        want |= {(t, o, v) for o, v in values if compact(v) and (compact(v) in compact(text) if len(compact(v)) >= 4 else compact(v) in words)}
    got = pv.values_in(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(values, "owner_id long, value string"))
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want) and len(want) > 66


def test_metrics_are_sums_by_block(spark):
    r = np.random.default_rng(8)
    rows = [(int(i), int(i % 6), float(p), int(r.random() < p)) for i, p in enumerate(r.random(600).round(2))]
    scores = spark.createDataFrame(rows, "row_id long, bucket long, p double, label int")
    got = {x["metric"]: x for x in bs.intervals(scores, [bs.brier(), bs.pr_auc(), bs.lift()], resamples=400).collect()}
    whole = pr.binary_metrics(scores.withColumn("g", F.lit(1)), ["g"]).first()
    old = pr.block_bootstrap(scores, resamples=400).first()
    assert all(abs(got["brier"][c] - old[c]) < 1e-9 for c in ("point", "mean", "lower", "upper"))
    assert abs(got["pr_auc"]["point"] - whole["pr_auc"]) < 0.02 and abs(got["lift"]["point"] - whole["lift_at_capacity"]) < 0.1
    assert all(x["lower"] <= x["point"] <= x["upper"] for x in got.values())
    assert bs.intervals(scores.where("false"), [bs.brier()]).count() == 0
    none = bs.intervals(scores.withColumn("label", F.lit(0)), [bs.pr_auc(), bs.lift()], resamples=10).collect()
    assert all(x["point"] == 0 for x in none)


def test_a_metric_of_ones_own(spark):
    scores = spark.createDataFrame([(1, 0.2, 1), (1, 0.4, 0), (2, 0.9, 1)], "bucket long, p double, label int")
    mean = bs.Metric("mean", ((F.lit(0), F.col("p")), (F.lit(1), F.lit(1.0))), 2, lambda s: s[:, 0] / s[:, 1])
    assert bs.intervals(scores, [mean], resamples=50).first()["point"] == pytest.approx(0.5)
