"""Sales-conversion prediction: labels, point-in-time features, folds, metrics, model.

events (parent, event_id, mapped_state, event_at, head_version, ...), versions (parent, version_key, version, lifecycle_status,
observed_at, entity_key, ...). Everything at a snapshot S uses rows of event_at or observed_at up to S alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .connections import cut

LIVE = ("active", "pending_review")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _order() -> list:
    return ["event_at", "head_version", "event_id"]


def open_entries(events: DataFrame) -> DataFrame:
    """Events that open an episode, with episode: open now, and not open just before; episode counts from 1."""
    w = Window.partitionBy("parent").orderBy(*_order())
    marked = events.withColumn("entry", (F.col("mapped_state") == "open") & ~F.coalesce(F.lag("mapped_state").over(w) == "open", F.lit(False)))
    counted = marked.withColumn("episode", F.sum(F.col("entry").cast("int")).over(w))
    return counted.where("entry").drop("entry")


def invalid_parents(rows: DataFrame, valid: Column) -> DataFrame:
    """Parents of rows that fail validation: any bad row censors its parent."""
    return rows.where(~F.coalesce(valid, F.lit(False))).select("parent").distinct()


def live_entity(versions: DataFrame) -> DataFrame:
    """(parent, entity_key, entity_state) over live versions: resolved if all have one and the same key, else ambiguous."""
    live = versions.where(F.col("lifecycle_status").isin(*LIVE) & F.col("timestamps_valid"))
    n = live.groupBy("parent").agg(F.countDistinct("entity_key").alias("n"), F.count_if(F.col("entity_key").isNull()).alias("none"), F.min("entity_key").alias("k"))
    ok = (F.col("n") == 1) & (F.col("none") == 0)
    return n.select("parent", F.when(ok, F.col("k")).alias("entity_key"), F.when(ok, "resolved").otherwise("ambiguous").alias("entity_state"))


def amount_version(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """entries (parent, event_id, event_at) with the version observed at or before, the newest; as-of join by one window.

    Versions and entries of a parent are put in one order and the last version is carried forward, which needs one shuffle and no pairs.
    """
    fine = versions.where((F.col("lifecycle_status") != "rejected") & F.col("timestamps_valid") & F.col("observed_at").isNotNull())
    v = fine.select("parent", F.col("observed_at").alias("at"), F.lit(0).alias("side"), F.struct("observed_at", "version", "version_key", "amount_value", "amount_state", "currency_status", "contact_count").alias("v"), F.lit(None).cast("bigint").alias("event_id"))
    e = entries.select("parent", F.col("event_at").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(v.schema["v"].dataType).alias("v"), "event_id")
    # within one moment versions come before entries, the smaller before the larger
    w = Window.partitionBy("parent").orderBy("at", "side", F.col("v.version").asc_nulls_last(), F.col("v.version_key").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = v.unionByName(e).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1")
    return entries.join(carried.select("event_id", "v"), "event_id")


def retrospective_labels(events: DataFrame, versions: DataFrame, entities: list, cutoff: Column, horizon: str = "30 days", invalid: DataFrame | None = None, authority: bool = True) -> DataFrame:
    """One row per episode entry: status and reason, the first that holds of eleven, with its amount version."""
    timeline = Window.partitionBy("parent").orderBy(*_order())
    # the next win strictly after an event, carried back along the timeline; wins of the same moment do not count
    won_at = F.min(F.when(F.col("mapped_state") == "won", micros("event_at"))).over(Window.partitionBy("parent").orderBy(micros("event_at")).rangeBetween(1, Window.unboundedFollowing))
    at_moment = F.first("mapped_state").over(Window.partitionBy("parent", "event_at").orderBy(F.desc("head_version"), F.desc("event_id")))
    seen = events.withColumns({"next_won": won_at, "state_at": at_moment})
    entry = (F.col("mapped_state") == "open") & ~F.coalesce(F.lag("mapped_state").over(timeline) == "open", F.lit(False))
    entries = seen.withColumn("entry", entry).where("entry").drop("entry")
    out = amount_version(entries, versions).join(live_entity(versions), "parent", "left")
    out = out.withColumn("bad", F.lit(False)) if invalid is None else out.join(invalid.withColumn("bad", F.lit(True)), "parent", "left").na.fill(False, ["bad"])
    end = F.col("event_at") + F.expr(f"interval {horizon}")
    mature = end <= cutoff
    currency = F.col("v.currency_status")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    won = F.col("next_won") <= F.unix_micros(end.cast("timestamp"))
    steps = [
        (F.lit(not authority), "censored", "source_authority_incomplete"),
        (F.col("bad"), "censored", "invalid_stage_timestamp"),
        (F.col("entity_state").isNull(), "censored", "missing_parent_at_snapshot"),
        (F.col("entity_state") == "ambiguous", "censored", "selected_parent_ambiguity"),
        (~F.col("entity_key").isin(*entities), "ineligible", "unsupported_entity"),
        (F.col("state_at") != "open", "ineligible", "not_open_retrospective"),
        (currency == "unsupported", "ineligible", "unsupported_currency"),
        (currency == "invalid", "censored", "invalid_currency"),
        (~mature, "unknown", "immature_horizon"),
        (won, "positive", "first_won_in_horizon"),
    ]
    status = reason = None
    for test, s, r in steps:
        status = F.when(is_(test), s) if status is None else status.when(is_(test), s)
        reason = F.when(is_(test), r) if reason is None else reason.when(is_(test), r)
    return out.select("parent", "event_id", F.col("event_at").alias("snapshot_at"), F.coalesce(F.col("entity_key"), F.lit(-1)).alias("entity_key"), status.otherwise("negative").alias("status"), reason.otherwise("mature_no_first_won").alias("reason"), mature.alias("mature"), F.coalesce(F.col("v.amount_state"), F.lit("not_reconstructable")).alias("amount_state"), F.coalesce(currency, F.lit("not_reconstructable")).alias("currency_status"))


def features(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Features of each episode entry at its moment S; counts and the previous event lie strictly before S."""
    rows = Window.partitionBy("parent").orderBy(*_order())
    before = Window.partitionBy("parent").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("parent").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    prev = F.lag("mapped_state").over(rows)
    marked = events.withColumns({"at": micros("event_at"), "entry": (F.col("mapped_state") == "open") & ~F.coalesce(prev == "open", F.lit(False)), "turn": F.coalesce(prev != F.col("mapped_state"), F.lit(False))})
    counted = marked.withColumns({
        "episode": F.sum(F.col("entry").cast("int")).over(rows),
        "deal_age_days": (F.col("at") - F.min("at").over(upto)) / 86400e6,
        "days_since_prev": F.coalesce((F.col("at") - F.max("at").over(before)) / 86400e6, F.lit(0.0)),
        "prior_transitions": F.count_if("turn").over(before), "prior_won": F.count_if(F.col("mapped_state") == "won").over(before), "prior_lost": F.count_if(F.col("mapped_state") == "lost").over(before),
    })
    out = amount_version(counted.where("entry"), versions)
    age = (F.col("at") - micros("v.observed_at")) / 86400e6
    state, currency = F.coalesce(F.col("v.amount_state"), F.lit("not_reconstructable")), F.coalesce(F.col("v.currency_status"), F.lit("not_reconstructable"))
    gone = ("not_reconstructable", "missing", "unavailable")
    missing = state.isin(*gone).cast("int") + currency.isin(*gone).cast("int") + F.col("v.amount_value").isNull().cast("int") + age.isNull().cast("int")
    turn = 2 * np.pi * F.month("event_at") / 12
    return out.select(
        "parent", "event_id", "episode", "deal_age_days", "days_since_prev", "prior_transitions", "prior_won", "prior_lost", "stage_id", "category_id", F.col("v.amount_value").alias("amount_value"), state.alias("amount_state"), currency.alias("currency_status"),
        (state == "known").cast("int").alias("amount_known"), F.coalesce((F.col("v.amount_value") > 0).cast("int"), F.lit(0)).alias("amount_nonzero"), F.coalesce(F.col("v.contact_count"), F.lit(0)).alias("contact_count"),
        age.alias("version_age_days"), F.sin(turn).alias("month_sin"), F.cos(turn).alias("month_cos"), missing.alias("missingness"),
    )


def sufficiency(status: Column, missing: Column) -> Column:
    return F.when(~status.isin("positive", "negative"), "insufficient").when(missing == 0, "sufficient").when(missing <= 2, "limited").otherwise("insufficient")


def row_id(parent: Column, snapshot: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", parent.cast("string"), F.date_format(snapshot, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), 256), 1, 16)


def temporal_folds(rows: DataFrame, least: int = 3) -> DataFrame:
    """rows (row_id, bucket, deal_key, person_key) to (test_bucket, row_id, side): train on all earlier buckets, at least so many.

    Training rows whose deal or person is also in the test bucket are left out. A bucket carries the list of later ones, of which there is one
    for a month, so rows meet it by their own bucket.
    """
    buckets = rows.select("bucket").distinct().withColumn("at", F.row_number().over(Window.orderBy("bucket")))
    is_test = F.when(F.col("at") > least, F.col("bucket"))
    after = Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    lists = saved(buckets.select("bucket", is_test.alias("test_bucket"), F.collect_list(is_test).over(after).alias("later")), "buckets")
    near = rows.join(lists, "bucket")
    test = near.where("test_bucket is not null").select("test_bucket", "row_id", "deal_key", "person_key")
    train = near.select(F.explode("later").alias("test_bucket"), "row_id", "deal_key", "person_key")
    clean = train.join(test.select("test_bucket", "deal_key").distinct(), ["test_bucket", "deal_key"], "left_anti")
    clean = clean.join(test.where("person_key is not null").select("test_bucket", "person_key").distinct(), ["test_bucket", "person_key"], "left_anti")
    return clean.select("test_bucket", "row_id", F.lit("train").alias("side")).union(test.select("test_bucket", "row_id", F.lit("test").alias("side")))


def ranked(scores: DataFrame, group: list[str]) -> DataFrame:
    """Scores (row_id, p, label) with rank by p, the running number of positives tp, and the totals n and pos. Groups are test periods.

    Rows are dealt by ranges of group and score, so one period of all rows is ranked by all tasks: each range is ranked by itself,
    and ranges add what comes before them in their group. Null groups are a group.
    """
    order = [F.desc("p"), F.col("row_id")]
    dealt = saved(saved(scores, "scores").repartitionByRange(*(F.col(c) for c in group), *order).withColumn("range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*group, "range").orderBy(*order)
    local = dealt.withColumns({"rank": F.row_number().over(own), "tp": F.sum("label").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    totals = dealt.groupBy(*group, "range").agg(F.count("*").alias("own_n"), F.sum("label").alias("own_pos"))  # a row for each range of a group
    before, whole = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    sums = {"n_before": F.coalesce(F.sum("own_n").over(before), F.lit(0)), "pos_before": F.coalesce(F.sum("own_pos").over(before), F.lit(0)), "n": F.sum("own_n").over(whole), "pos": F.sum("own_pos").over(whole)}
    totals = saved(totals.withColumns(sums), "range-totals").drop("own_n", "own_pos")
    marked = totals.select(F.struct(*group, "range").alias("place"), "n_before", "pos_before", "n", "pos")
    out = local.withColumn("place", F.struct(*group, "range")).join(marked, "place").withColumns({"rank": F.col("rank") + F.col("n_before"), "tp": F.col("tp") + F.col("pos_before")})
    return out.drop("place", "range", "n_before", "pos_before")


def binary_metrics(scores: DataFrame, group: list[str], share: float = 0.10, bins: int = 10) -> DataFrame:
    """Per group: precision and lift at capacity, area under precision and recall, Brier score, log loss, calibration error."""
    r = ranked(scores, group)
    cap = F.greatest(F.lit(1), F.ceil(share * F.col("n")))
    p = F.greatest(F.lit(1e-15), F.least(F.col("p"), F.lit(1 - 1e-15)))
    agg = r.groupBy(*group).agg(
        F.count("*").alias("test_count"), F.sum("label").alias("positive_count"), F.max(cap).alias("capacity"),
        (F.sum(F.when(F.col("rank") <= cap, F.col("label")).otherwise(0)) / F.max(cap)).alias("precision_at_capacity"),
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("tp") / F.col("rank"))) / F.max("pos"), F.lit(0.0)).alias("pr_auc"),
        F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"), (-F.avg(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))).alias("log_loss"),
    )
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    per = scores.withColumn("bin", bin_).groupBy(*group, "bin").agg(F.count("*").alias("k"), F.abs(F.avg("label") - F.avg("p")).alias("gap"))
    ece = per.groupBy(*group).agg((F.sum(F.col("k") * F.col("gap")) / F.sum("k")).alias("ece"))
    lift = F.when(F.col("positive_count") > 0, F.col("precision_at_capacity") * F.col("test_count") / F.col("positive_count")).otherwise(0.0)
    return agg.join(ece, group).withColumn("lift_at_capacity", lift)


def block_bootstrap(scores: DataFrame, resamples: int = 1000, seed: int = 42, bucket: str = "bucket") -> DataFrame:
    """Block bootstrap of the Brier score: buckets are drawn with replacement; (point, mean, lower, upper).

    Sums by bucket are enough, one row per month; the draws are made from those.
    """
    sums = scores.groupBy(bucket).agg(F.sum(F.pow(F.col("p") - F.col("label"), 2)).alias("s"), F.count("*").alias("n")).orderBy(bucket)

    def draw(frames):
        rows = pd.concat(list(frames)) if frames else pd.DataFrame()
        if not len(rows):
            return
        rows = rows.sort_values(bucket)
        s, n = rows["s"].to_numpy(float), rows["n"].to_numpy(float)
        picks = np.random.default_rng(seed).integers(0, len(s), (resamples, len(s)))
        values = np.sort(s[picks].sum(1) / n[picks].sum(1))
        yield pd.DataFrame({"point": [s.sum() / n.sum()], "mean": [values.mean()], "lower": [values[int(0.025 * resamples)]], "upper": [values[int(0.975 * resamples)]]})

    return sums.coalesce(1).mapInPandas(draw, "point double, mean double, lower double, upper double")


def logistic_model(rows: DataFrame, columns: list[str], l2: float = 1.0, rounds: int = 8) -> DataFrame:
    """L2 logistic regression by Newton steps, as rows (name, weight). label and columns are numbers; null counts as 0.

    Each step is one aggregation of the gradient and the curvature, (p + 1)^2 sums however many rows there are; the solution of that
    small system is found on the driver.
    """
    x = [F.lit(1.0)] + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    data = rows.select(F.col("label").cast("double").alias("label"), *(v.alias(f"x{i}") for i, v in enumerate(x)))
    p = len(x)
    w, ridge = np.zeros(p), np.full(p, l2)
    ridge[0] = 1e-9
    for _ in range(rounds):
        z = sum((F.col(f"x{i}") * float(w[i]) for i in range(p)), F.lit(0.0))
        q = 1 / (1 + F.exp(-z))
        step = data.withColumn("q", q)
        sums = [F.sum((F.col("label") - F.col("q")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)] + [F.sum(F.col("q") * (1 - F.col("q")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        got = step.agg(*sums).first()  # one row of (p + 1)(p + 2) / 2 numbers
        if got["g0"] is None:
            break
        g = np.array([got[f"g{i}"] for i in range(p)]) - ridge * w
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) + np.diag(ridge)
        change = np.linalg.solve(h, g)
        w = w + change
        if np.abs(change).max() < 1e-8:
            break
    return rows.sparkSession.createDataFrame(list(zip(["intercept", *columns], map(float, w), strict=True)), "name string, weight double")


def score_model(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows with p, by column arithmetic."""
    z = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items() if c != "intercept"), F.lit(weights.get("intercept", 0.0)))
    return rows.withColumn("p", 1 / (1 + F.exp(-z)))


def platt_scaling(scores: DataFrame, rounds: int = 20) -> DataFrame:
    """Platt scaling of scores (p, label 0 or 1), as rows (name, weight): a slope on p and an intercept, for score_model.

    Targets are smoothed to (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), so the fit stays finite on classes that p parts wholly. Rows without a
    score or a label teach nothing; without rows both numbers are 0.
    """
    known = scores.where("p is not null and label is not null").select("p", F.col("label").cast("int").alias("label"))
    n1, n0 = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    target = F.when(F.col("label") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    return logistic_model(known.withColumn("label", target), ["p"], 1e-6, rounds)


def rules_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows with p, the share of positives among the training rows; 0 without any."""
    return test.join(F.broadcast(train.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("p"))))  # one row


def random_baseline(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows with p, uniform in [0, 1) and fixed by the key and a seed, so that it does not depend on the order of rows."""
    return rows.withColumn("p", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))


#: The least volumes of each decision: matured deals, positive deals, negative deals, months, temporal folds.
GATE = {"go": (2000, 200, 500, 6, 2), "rules_only": (500, 50, 200, 3, 0)}


def gate_decision(*volumes: Column) -> Column:
    """The first decision of GATE whose volumes are all reached, else collect_more_data."""
    out = F
    for name, least in GATE.items():
        out = out.when(reduce(lambda x, y: x & y, (v >= n for v, n in zip(volumes, least, strict=True))), name)
    return out.otherwise("collect_more_data")


def gate_report(labels: DataFrame, folds: Column) -> DataFrame:
    """Totals and the decision, over the number of temporal folds that the caller found."""
    per = labels.groupBy("parent").agg(F.max(F.col("status") == "positive").alias("pos"), F.max(F.col("status") == "negative").alias("neg"), F.max("mature").alias("mature"), F.collect_set(F.date_format("snapshot_at", "yyyy-MM")).alias("months"))
    deals = per.agg(
        F.count_if("mature").alias("matured_deals"), F.count_if("pos").alias("positives"), F.count_if(F.col("neg") & ~F.col("pos")).alias("negatives"),
        F.size(F.array_distinct(F.flatten(F.collect_set("months")))).cast("long").alias("months"),
    ).withColumn("folds", folds)
    return deals.withColumn("decision", gate_decision(*(F.col(c) for c in ("matured_deals", "positives", "negatives", "months", "folds"))))


def as_known(entries: DataFrame, events: DataFrame, versions: DataFrame) -> DataFrame:
    """entries (parent, event_id, at) with what was known of the parent at that moment, by one ordered pass over each parent.

    state: that of the last event that had happened and was available; late: something other than open had happened and was not yet available;
    n: how many versions were in force, and v, a struct of the columns of the only one. A version is in force from when it was observed,
    ingested and activated until it was superseded, rejected or its link failed. selection says why there is none. won and won_known:
    order and availability of the first win.

    Every moment at which something changes is a row of a timeline: an event happens, an event is known, a version begins or ends. Running
    maxima and sums over it are the state at each entry, so a parent costs its events and entries and not their product. The one
    version in force is told by a running sum of numbers that versions have within their parent.
    """
    numbered = versions.withColumns({
        "number": F.row_number().over(Window.partitionBy("parent").orderBy("version_key")),
        "began": F.when(F.col("timestamps_valid") & F.col("observed_at").isNotNull() & F.col("ingested_at").isNotNull() & F.col("activated_at").isNotNull(), F.greatest("observed_at", "ingested_at", "activated_at")),
        "ended": F.least("superseded_at", "rejected_at", "link_failed_at"),
    })
    numbered = saved(numbered, "versions-numbered")
    moved = numbered.where("began is not null and (ended is null or ended > began)").withColumn("number", F.col("number").cast("long"))
    none = {"kind": F.lit(0), "event_id": F.lit(None).cast(events.schema["event_id"].dataType), "known": F.lit(None), "late": F.lit(0), "live": F.lit(0), "number": F.lit(0).cast("long")}
    row = lambda df, at, **set_: df.select("parent", F.col(at).alias("at"), *((set_.get(k, v)).alias(k) for k, v in none.items()))
    order = F.struct(*(F.col(c) for c in _order()), F.col("mapped_state").alias("state"))
    closing = (F.col("mapped_state") != "open").cast("int")
    told = events.where("event_at is not null and available_at is not null").withColumn("known_at", F.greatest("event_at", "available_at"))
    happened = row(told, "event_at", late=closing)
    known = row(told, "known_at", known=order, late=-closing)
    begins, ends = row(moved, "began", live=F.lit(1), number=F.col("number")), row(moved.where("ended is not null"), "ended", live=F.lit(-1), number=-F.col("number"))
    asked = row(entries, "at", kind=F.lit(1), event_id=F.col("event_id"))
    timeline = known.unionByName(happened).unionByName(begins).unionByName(ends).unionByName(asked)
    so_far = Window.partitionBy("parent").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = timeline.withColumns({"last": F.max("known").over(so_far), "open_late": F.sum("late").over(so_far), "n": F.sum("live").over(so_far), "only": F.sum("number").over(so_far)}).where("kind = 1")
    swept = swept.select("parent", "event_id", "at", F.col("last.state").alias("state"), (F.col("open_late") > 0).alias("late"), F.col("n").cast("long").alias("n"), F.when(F.col("n") == 1, F.col("only")).alias("only"))
    wins = events.where("mapped_state = 'won'").groupBy("parent").agg(F.min(F.struct(*(F.col(c) for c in _order()), F.col("available_at"))).alias("won"))
    invalid = numbered.groupBy("parent").agg(F.bool_or(~F.col("timestamps_valid")).alias("invalid"))
    chosen = numbered.select("parent", F.col("number").cast("long").alias("only"), F.struct(*versions.columns).alias("v"))
    out = swept.join(chosen, ["parent", "only"], "left").join(wins, "parent", "left").join(invalid, "parent", "left")
    why = F.when(F.col("n") == 1, "selected").when(F.col("n") > 1, "selected_parent_ambiguity").when(F.coalesce("invalid", F.lit(False)), "invalid_parent_timestamp").otherwise("missing_parent_at_snapshot")
    return out.select("parent", "event_id", "at", "state", "late", "won", F.col("won.available_at").alias("won_known"), "v", why.alias("selection"))


def operational_labels(events: DataFrame, versions: DataFrame, entities: list, cutoff: Column, horizon_days: int) -> DataFrame:
    """A label as it could be known at the time for each entry into an open episode: parent, event_id, snapshot_at, status, reason.

    events (parent, event_id, mapped_state, event_at, available_at, head_version, valid): a snapshot is when the entry had happened and was available.
    What happened by then but was not yet available censors it; the state known by then must be open.
    """
    bad = invalid_parents(events, F.col("valid"))
    entries = open_entries(events).select("parent", "event_id", F.greatest("event_at", "available_at").alias("at"))
    out = as_known(entries, events, versions).join(bad.withColumn("bad", F.lit(True)), "parent", "left")
    end = F.col("at") + F.expr(f"interval {horizon_days} days")
    first = F.col("won.event_at")
    linked = (F.col("v.linked_persons") == 1) & (F.col("v.active_persons") == 1) & F.coalesce(F.col("v.linked_at") <= F.col("at"), F.lit(False))
    hit = F.coalesce((first > F.col("at")) & (first <= end), F.lit(False))
    rules = [
        (F.coalesce("bad", F.lit(False)), "censored", F.lit("invalid_stage_timestamp")), (F.col("v").isNull(), "censored", F.col("selection")),
        (~F.coalesce(F.col("v.entity_key").isin(*entities), F.lit(False)), "ineligible", F.lit("unsupported_entity")), (F.col("v.currency_status") == "unsupported", "ineligible", F.lit("unsupported_currency")),
        (F.col("v.currency_status") == "invalid", "censored", F.lit("invalid_currency")), (~F.coalesce(linked, F.lit(False)), "censored", F.lit("ambiguous_or_late_person_link")),
        (F.col("late"), "censored", F.lit("censored_retrospective_disqualifier")), (~F.coalesce(F.col("state") == "open", F.lit(False)), "ineligible", F.lit("not_open_as_known")),
        (hit & (F.col("won_known") > cutoff), "censored", F.lit("won_unavailable_by_cutoff")), (hit, "positive", F.lit("first_won_in_horizon")), (end > cutoff, "unknown", F.lit("immature_horizon")),
    ]
    status = reason = F
    for holds, s, r in rules:
        status, reason = status.when(holds, s), reason.when(holds, r)
    return out.select("parent", "event_id", F.col("at").alias("snapshot_at"), status.otherwise("negative").alias("status"), reason.otherwise("mature_no_first_won").alias("reason"))


def saved(df: DataFrame, name: str) -> DataFrame:
    return cut(df, name)
