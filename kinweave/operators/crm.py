"""CRM engagement, runs, review queue, late arrival and the stage-history ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import all_of, any_of, contains_ci, days_since
from .persons import live_links

TYPES = {"deal": "crm_deal", "activity": "crm_history", "call": "call", "conversation": "conversation"}


def crm_metrics(records: DataFrame, as_of: Column) -> DataFrame:
    """Per person: counts, first and last moments, the last 30 days (ends included) and days since, in one grouping."""
    seen = live_links(records).where(F.col("record_type").isin(*TYPES.values()))
    recent = (F.col("observed_at") >= as_of - F.expr("interval 30 days")) & (F.col("observed_at") <= as_of)
    aggs = []
    for name, kind in TYPES.items():
        own = F.col("record_type") == kind
        aggs += [F.count_if(own).alias(f"{name}_count"), F.count_if(own & recent).alias(f"recent_30d_{name}_count"), F.max(F.when(own, F.col("observed_at"))).alias(f"last_{name}_at")]
    aggs += [F.min(F.when(F.col("record_type") == "crm_deal", F.col("observed_at"))).alias("first_deal_at"), F.max("observed_at").alias("last_touch_at")]
    out = seen.groupBy("person_id").agg(*aggs)
    return out.withColumns({"days_since_touch": days_since("last_touch_at", as_of), "days_since_deal": days_since("last_deal_at", as_of), "days_since_activity": days_since("last_activity_at", as_of)})


def breakdown(records: DataFrame, record_type: str, by: Column, name: str) -> DataFrame:
    """Counts of one kind of record by a label, as rows: person_id, name, records."""
    return live_links(records).where(F.col("record_type") == record_type).groupBy("person_id", F.coalesce(by, F.lit("unknown")).alias(name)).agg(F.count("*").alias("records"))


def stored_count_drift(stored: DataFrame, records: DataFrame) -> DataFrame:
    """Persons whose stored number of deals differs from the live one: person_id, stored, actual."""
    actual = live_links(records).where("record_type = 'crm_deal'").groupBy("person_id").agg(F.countDistinct("source_record_id").alias("actual"))
    both = stored.join(actual, "person_id", "full").select("person_id", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.where("stored <> actual")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Per source: the newest run and the newest failure."""
    at = F.struct("started_at", "run_id")
    return runs.groupBy("source_key").agg(F.max_by("run_id", at).alias("last_run"), F.max_by("status", at).alias("last_status"), F.max(F.when(F.col("status") == "failed", at))["run_id"].alias("last_failure"), F.count("*").alias("runs"))


def late_arrival(records: DataFrame, observed: str, ingested: str, hours: list[int]) -> DataFrame:
    """Delays from event to ingestion by record type: how many within each bound of hours, the rest, and those that go backwards."""
    delay = F.unix_timestamp(ingested) - F.unix_timestamp(observed)
    cols = [F.count_if((delay >= 0) & (delay <= 3600 * h)).alias(f"within_{h}h") for h in hours]
    return records.groupBy("record_type").agg(F.count("*").alias("records"), *cols, F.count_if(delay > 3600 * max(hours)).alias("later"), F.count_if(delay < 0).alias("negative"), F.count_if(delay.isNull()).alias("unknown"))


def availability(cutoff: Column, report_cutoff: Column, prefix: str = "") -> Column:
    """Whether a record was usable at the cutoff: eleven classes, the first that holds. Columns <prefix>observed_at and so on are timestamps;
    <prefix>invalid marks a lifecycle text that is not a moment."""
    c = lambda n: F.col(f"{prefix}{n}")
    by = lambda n, at: F.coalesce(c(n) <= at, F.lit(False))
    times = [c(n) for n in ("observed_at", "ingested_at", "activated_at")]
    return (
        F.when(F.coalesce(c("invalid"), F.lit(False)), "invalid_lifecycle_timestamp")
        .when(any_of([t.isNull() for t in times]), "historical_availability_unreconstructable")
        .when(any_of([t > report_cutoff for t in times]), "after_report_cutoff")
        .when(by("rejected_at", cutoff), "rejected_by_as_of")
        .when(by("link_failed_at", cutoff), "link_failed_by_as_of")
        .when(by("superseded_at", cutoff), "superseded_by_as_of")
        .when(c("observed_at") > cutoff, "source_event_after_as_of")
        .when((c("ingested_at") > cutoff) | (c("activated_at") > cutoff), "late_arriving_after_as_of")
        .when(by("rejected_at", report_cutoff) | by("link_failed_at", report_cutoff), "available_as_of_later_invalidated")
        .when(by("superseded_at", report_cutoff), "available_as_of_later_superseded")
        .otherwise("available_as_of")
    )


REVIEW = {
    "queue_state": lambda v: F.col("queue_state") == v,
    "open_only": lambda v: F.col("queue_state").isin("resolved", "cancelled") != F.lit(v),
    "assigned_to": lambda v: F.col("assigned_to") == v,
    "unassigned": lambda v: F.col("assigned_to").isNull() == F.lit(v),
    "priority": lambda v: F.col("priority") == v,
    "confidence_min": lambda v: F.col("confidence") >= v,
    "confidence_max": lambda v: F.col("confidence") <= v,
    "engine": lambda v: F.col("engine") == v,
}


def review_queue(cases: DataFrame, decisions: DataFrame, persons: DataFrame, stale: DataFrame | None = None, q: str | None = None, **filters) -> DataFrame:
    """Cases with their decision and the names on both sides. stale (decision_id): cases not shown. q is searched in both names."""
    named = lambda side: persons.select(F.col("person_id").alias(f"{side}_id"), F.col("preferred_full_name").alias(f"{side}_name"))
    out = cases.join(decisions, "decision_id").where(all_of([REVIEW[k](v) for k, v in filters.items() if v is not None]))
    if stale is not None:
        out = out.join(stale.select("decision_id"), "decision_id", "left_anti")
    out = out.join(named("left"), "left_id", "left").join(named("right"), "right_id", "left")
    return out if q is None else out.where(F.coalesce(contains_ci("left_name", q), F.lit(False)) | F.coalesce(contains_ci("right_name", q), F.lit(False)))


def overdue(created: Column, sla_days: Column, now: Column) -> Column:
    return F.coalesce(F.unix_timestamp(created) + sla_days * 86400 < F.unix_timestamp(now), F.lit(False))


def system_match_count(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Open pair decisions per person, on either side: a union of two joins, each decision counted once for a person."""
    open_ = decisions.join(cases.where("queue_state not in ('resolved', 'cancelled')").select("decision_id"), "decision_id", "left_semi")
    sides = open_.select(F.col("left_id").alias("person_id"), "decision_id").union(open_.select("right_id", "decision_id"))
    return sides.groupBy("person_id").agg(F.countDistinct("decision_id").alias("system_match_count"))


def claimable(cases: DataFrame, user: str, pending: DataFrame) -> DataFrame:
    """Cases that a user may claim: open or deferred, unassigned or their own, with a source that is still pending (decision_id)."""
    return cases.where(F.col("queue_state").isin("open", "assigned", "deferred") & (F.col("assigned_to").isNull() | (F.col("assigned_to") == user))).join(pending.select("decision_id"), "decision_id", "left_semi")


# --- stage-history ledger -------------------------------------------------------------------------------------------


def observation_class(rows: DataFrame) -> DataFrame:
    """Rows (identity, hash) to one row per identity and hash: rows, and unique or conflict by the number of hashes."""
    counted = rows.groupBy("identity", "hash").agg(F.count("*").alias("rows"))
    return counted.withColumn("class", F.when(F.count("*").over(Window.partitionBy("identity")) > 1, "conflict").otherwise("unique"))


def parent_class(links: DataFrame) -> DataFrame:
    """links (event, parent, status) to (event, association): one active parent, else one pending, else ambiguous or waiting."""
    n = links.groupBy("event").agg(F.countDistinct(F.when(F.col("status") == "active", F.col("parent"))).alias("a"), F.countDistinct(F.when(F.col("status") == "pending_review", F.col("parent"))).alias("p"))
    cls = F.when(F.col("a") == 1, "selected_active").when(F.col("a") > 1, "ambiguous").when(F.col("p") == 1, "selected_pending_review").when(F.col("p") > 1, "ambiguous").otherwise("waiting")
    return n.select("event", cls.alias("association"))


def authority_ledger(decisions: DataFrame) -> DataFrame:
    """decisions (identity, seq, hash, state, parent) folded in order of seq: repeats of the hash before write nothing.

    kind: accepted where effective, variant where withheld by a conflict, else parent; version counts the decisions written;
    invalidates lists the parents to recompute, the one before and the new one.
    """
    order = Window.partitionBy("identity").orderBy("seq")
    kept = decisions.withColumns({"last_hash": F.lag("hash").over(order), "last_state": F.lag("state").over(order)}).where("not (hash <=> last_hash and state <=> last_state)")
    kind = F.when(F.col("state") == "effective", "accepted").when(F.col("state") == "withheld_conflict", "variant").otherwise("parent")
    before = F.lag(F.when(F.col("state") == "effective", F.col("parent"))).over(order)
    now = F.when(F.col("state") == "effective", F.col("parent"))
    return kept.select("identity", "seq", "hash", "state", kind.alias("kind"), F.row_number().over(order).alias("version"), F.array_sort(F.array_distinct(F.filter(F.array(before, now), lambda x: x.isNotNull()))).alias("invalidates"))


def ledger_head(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("identity").agg(F.max_by(F.struct("version", "state", "hash"), "version").alias("head")).select("identity", "head.version", "head.state", "head.hash")


def stage_timeline(stages: DataFrame, mapping: DataFrame) -> DataFrame:
    """Stages (event_id, category_id, stage_id, ...) with mapped_state by a mapping whose null category fits any; unmapped ones are retired.

    The mapping has a row per stage of a pipeline, so it is small; Spark decides by its size whether to broadcast it.
    """
    exact = mapping.where("category_id is not null").select("category_id", "stage_id", F.col("state").alias("s1"))
    any_ = mapping.where("category_id is null").select("stage_id", F.col("state").alias("s2"))
    joined = stages.join(exact, ["category_id", "stage_id"], "left").join(any_, "stage_id", "left")
    return joined.withColumn("mapped_state", F.coalesce("s1", "s2")).drop("s1", "s2").where("mapped_state is not null")


def stage_inventory(stages: DataFrame, effective: Column) -> DataFrame:
    return stages.groupBy("category_id", "stage_id").agg(F.count_if(effective).alias("effective"), F.count_if(~effective).alias("withheld"))


def reconciliation(ledger: DataFrame, heads: DataFrame, retries: DataFrame) -> DataFrame:
    """One row of error counts: identities twice among the heads, decisions without a head, heads that are not the newest, retries still open."""
    newest = ledger.groupBy("identity").agg(F.max("version").alias("newest"))
    twice = heads.groupBy("identity").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_identity"))
    missing = newest.join(heads, "identity", "left_anti").agg(F.count("*").alias("missing_head"))
    wrong = heads.join(newest, "identity").agg(F.count_if(F.col("version") != F.col("newest")).alias("invalid_selection"))
    open_ = retries.agg(F.count_if(F.col("state").isin("pending", "claimed")).alias("unresolved_retry"))
    return twice.join(missing).join(wrong).join(open_)


def scope_history(scope: DataFrame) -> DataFrame:
    """Observed deal scopes (deal, at, scope) as validity spans: equal neighbours are one span; valid_to is null for the last."""
    order = Window.partitionBy("deal").orderBy("at")
    marked = scope.withColumn("new", F.when(~F.col("scope").eqNullSafe(F.lag("scope").over(order)) | F.lag("at").over(order).isNull(), 1).otherwise(0)).withColumn("sequence", F.sum("new").over(order))
    spans = marked.groupBy("deal", "sequence", "scope").agg(F.min("at").alias("valid_from"), F.count("*").alias("observations"))
    return spans.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("deal").orderBy("sequence")))


def admission(requests: DataFrame, now: Column, hourly: int = 3) -> DataFrame:
    """Analysis requests (person_id, requested_at, force, current_at, same_revision, state) with an outcome, the first that holds:
    already queued, still valid (24 hours and same revision, unless forced), over the hourly budget, else queued."""
    hour = Window.partitionBy("person_id").orderBy(F.unix_timestamp("requested_at")).rangeBetween(-3600, -1)
    fresh = (F.unix_timestamp(now) - F.unix_timestamp("current_at") < 86400) & F.col("same_revision")
    used = F.count_if(F.col("force")).over(hour)
    outcome = F.when(F.col("state").isin("queued", "running"), "already_queued").when(~F.col("force") & F.coalesce(fresh, F.lit(False)), "already_valid").when(F.col("force") & (used >= hourly), "force_limit").otherwise("queued")
    return requests.withColumn("outcome", outcome)
