"""Review: the queue's order, what commands make of a case, pending records, staged sales, locks and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import all_of, any_of, contains_ci, order_nulls_last
from ..staging import cut

#: The state of a case after a command; the last two end it.
COMMANDS = {"assign": "assigned", "unassign": "open", "defer": "deferred", "reopen": "open", "resolve": "resolved", "cancel": "cancelled"}
ENDING = ("resolve", "cancel")
SORTS = {"priority", "confidence", "created_at", "sla_due_at", "queue_state"}
#: Keys of the list, and whether the largest comes first where nothing is said.
ORDERS = {"priority": False, "confidence": True, "sla_due_at": False, "created_at": True, "updated_at": True, "queue_state": False}
CLOSED = ("resolved", "cancelled")


def due(cases: DataFrame) -> DataFrame:
    """Cases with sla_due_at, null where there is no limit."""
    return cases.withColumn("sla_due_at", F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("sla_days") * 86400))


def queue_page(cases: DataFrame, sort: str, descending: bool, skip: int, limit: int) -> DataFrame:
    """One page of the queue: an allowed key, then what is due first, then the oldest, then case_id.

    The page is cut before names are joined, so a queue of any length moves one page.
    """
    if sort not in SORTS:
        raise ValueError(f"cannot sort by {sort}")
    key = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    return cases.orderBy(key, F.col("sla_due_at").asc_nulls_last(), "created_at", "case_id").offset(skip).limit(limit)


#: Filters of the list by name: what they ask of a case with its decision.
FILTERS = {
    "queue_state": lambda v: F.col("queue_state") == v,
    "assigned_to": lambda v: F.col("assigned_to") == v,
    "priority_lte": lambda v: F.col("priority") <= v,
    "priority_gte": lambda v: F.col("priority") >= v,
    "decision": lambda v: F.col("decision") == v,
    "engine": lambda v: F.col("engine") == v,
    "confidence_gte": lambda v: F.col("confidence") >= v,
    "confidence_lte": lambda v: F.col("confidence") <= v,
    "created_after": lambda v: F.col("created_at") >= F.lit(v),
    "created_before": lambda v: F.col("created_at") <= F.lit(v),
    "sla_due_after": lambda v: F.col("sla_due_at") >= F.lit(v),
    "sla_due_before": lambda v: F.col("sla_due_at") <= F.lit(v),
    "overdue_at": lambda v: (F.col("sla_due_at") < F.lit(v)) & ~F.col("queue_state").isin(*CLOSED),
    "resolved": lambda v: F.col("queue_state").isin(*CLOSED) == F.lit(v),
}
#: What a search looks at on each side of a pair.
SEARCHED = ("preferred_full_name", "preferred_phone", "preferred_email")


def _sides(rows: DataFrame, persons: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """rows with left_ and right_ columns of the persons on both sides; null where a side is no person."""
    for side in ("left", "right"):
        own = persons.select(F.col("person_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_known"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        rows = rows.join(own, f"{side}_id", "left")
    return rows


def listed(cases: DataFrame, decisions: DataFrame, persons: DataFrame, involved: DataFrame, q: str | None = None, person_id: int | None = None, **filters) -> DataFrame:
    """Cases of the list with their decision and sla_due_at; a filter of None is not given, unknown ones are refused.

    involved (decision_id, lifecycle_status, is_latest) are the records that decisions are about: a case stays only while every one of
    its records waits for review, or has no state and is expressly the latest. q is looked for, in any case of letters, in the id,
    decision, engine and assignee of a case and in name, phone and mail address of both persons; person_id asks for either side.
    Persons are joined only for these two, so a plain list reads none.
    """
    given = {k: v for k, v in filters.items() if v is not None}
    if unknown := sorted(set(given) - set(FILTERS)):
        raise ValueError(f"no such filters: {unknown}")
    waits = F.coalesce(F.col("lifecycle_status") == "pending_review", F.coalesce("is_latest", F.lit(False)))
    rows = due(cases).join(decisions, "decision_id").where(all_of([FILTERS[k](v) for k, v in given.items()]))
    rows = rows.join(involved.where(~waits).select("decision_id"), "decision_id", "left_anti")
    if person_id is not None:
        asked = persons.where(F.col("person_id") == person_id)
        either = [asked.select(F.lit(True).alias(f"{side}_asked"), F.col("person_id").alias(f"{side}_id")) for side in ("left", "right")]
        rows = rows.where((F.col("left_id") == person_id) | (F.col("right_id") == person_id)).join(either[0], "left_id", "left").join(either[1], "right_id", "left")
        rows = rows.where("left_asked or right_asked").drop("left_asked", "right_asked")
    if q is None:
        return rows
    seen = _sides(rows, persons, SEARCHED).withColumn("case text", F.col("case_id").cast("string"))
    fields = ["case text", "decision", "engine", "assigned_to", *(f"{side}_{c}" for side in ("left", "right") for c in SEARCHED)]
    return seen.where(any_of([F.coalesce(contains_ci(f, q), F.lit(False)) for f in fields])).select(*rows.columns)


def list_page(rows: DataFrame, persons: DataFrame, sort: str | None = None, descending: bool | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of listed rows, then names and states of both persons, which only the page's pairs are joined for.

    Each key has a direction of its own; what is not an allowed key is priority. place, from 1, is the order of the page.
    """
    sort = sort if sort in ORDERS else "priority"
    descending = ORDERS[sort] if descending is None else descending
    order = [order_nulls_last(sort, descending), F.col("sla_due_at").asc_nulls_last(), F.col("created_at").asc(), F.col("case_id").asc()]
    chosen = rows.orderBy(*order).offset(skip).limit(limit)
    # the limit has cut the rows to one page, which one task can number
    placed = cut(chosen.withColumn("place", F.row_number().over(Window.orderBy(*order)) + skip), "cases")
    return _sides(placed, persons, ("preferred_full_name", "status"))


def after_commands(cases: DataFrame, commands: DataFrame) -> DataFrame:
    """cases (case_id, queue_state, assigned_to) after commands (case_id, seq, command, user): the last one before or at the first that ends the case counts.

    Commands on a case that has ended already, and unknown ones, change nothing. applied: how many counted.
    """
    known = commands.where(F.col("command").isin(*COMMANDS)).join(cases.where("queue_state not in ('resolved', 'cancelled')").select("case_id"), "case_id", "left_semi")
    ends = known.where(F.col("command").isin(*ENDING)).groupBy("case_id").agg(F.min("seq").alias("end"))
    counted = known.join(ends, "case_id", "left").where("end is null or seq <= end")
    assigning = F.when(F.col("command").isin("assign", "unassign", "reopen"), F.col("seq"))
    holder = F.struct(F.when(F.col("command") == "assign", F.col("user")).alias("user"))
    last = counted.groupBy("case_id").agg(F.max_by("command", "seq").alias("last"), F.max_by(holder, assigning).alias("holder"), F.count("*").alias("applied"))
    state = F.col("queue_state")
    for command, to in COMMANDS.items():
        state = F.when(F.col("last") == command, to).otherwise(state)
    user = F.when(F.col("holder").isNotNull(), F.col("holder.user")).otherwise(F.col("assigned_to"))
    return cases.join(last, "case_id", "left").select("case_id", state.alias("queue_state"), user.alias("assigned_to"), F.coalesce("applied", F.lit(0)).alias("applied"))


def after_review(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """records (record_id, source_record_id, version, lifecycle_status) after verdicts (record_id, approved) on pending ones.

    An approved record becomes active and the active version of its source record is superseded; of several, the newest is active
    and the others are superseded. A refused one is rejected. Verdicts on records that are not pending change nothing.
    """
    judged = records.join(verdicts, "record_id", "left").withColumn("yes", F.coalesce((F.col("lifecycle_status") == "pending_review") & F.col("approved"), F.lit(False)))
    newest = F.max(F.when(F.col("yes"), F.struct("version", "record_id"))).over(Window.partitionBy("source_record_id"))
    first = newest == F.struct("version", "record_id")
    status = (
        F.when(F.col("yes"), F.when(first, "active").otherwise("superseded")).when((F.col("lifecycle_status") == "pending_review") & ~F.col("approved"), "rejected")
        .when((F.col("lifecycle_status") == "active") & newest.isNotNull(), "superseded").otherwise(F.col("lifecycle_status"))
    )
    return judged.select("record_id", "source_record_id", "version", status.alias("lifecycle_status"))


def review_locks(decisions: DataFrame) -> DataFrame:
    """Locks from decisions that two persons are not one (left_id, right_id): the smaller id first, once a pair, without an end."""
    return decisions.where("left_id <> right_id").select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()


def staged_sale_faults(stages: DataFrame, lines: DataFrame, observations: DataFrame) -> DataFrame:
    """stages (stage_key, stage_hash, record_hash, line_count, observation_count, order_id, entity_key) with fault, the first that holds, or null.

    lines (stage_key, line_index, line_id, product_id, line_hash) and observations (stage_key, observation_index, lta_tag, serial_number, product_sku, observation_hash): as
    many as expected, each with its own index, lines with their own ids, and all with what promoting needs.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    a = lines.groupBy("stage_key").agg(
        F.count("*").alias("n"), F.countDistinct("line_index").alias("places"), F.countDistinct("line_id").alias("ids"), F.bool_and(given("line_id") & given("product_id") & given("line_hash")).alias("whole"),
    )
    known = F.col("lta_tag").isNotNull() | (F.col("serial_number").isNotNull() & F.col("product_sku").isNotNull())
    b = observations.groupBy("stage_key").agg(F.count("*").alias("m"), F.countDistinct("observation_index").alias("spots"), F.bool_and(given("observation_hash") & known).alias("seen"))
    out = stages.join(a, "stage_key", "left").join(b, "stage_key", "left").na.fill(0, ["n", "m"])
    fault = (
        F.when(~F.coalesce(F.col("stage_hash") == F.col("record_hash"), F.lit(False)), "hash_differs").when(~(given("order_id") & given("entity_key")), "order_incomplete")
        .when((F.col("n") == 0) | (F.col("n") != F.col("line_count")), "line_count_differs").when(~F.col("whole"), "line_incomplete").when((F.col("places") < F.col("n")) | (F.col("ids") < F.col("n")), "line_repeated")
        .when(F.col("m") != F.col("observation_count"), "observation_count_differs").when((F.col("m") > 0) & ~F.col("seen"), "observation_incomplete").when((F.col("m") > 0) & (F.col("spots") < F.col("m")), "observation_repeated")
    )
    return out.select(*stages.columns, fault.alias("fault"))


def promoted(stages: DataFrame, faults: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What becomes of staged sales (stage_key) under verdicts (stage_key, approved): promoted, rejected, refused for a fault, or staged as before."""
    out = stages.join(faults.select("stage_key", "fault"), "stage_key", "left").join(verdicts, "stage_key", "left")
    state = F.when(F.col("approved").isNull(), "staged").when(~F.col("approved"), "rejected").when(F.col("fault").isNotNull(), "refused").otherwise("promoted")
    return out.select("stage_key", state.alias("state"))


def retry_admission(asked: DataFrame, analyses: DataFrame, requests: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Retries of failed analyses that users ask for (person_id, actor): state and how many they have left.

    analyses (person_id, analysis_id, status, completed_at): a failure counts where no current analysis is newer. requests (person_id, status, user_retry, actor, requested_at):
    one that is queued or running keeps others out; retries of one actor within the hour count against the limit.
    """
    at = F.struct("completed_at", "analysis_id")
    newest = analyses.groupBy("person_id").agg(F.max(F.when(F.col("status") == "failed", at)).alias("failed"), F.max(F.when(F.col("status") == "current", at)).alias("current"))
    newest = newest.select("person_id", F.coalesce(F.col("failed").isNotNull() & (F.col("current").isNull() | (F.col("failed") > F.col("current"))), F.lit(False)).alias("has_failed"))
    busy = requests.where("status in ('queued', 'running')").select("person_id").distinct().withColumn("busy", F.lit(True))
    recent = requests.where(F.col("user_retry") & (F.col("requested_at") > now - F.expr("interval 1 hour"))).groupBy("person_id", "actor").agg(F.count("*").alias("used"))
    out = asked.join(newest, "person_id", "left").join(busy, "person_id", "left").join(recent, ["person_id", "actor"], "left").na.fill(0, ["used"])
    state = F.when(~F.coalesce("has_failed", F.lit(False)), "not_failed").when(F.col("busy"), "already_active").when(F.col("used") >= most, "retry_limited").otherwise("queued")
    return out.select("person_id", "actor", state.alias("state"), F.greatest(F.lit(0), most - F.col("used") - (state == "queued").cast("int")).cast("long").alias("left"))
