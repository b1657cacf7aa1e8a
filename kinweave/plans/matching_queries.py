"""Queries on identity resolution and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import edge_active
from ..operators import matching as mt
from ..operators import prediction as pr
from .catalog import query
from .views import Views

CUTOFF = "TIMESTAMP '2024-01-25 00:00:00'"

# Persons stand in for incoming records too: a record's identifiers are those of the person with the same number.
FAN = "(SELECT identifier_type, normalized_value, count(DISTINCT person_id) AS fanout FROM identified_by WHERE is_active GROUP BY ALL)"
CAPPED = f"SELECT * FROM {FAN} WHERE fanout <= CASE identifier_type WHEN 'phone' THEN 50 WHEN 'email' THEN 100 ELSE 5 END"
KEYS = f"SELECT DISTINCT i.identifier_type, i.normalized_value, i.person_id FROM identified_by i JOIN ({CAPPED}) f USING (identifier_type, normalized_value) JOIN person p USING (person_id) WHERE i.is_active AND i.quality_flag IN ('valid', 'partial_parse') AND p.status = 'active'"
CANDIDATES = f"SELECT DISTINCT r.person_id AS record_id, k.person_id FROM identified_by r JOIN ({KEYS}) k USING (identifier_type, normalized_value) WHERE r.quality_flag IN ('valid', 'partial_parse') AND r.person_id <> k.person_id"
LOCKS = "(SELECT a, b FROM no_match_lock WHERE expires_at IS NULL OR expires_at > 200 UNION SELECT b, a FROM no_match_lock WHERE expires_at IS NULL OR expires_at > 200)"


def incoming(v: Views):
    """Identifiers of records; position is their order."""
    kind = F.when(F.col("identifier_type") == "nric", 1).when(F.col("identifier_type") == "phone", 2).otherwise(3)
    return v.identified_by.select(F.col("person_id").alias("record_id"), "identifier_type", "normalized_value", "is_verified", "quality_flag", kind.alias("position"))


def found(v: Views):
    return mt.candidates(incoming(v), v.identified_by, v.person).where("record_id <> person_id")


@query(f"SELECT identifier_type, normalized_value, fanout, fanout <= CASE identifier_type WHEN 'phone' THEN 50 WHEN 'email' THEN 100 ELSE 5 END AS usable FROM {FAN}")
def fanout_cap(v: Views):
    return mt.fanout(v.identified_by).withColumn("usable", mt.within_cap(F.col("identifier_type"), F.col("fanout")))


@query(CANDIDATES)
def candidate_generation(v: Views):
    return found(v)


@query(f"""
    WITH c AS ({CANDIDATES}), l AS {LOCKS}
    SELECT DISTINCT c.record_id, c.person_id FROM c JOIN identified_by r ON r.person_id = c.record_id AND r.quality_flag IN ('valid', 'partial_parse') JOIN identified_by o USING (identifier_type, normalized_value) JOIN person p ON p.person_id = o.person_id AND p.status = 'active'
      JOIN l ON l.a = o.person_id AND l.b = c.person_id WHERE o.is_active""")
def lock_veto(v: Views):
    return mt.locked_candidates(found(v), incoming(v), v.identified_by, v.person, v.no_match_lock, 200)


@query(f"""
    WITH c AS ({CANDIDATES}), g AS (SELECT c.record_id, c.person_id, bool_or(h.normalized_value = r.normalized_value) AS same FROM c JOIN identified_by r ON r.person_id = c.record_id AND r.identifier_type = 'nric' AND r.quality_flag = 'valid'
      JOIN identified_by h ON h.person_id = c.person_id AND h.identifier_type = 'nric' AND h.quality_flag = 'valid' AND h.is_active GROUP BY ALL)
    SELECT c.record_id, c.person_id, CASE WHEN same THEN 'government_id' WHEN NOT same THEN 'government_id_conflict' END AS rule, CASE WHEN same THEN 'merge' WHEN NOT same THEN 'no_match' END AS verdict FROM c LEFT JOIN g USING (record_id, person_id)""")
def deterministic_rules(v: Views):
    return mt.deterministic(found(v).withColumn("record_type", F.lit("identity")), incoming(v), v.identified_by).drop("record_type")


EVIDENCE = f"""c AS ({CANDIDATES}), held AS (SELECT person_id, identifier_type, normalized_value, bool_or(is_verified) AS hv FROM identified_by WHERE is_active AND quality_flag IN ('valid', 'partial_parse') GROUP BY ALL),
    ex AS (SELECT c.record_id, c.person_id, r.identifier_type, h.hv IS NOT NULL AS hit, CASE WHEN h.hv IS NULL THEN 0::DOUBLE WHEN r.is_verified AND h.hv THEN 0.35 ELSE 0.20 END + CASE WHEN h.hv IS NOT NULL AND r.identifier_type = 'phone' AND f.fanout > 5 THEN -0.25 ELSE 0 END AS w, h.hv IS NOT NULL AND r.identifier_type = 'phone' AND coalesce(f.fanout, 0) > 5 AS hot
      FROM c JOIN identified_by r ON r.person_id = c.record_id AND r.identifier_type IN ('phone', 'email') LEFT JOIN held h ON h.person_id = c.person_id AND h.identifier_type = r.identifier_type AND h.normalized_value = r.normalized_value
      LEFT JOIN {FAN} f ON f.identifier_type = r.identifier_type AND f.normalized_value = r.normalized_value),
    ev AS (SELECT record_id, person_id, sum(w) AS evidence, bool_or(hit AND identifier_type = 'phone') AS phone_exact, bool_or(hit AND identifier_type = 'email') AS email_exact, bool_or(hot) AS high_fanout FROM ex GROUP BY ALL)"""
SCORED = f"""{EVIDENCE},
    sc AS (SELECT e.*, a.preferred_dob AS dob, b.preferred_dob AS held_dob, floor(e.record_id / 4) = floor(e.person_id / 4) AS address_match FROM ev e JOIN person a ON a.person_id = e.record_id JOIN person b ON b.person_id = e.person_id),
    conf AS (SELECT *, greatest(0, least(1, round(least(evidence, 0.85) + CASE WHEN dob = held_dob THEN 0.25 ELSE -0.30 END + CASE WHEN address_match THEN 0.10 ELSE 0 END, 6)))::DOUBLE AS confidence, dob <> held_dob OR high_fanout AS hard_conflict FROM sc)"""


def scored(v: Views):
    """Score without names, so that SQL gives the same; names enter through name_similarity in match_full."""
    evidence = mt.identifier_evidence(found(v), incoming(v), v.identified_by, near=False)
    born = v.person.select(F.col("person_id").alias("record_id"), F.col("preferred_dob").alias("dob"))
    held = v.person.select("person_id", F.array("preferred_dob").alias("held_dobs"))
    rows = evidence.join(born, "record_id").join(held, "person_id").withColumns({"address_match": F.floor(F.col("record_id") / 4) == F.floor(F.col("person_id") / 4), "name_similarity": F.lit(None).cast("double"), "record_type": F.lit("identity")})
    return mt.scored(rows)


@query(f"WITH {SCORED} SELECT record_id, person_id, round(evidence, 6) AS evidence, phone_exact, email_exact, high_fanout, confidence, hard_conflict, CASE WHEN confidence >= 0.4 THEN 'merge' WHEN confidence >= 0.2 THEN 'review' ELSE 'no_match' END AS decision FROM conf")
def heuristic_score(v: Views):
    return scored(v).select("record_id", "person_id", F.round("evidence", 6).alias("evidence"), "phone_exact", "email_exact", "high_fanout", "confidence", "hard_conflict", "decision")


@query(f"""
    WITH {SCORED}, b AS (SELECT *, CASE WHEN confidence >= 0.4 THEN 0 WHEN confidence >= 0.2 THEN 1 ELSE 2 END AS k FROM conf), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY k, confidence DESC, person_id) AS n FROM b)
    SELECT r.record_id, CASE k WHEN 0 THEN 'merge' WHEN 1 THEN 'review' ELSE 'no_match' END AS decision, CASE WHEN k = 2 THEN 0::DOUBLE ELSE confidence END AS confidence, CASE WHEN k < 2 THEN r.person_id END AS person_id,
      CASE WHEN k = 0 THEN coalesce((SELECT string_agg(x.person_id::VARCHAR, ',' ORDER BY x.person_id) FROM b x WHERE x.record_id = r.record_id AND x.k = 0 AND x.person_id <> r.person_id), '') ELSE '' END AS also_linked FROM r WHERE n = 1""")
def best_match(v: Views):
    return mt.best_match(scored(v)).withColumn("also_linked", F.array_join(F.col("also_linked").cast("array<string>"), ","))


@query(f"""
    WITH k AS ({KEYS}), l AS {LOCKS}, pairs AS (SELECT DISTINCT x.person_id AS a, y.person_id AS b FROM k x JOIN k y USING (identifier_type, normalized_value) WHERE x.person_id < y.person_id)
    SELECT a, b FROM pairs WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.a = pairs.a AND l.b = pairs.b)""")
def pair_audit(v: Views):
    return mt.pair_audit(v.identified_by, v.person, v.no_match_lock, 200)


@query("""
    SELECT k.src AS a, k.dst AS b, CASE WHEN (-coalesce(x.completeness, 0), x.created_at, x.person_id) < (-coalesce(y.completeness, 0), y.created_at, y.person_id) THEN k.src ELSE k.dst END AS survivor
    FROM knows k JOIN person x ON x.person_id = k.src JOIN person y ON y.person_id = k.dst""")
def survivor_choice(v: Views):
    return mt.survivor(v.knows.select(F.col("src").alias("a"), F.col("dst").alias("b")), v.person).drop("absorbed")


@query(f"""
    WITH RECURSIVE m AS (SELECT src AS a, dst AS b FROM knows WHERE label = 'colleague'), edge AS (SELECT a, b FROM m UNION SELECT b, a FROM m), reach AS (SELECT DISTINCT a AS node, a AS pos FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.pos),
    comp AS (SELECT node, min(pos) AS component FROM reach GROUP BY node), bad AS (SELECT DISTINCT x.component FROM {LOCKS} l JOIN comp x ON x.node = l.a JOIN comp y ON y.node = l.b WHERE x.component = y.component)
    SELECT node, component, component IN (SELECT component FROM bad) AS blocked FROM comp""")
def merge_groups(v: Views):
    pairs = v.knows.where("label = 'colleague'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return mt.resolved_groups(pairs, v.no_match_lock, 200)


ORDERED = "e AS (SELECT *, lag(mapped_state) OVER (PARTITION BY parent ORDER BY event_at, head_version, event_id) AS prev FROM stage_event), en AS (SELECT *, mapped_state = 'open' AND coalesce(prev, '') <> 'open' AS entry FROM e)"


@query(f"WITH {ORDERED}, n AS (SELECT *, sum(entry::INT) OVER (PARTITION BY parent ORDER BY event_at, head_version, event_id) AS ep FROM en) SELECT parent, event_id, CAST(ep AS BIGINT) AS episode FROM n WHERE entry")
def open_episodes(v: Views):
    return pr.open_entries(v.stage_event).select("parent", "event_id", "episode")


ASOF = "SELECT o.event_id, arg_max(struct_pack(k := d.version_key, a := d.amount_value, s := d.amount_state, c := d.currency_status, t := d.observed_at, n := d.contact_count), struct_pack(x := d.observed_at, y := d.version, z := d.version_key)) AS v FROM (SELECT * FROM en WHERE entry) o JOIN deal_version d ON d.parent = o.parent AND d.observed_at <= o.event_at AND d.lifecycle_status <> 'rejected' AND d.timestamps_valid GROUP BY 1"


@query(f"WITH {ORDERED} SELECT o.parent, o.event_id, x.v.k AS version_key, x.v.a AS amount_value FROM (SELECT * FROM en WHERE entry) o LEFT JOIN ({ASOF}) x USING (event_id)")
def asof_amount_version(v: Views):
    return pr.amount_version(pr.open_entries(v.stage_event), v.deal_version).select("parent", "event_id", F.col("v.version_key").alias("version_key"), F.col("v.amount_value").alias("amount_value"))


LABELS = f"""{ORDERED}, live AS (SELECT parent, count(DISTINCT entity_key) AS n, count(*) FILTER (entity_key IS NULL) AS z, min(entity_key) AS k FROM deal_version WHERE lifecycle_status IN ('active', 'pending_review') AND timestamps_valid GROUP BY 1),
    won AS (SELECT o.event_id, min(w.event_at) AS at_ FROM (SELECT * FROM en WHERE entry) o JOIN stage_event w ON w.parent = o.parent AND w.mapped_state = 'won' AND w.event_at > o.event_at GROUP BY 1), av AS ({ASOF}),
    j AS (SELECT o.parent, o.event_id, o.event_at, l.n, l.z, CASE WHEN l.n = 1 AND l.z = 0 THEN l.k END AS ek, av.v.c AS cur, o.event_at + INTERVAL 7 DAY <= {CUTOFF} AS mature, won.at_ <= o.event_at + INTERVAL 7 DAY AS w
      FROM (SELECT * FROM en WHERE entry) o LEFT JOIN live l ON l.parent = o.parent LEFT JOIN won USING (event_id) LEFT JOIN av USING (event_id)),
    lab AS (SELECT parent, event_id, event_at, coalesce(ek, -1) AS entity_key, mature, CASE WHEN n IS NULL THEN 'missing_parent_at_snapshot' WHEN ek IS NULL THEN 'selected_parent_ambiguity' WHEN ek NOT IN (0, 1, 2, 3) THEN 'unsupported_entity' WHEN cur = 'unsupported' THEN 'unsupported_currency' WHEN cur = 'invalid' THEN 'invalid_currency'
      WHEN NOT mature THEN 'immature_horizon' WHEN w THEN 'first_won_in_horizon' ELSE 'mature_no_first_won' END AS reason FROM j)"""


def labels(v: Views):
    """A horizon of 7 days, as the events cover one month."""
    return pr.retrospective_labels(v.stage_event, v.deal_version, [0, 1, 2, 3], F.expr(CUTOFF), horizon="7 days")


@query(f"""
    WITH {LABELS} SELECT parent, event_id, entity_key, mature, reason, CASE WHEN reason IN ('missing_parent_at_snapshot', 'selected_parent_ambiguity', 'invalid_currency') THEN 'censored' WHEN reason LIKE 'unsupported%' THEN 'ineligible' WHEN reason = 'immature_horizon' THEN 'unknown' WHEN reason = 'first_won_in_horizon' THEN 'positive' ELSE 'negative' END AS status FROM lab""")
def retro_labels(v: Views):
    return labels(v).select("parent", "event_id", "entity_key", "mature", "reason", "status")


@query(f"""
    WITH {ORDERED}, t AS (SELECT *, coalesce(prev <> mapped_state, false) AS turn FROM en), n AS (SELECT *, sum(entry::INT) OVER (PARTITION BY parent ORDER BY event_at, head_version, event_id) AS ep FROM t), av AS ({ASOF})
    SELECT o.parent, o.event_id, CAST(o.ep AS BIGINT) AS episode, round((epoch_us(o.event_at) - (SELECT min(epoch_us(x.event_at)) FROM t x WHERE x.parent = o.parent AND x.event_at <= o.event_at)) / 86400e6, 6) AS deal_age_days,
      (SELECT count(*) FROM t x WHERE x.parent = o.parent AND x.event_at < o.event_at AND x.turn) AS prior_transitions, (SELECT count(*) FROM t x WHERE x.parent = o.parent AND x.event_at < o.event_at AND x.mapped_state = 'won') AS prior_won,
      (SELECT count(*) FROM t x WHERE x.parent = o.parent AND x.event_at < o.event_at AND x.mapped_state = 'lost') AS prior_lost, av.v.a AS amount_value, CAST(CASE WHEN av.v IS NULL THEN 4 ELSE CASE WHEN av.v.s = 'missing' THEN 1 ELSE 0 END + CASE WHEN av.v.a IS NULL THEN 1 ELSE 0 END END AS INTEGER) AS missingness
    FROM n o LEFT JOIN av USING (event_id) WHERE o.entry""")
def pit_features(v: Views):
    return pr.features(v.stage_event, v.deal_version).select("parent", "event_id", "episode", F.round("deal_age_days", 6).alias("deal_age_days"), "prior_transitions", "prior_won", "prior_lost", "amount_value", "missingness")


DATASET = f"{LABELS}, ds AS (SELECT event_id AS row_id, CAST(floor((epoch(event_at) - epoch(TIMESTAMP '2024-01-01')) / 172800) AS BIGINT) AS bucket, event_id AS deal_key, parent AS person_key, (reason = 'first_won_in_horizon')::INT AS label, (event_id % 97 + 1) / CAST(100 AS DOUBLE) AS p FROM lab WHERE reason IN ('first_won_in_horizon', 'mature_no_first_won'))"


def dataset(v: Views):
    """Labelled rows in buckets of two days, with a stand-in probability."""
    rows = labels(v).where("status in ('positive', 'negative')")
    bucket = F.floor((F.unix_timestamp("snapshot_at") - F.unix_timestamp(F.expr("TIMESTAMP '2024-01-01 00:00:00'"))) / 172800)
    return rows.select(F.col("event_id").alias("row_id"), bucket.alias("bucket"), F.col("event_id").alias("deal_key"), F.col("parent").alias("person_key"), (F.col("status") == "positive").cast("int").alias("label"), ((F.col("event_id") % 97 + 1) / F.lit(100.0)).alias("p"))


@query(f"""
    WITH {DATASET}, b AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS n FROM (SELECT DISTINCT bucket FROM ds)), t AS (SELECT bucket AS tb FROM b WHERE n > 3), te AS (SELECT tb, ds.* FROM ds JOIN t ON ds.bucket = tb), tr AS (SELECT tb, ds.* FROM ds JOIN t ON ds.bucket < tb)
    SELECT tb AS test_bucket, row_id, 'test' AS side FROM te UNION ALL SELECT tb, row_id, 'train' FROM tr WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.tb = tr.tb AND (te.deal_key = tr.deal_key OR te.person_key = tr.person_key))""")
def temporal_folds(v: Views):
    return pr.temporal_folds(dataset(v))


@query(f"""
    WITH {DATASET}, r AS (SELECT *, row_number() OVER w AS k, sum(label) OVER (PARTITION BY bucket ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER (PARTITION BY bucket) AS n, sum(label) OVER (PARTITION BY bucket) AS pos FROM ds WINDOW w AS (PARTITION BY bucket ORDER BY p DESC, row_id)),
    a AS (SELECT bucket, count(*) AS test_count, CAST(sum(label) AS BIGINT) AS positive_count, sum(CASE WHEN k <= greatest(1, ceil(0.1 * n)) THEN label ELSE 0 END) / max(greatest(1, ceil(0.1 * n))) AS pc, coalesce(sum(CASE WHEN label = 1 THEN tp / k END) / max(pos), 0) AS pr_auc, avg((p - label) * (p - label)) AS brier, -avg(label * ln(p) + (1 - label) * ln(1 - p)) AS log_loss FROM r GROUP BY bucket),
    ec AS (SELECT bucket, sum(c * g) / sum(c) AS ece FROM (SELECT bucket, least(floor(p * 10), 9) AS bin, count(*) AS c, abs(avg(label) - avg(p)) AS g FROM ds GROUP BY ALL) GROUP BY bucket)
    SELECT a.bucket, test_count, positive_count, round(pc, 6) AS precision_at_capacity, round(CASE WHEN positive_count > 0 THEN pc * test_count / positive_count ELSE 0 END, 6) AS lift_at_capacity, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(ece, 6) AS ece FROM a JOIN ec USING (bucket)""")
def binary_metrics(v: Views):
    out = pr.binary_metrics(dataset(v).select("row_id", "bucket", "label", "p"), ["bucket"])
    names = ["precision_at_capacity", "lift_at_capacity", "pr_auc", "brier", "log_loss", "ece"]
    return out.select("bucket", "test_count", "positive_count", *(F.round(n, 6).alias(n) for n in names))


@query()
def bootstrap_interval(v: Views):
    return pr.block_bootstrap(dataset(v).select("bucket", "label", "p"))


@query()
def logistic_weights(v: Views):
    rows = pr.features(v.stage_event, v.deal_version).join(labels(v).where("status in ('positive', 'negative')").select("event_id", (F.col("status") == "positive").cast("int").alias("label")), "event_id")
    return pr.logistic_model(pr.saved(rows, "training"), ["prior_won", "prior_lost", "prior_transitions", "amount_known", "contact_count"])


@query(f"""
    WITH {LABELS}, s AS (SELECT *, reason = 'first_won_in_horizon' AS pos, reason = 'mature_no_first_won' AS neg FROM lab), d AS (SELECT parent, bool_or(pos) AS pos, bool_or(neg) AS neg, bool_or(mature) AS mature FROM s GROUP BY 1),
    t AS (SELECT count(*) FILTER (mature) AS matured_deals, count(*) FILTER (pos) AS positives, count(*) FILTER (neg AND NOT pos) AS negatives FROM d), m AS (SELECT count(DISTINCT strftime(event_at, '%Y-%m')) AS months FROM s)
    SELECT *, 2 AS folds, CASE WHEN matured_deals >= 2000 AND positives >= 200 AND negatives >= 500 AND months >= 6 THEN 'go' WHEN matured_deals >= 500 AND positives >= 50 AND negatives >= 200 AND months >= 3 THEN 'rules_only' ELSE 'collect_more_data' END AS decision FROM t, m""")
def gate_report(v: Views):
    return pr.gate_report(labels(v), F.lit(2))


VOLUMES = "SELECT o_orderkey AS k, o_orderkey % 2500 AS matured_deals, o_orderkey % 260 AS positives, o_orderkey % 600 AS negatives, o_orderkey % 8 AS months, o_orderkey % 4 AS folds FROM {orders}"


@query(f"""
    SELECT k, CASE WHEN matured_deals >= 2000 AND positives >= 200 AND negatives >= 500 AND months >= 6 AND folds >= 2 THEN 'go' WHEN matured_deals >= 500 AND positives >= 50 AND negatives >= 200 AND months >= 3 THEN 'rules_only' ELSE 'collect_more_data' END AS decision
    FROM ({VOLUMES.replace("{orders}", "orders")})""")
def gate_decisions(v: Views):
    return v.sql(VOLUMES).select("k", pr.gate_decision(*(F.col(c) for c in ("matured_deals", "positives", "negatives", "months", "folds"))).alias("decision"))


KNOWN_CUTOFF = "TIMESTAMP '2024-01-29 12:00:00'"


@query(f"""
    WITH o AS (SELECT *, lag(mapped_state) OVER (PARTITION BY parent ORDER BY event_at, head_version, event_id) AS before FROM known_event),
    en AS (SELECT parent, event_id, greatest(event_at, available_at) AS at_ FROM o WHERE mapped_state = 'open' AND coalesce(before, '') <> 'open'), bad AS (SELECT DISTINCT parent FROM known_event WHERE NOT valid),
    st AS (SELECT en.event_id, arg_max(e.mapped_state, row(e.event_at, e.head_version, e.event_id)) FILTER (e.event_at <= at_ AND e.available_at <= at_) AS state, bool_or(e.event_at <= at_ AND e.available_at > at_ AND e.mapped_state <> 'open') AS late,
      arg_min(row(e.event_at, e.available_at), row(e.event_at, e.head_version, e.event_id)) FILTER (e.mapped_state = 'won') AS won FROM en JOIN known_event e USING (parent) GROUP BY 1),
    ve AS (SELECT en.event_id, count(*) FILTER (live) AS n, coalesce(bool_or(NOT ok), false) AS invalid, max(entity_key) FILTER (live) AS entity_key, max(currency_status) FILTER (live) AS cur, max(linked_persons) FILTER (live) AS lp, max(linked_at) FILTER (live) AS la
      FROM en LEFT JOIN LATERAL (SELECT v.*, v.timestamps_valid AS ok, v.timestamps_valid AND v.observed_at <= at_ AND v.ingested_at <= at_ AND coalesce(v.activated_at <= at_, false) AND coalesce(v.superseded_at > at_, true) AND coalesce(v.rejected_at > at_, true) AS live
        FROM known_version v WHERE v.parent = en.parent) x ON true GROUP BY 1),
    r AS (SELECT en.*, CASE WHEN en.parent IN (FROM bad) THEN 'invalid_stage_timestamp' WHEN n <> 1 THEN CASE WHEN n > 1 THEN 'selected_parent_ambiguity' WHEN invalid THEN 'invalid_parent_timestamp' ELSE 'missing_parent_at_snapshot' END
      WHEN coalesce(entity_key IN (0, 1, 2, 3), false) = false THEN 'unsupported_entity' WHEN cur = 'unsupported' THEN 'unsupported_currency' WHEN cur = 'invalid' THEN 'invalid_currency' WHEN NOT (lp = 1 AND la <= at_) THEN 'ambiguous_or_late_person_link'
      WHEN late THEN 'censored_retrospective_disqualifier' WHEN coalesce(state, '') <> 'open' THEN 'not_open_as_known' WHEN won[1] > at_ AND won[1] <= at_ + INTERVAL 7 DAY THEN CASE WHEN won[2] > {KNOWN_CUTOFF} THEN 'won_unavailable_by_cutoff' ELSE 'first_won_in_horizon' END
      WHEN at_ + INTERVAL 7 DAY > {KNOWN_CUTOFF} THEN 'immature_horizon' ELSE 'mature_no_first_won' END AS reason FROM en JOIN st USING (event_id) JOIN ve USING (event_id))
    SELECT parent, event_id, reason, CASE reason WHEN 'first_won_in_horizon' THEN 'positive' WHEN 'mature_no_first_won' THEN 'negative' WHEN 'immature_horizon' THEN 'unknown' WHEN 'unsupported_entity' THEN 'ineligible' WHEN 'unsupported_currency' THEN 'ineligible'
      WHEN 'not_open_as_known' THEN 'ineligible' ELSE 'censored' END AS status FROM r""")
def operational_labels(v: Views):
    return pr.operational_labels(v.known_event, v.known_version, [0, 1, 2, 3], F.expr(KNOWN_CUTOFF), 7).select("parent", "event_id", "reason", "status")


@query("SELECT person_id, other_id, label FROM (SELECT src AS person_id, dst AS other_id, label FROM knows WHERE coalesce(is_active, true) UNION ALL SELECT dst, src, label FROM knows WHERE coalesce(is_active, true))")
def relationships(v: Views):
    from ..operators.connections import undirected

    return undirected(v.knows.where(edge_active()).select("src", "dst", "label"))
