"""Queries on histories under review, their outbox, known values in texts, and intervals of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as bs
from ..operators import history as hi
from ..operators import privacy as pv
from ..staging import cut, new_folder
from .catalog import query
from .matching_queries import DATASET, dataset
from .views import Views

# Observations and commands of 150 users' histories in order; commands expect versions of which some are stale.
STORY = """
    SELECT CAST(user_id * 40 + event_id % 40 AS STRING) AS identity, ts AS moment, event_id AS seq,
      CASE event_type WHEN 'purchase' THEN 'resolve_conflict' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'reject_parent' ELSE 'resolve_parent' END WHEN 'signup' THEN CASE WHEN event_id % 5 < 2 THEN 'apply_correction' ELSE 'observed' END ELSE 'observed' END AS kind,
      CASE WHEN event_type IN ('view', 'click') THEN 'h' || CAST(CAST(floor(event_id / 7) AS BIGINT) % 2 AS STRING) WHEN event_type = 'signup' THEN 'h0' WHEN event_id % 2 = 0 THEN 'h' || CAST(event_id % 3 AS STRING) END AS hash,
      CASE event_id % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN CASE WHEN event_id % 16 = 1 THEN 'ambiguous' ELSE 'selected_active' END WHEN 2 THEN 'selected_pending_review' ELSE 'selected_active' END AS association,
      'p' || CAST(event_id % 2 AS STRING) AS parent, 1 + event_id % 2 AS expected_version,
      CASE WHEN event_type = 'signup' THEN 'effective' WHEN event_id % 7 < 3 THEN 'withheld_conflict' ELSE 'withheld_parent' END AS expected_state
    FROM {events}"""

FOLD = f"""
    story AS ({STORY.replace("{events}", "events").replace("AS STRING", "AS VARCHAR")}), ordered AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY moment, seq) AS k FROM story),
    fold AS (
      SELECT identity, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS kind, '' AS status, NULL::VARCHAR AS refusal, 0::BIGINT AS version, NULL::VARCHAR AS state, NULL::VARCHAR AS hash, NULL::VARCHAR AS parent, NULL::VARCHAR AS association, NULL::VARCHAR AS seen_parent, []::VARCHAR[] AS variants, []::VARCHAR[] AS invalidates
      FROM (SELECT DISTINCT identity FROM story)
      UNION ALL
      SELECT identity, k, seq, kind, CASE WHEN refusal IS NOT NULL THEN 'refused' WHEN same THEN 'unchanged' ELSE 'written' END, refusal,
        version + CASE WHEN keep THEN 0 ELSE 1 END, CASE WHEN keep THEN state ELSE to_ END, CASE WHEN keep THEN hash ELSE new_hash END, CASE WHEN keep THEN parent ELSE new_parent END,
        CASE WHEN kind = 'observed' AND NOT same THEN new_association ELSE association END, CASE WHEN kind = 'observed' AND NOT same THEN new_parent ELSE seen_parent END, CASE WHEN kind = 'observed' THEN list_distinct(list_append(variants, new_hash)) ELSE variants END,
        CASE WHEN keep THEN [] ELSE list_sort(list_distinct(list_concat(CASE WHEN state IN ('effective', 'corrected') THEN [parent] ELSE [] END, CASE WHEN to_ IN ('effective', 'corrected') THEN [new_parent] ELSE [] END))) END
      FROM (
        SELECT *, same OR refusal IS NOT NULL AS keep,
          CASE WHEN kind = 'observed' THEN CASE WHEN new_association = 'ambiguous' OR len(list_distinct(list_append(variants, new_hash))) > 1 THEN 'withheld_conflict' WHEN new_association = 'selected_active' THEN 'effective' ELSE 'withheld_parent' END
            WHEN kind = 'reject_parent' THEN 'rejected' WHEN kind = 'apply_correction' THEN 'corrected' WHEN kind = 'resolve_conflict' THEN CASE WHEN new_association = 'selected_active' THEN 'effective' ELSE 'rejected' END
            ELSE CASE new_association WHEN 'selected_active' THEN 'effective' WHEN 'ambiguous' THEN 'withheld_conflict' ELSE 'withheld_parent' END END AS to_
        FROM (
          SELECT f.identity, o.k, o.seq, o.kind, f.version, f.state, f.hash, f.parent, f.association, f.seen_parent, f.variants, coalesce(o.hash, f.hash) AS new_hash, o.parent AS new_parent, o.association AS new_association,
            coalesce(o.kind = 'observed' AND f.version > 0 AND list_contains(f.variants, o.hash) AND o.association = f.association AND o.parent = f.seen_parent, false) AS same,
            CASE WHEN o.kind = 'observed' THEN NULL WHEN f.version = 0 THEN 'no_head' WHEN o.expected_version <> f.version THEN 'stale_version' WHEN o.expected_state <> f.state THEN 'stale_state' WHEN o.hash IS NOT NULL AND NOT list_contains(f.variants, o.hash) THEN 'unknown_variant'
              WHEN o.kind <> 'apply_correction' AND f.state NOT IN ('withheld_parent', 'withheld_conflict') THEN 'not_withheld' WHEN o.kind = 'apply_correction' AND o.association <> 'selected_active' THEN 'parent_not_active' END AS refusal
          FROM fold f JOIN ordered o ON o.identity = f.identity AND o.k = f.k + 1)))"""


@query(f"WITH RECURSIVE {FOLD} SELECT identity, seq, kind, status, refusal, version, state, hash, parent, array_to_string(invalidates, ',') AS invalidates FROM fold WHERE k > 0")
def history_commands(v: Views):
    """What each observation and review command did; commands that saw an older head are refused with a reason."""
    out = hi.folded(v.sql(STORY).withColumns({"expected_version": F.col("expected_version").cast("long"), "identity": F.col("identity").cast("string")}))
    return out.select("identity", "seq", "kind", "status", "refusal", "version", "state", "hash", "parent", F.array_join("invalidates", ",").alias("invalidates"))


@query(f"WITH RECURSIVE {FOLD} SELECT identity, version, unnest(invalidates) AS parent FROM fold WHERE status = 'written'")
def outbox_applied_once(v: Views):
    """Intents of two commits, of which the second repeats a part of the first and is written twice, read by a stream in two runs: each has one effect."""
    intents = cut(hi.outbox(hi.folded(v.sql(STORY).withColumn("expected_version", F.col("expected_version").cast("long")))), "intents")
    box, out = new_folder(v.spark, "outbox"), new_folder(v.spark, "outbox-applied")
    first, second = intents.where("version < 3"), intents.where("version > 1")
    hi.publish(first, box, 1)
    hi.consume(v.spark, box, f"{out}/rows", f"{out}/state").awaitTermination()
    for _ in range(2):
        hi.publish(second, box, 2)
    for _ in range(2):
        hi.consume(v.spark, box, f"{out}/rows", f"{out}/state").awaitTermination()
    applied = v.spark.read.schema("intent_id string, identity string, version long, parent string, reason string, batch long").parquet(f"{out}/rows")
    return applied.select("identity", "version", "parent")


# Texts about persons; some name a value of the person or of another one, in other letters and spacing.
NOTES = """
    SELECT o_orderkey AS text_id, CASE o_orderkey % 6 WHEN 0 THEN 'Call ' || substr(preferred_phone, 1, 3) || ' ' || substr(preferred_phone, 4, 4) || '-' || substr(preferred_phone, 8, 4) || ' after five'
        WHEN 1 THEN 'Mail: ' || upper(preferred_email) WHEN 2 THEN 'id ' || lower(preferred_nric) || '.' WHEN 3 THEN 'order ' || CAST(o_orderkey AS STRING) || ' shipped' WHEN 4 THEN o_orderpriority ELSE preferred_dob END AS text
    FROM {orders} JOIN {person} ON person_id = o_custkey"""
KNOWN = "SELECT person_id AS owner_id, normalized_value AS value FROM {identified_by} WHERE person_id % 10 < 7"


@query(f"""
    WITH notes AS ({NOTES.replace("{orders}", "orders").replace("{person}", "person").replace("AS STRING", "AS VARCHAR")}), known AS ({KNOWN.replace("{identified_by}", "identified_by")}),
    t AS (SELECT text_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS c FROM notes), val AS (SELECT DISTINCT owner_id, value, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS c FROM known WHERE value IS NOT NULL)
    SELECT text_id, owner_id, value FROM t JOIN val ON contains(t.c, val.c)""")
def known_values_in_texts(v: Views):
    """Identifiers of any person found in notes, however they are spaced or capitalised."""
    return pv.values_in(v.sql(NOTES), v.sql(KNOWN))


@query(f"""
    WITH {DATASET}, b AS (SELECT 99 - least(floor(p * 100), 99) AS bin, sum(label) AS pos, count(*) AS n FROM ds GROUP BY 1),
    c AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n, sum(n) OVER () AS all_n, sum(pos) OVER () AS all_pos FROM b WINDOW w AS (ORDER BY bin)),
    d AS (SELECT *, greatest(1, ceil(0.1 * all_n)) AS cap FROM c)
    SELECT 'brier' AS metric, round((SELECT avg((p - label) * (p - label)) FROM ds), 6) AS point
    UNION ALL SELECT 'pr_auc', round(sum(pos * cum_pos / cum_n) / max(all_pos), 6) FROM d
    UNION ALL SELECT 'lift', round(sum(pos * least(greatest(cap - (cum_n - n), 0), n) / n) / max(cap) * max(all_n) / max(all_pos), 6) FROM d""")
def metric_points(v: Views):
    """Brier score, area under precision and recall, and lift, from sums by block."""
    return metric_intervals(v).select("metric", F.round("point", 6).alias("point"))


@query()
def metric_intervals(v: Views):
    """The same metrics with bootstrap intervals; draws have no SQL."""
    return bs.intervals(dataset(v).select("bucket", "label", "p"), [bs.brier(), bs.pr_auc(), bs.lift()])
