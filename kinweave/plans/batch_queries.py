"""Queries on the whole chain of resolution: rules, scores with names and near misses, picks, owners before, and new persons.

The oracles say the rules again in SQL; clusters are found by a recursion that takes links one by one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as bt
from ..operators import matching as mt
from ..staging import cut
from .catalog import query
from .matching_queries import CANDIDATES, FAN, LOCKS, found, incoming
from .views import Views

USABLE = "('valid', 'partial_parse')"
COMMON_START = "CASE " + " ".join(f"WHEN left(x, {n}) = left(y, {n}) AND least(length(x), length(y)) >= {n} THEN {n}" for n in (4, 3, 2, 1)) + " ELSE 0 END"


def like(x: str, y: str) -> str:
    """Similarity of two strings: Jaro, and a tenth of the rest for each of up to four equal first characters."""
    start = COMMON_START.replace("x,", "lower(trim({x})),").replace("y,", "lower(trim({y})),").replace("length(x)", "length(lower(trim({x})))").replace("length(y)", "length(lower(trim({y})))").format(x=x, y=y)
    jaro = f"jaro_similarity(lower(trim({x})), lower(trim({y})))"
    return f"({jaro} + ({start}) * 0.1 * (1 - {jaro}))"


def judged_sql(p: str, pairs: str, mine: str, held: str, people: str) -> str:
    """Common tables that judge pairs (record_id, person_id): {p}judged (record_id, person_id, rule, decision, confidence).

    mine (record_id, ...) and held (person_id, ...) hold identifiers; people (id, dob, name, address). A phone that over five persons hold is hot.
    """
    close_mail = f"""(split_part(x.normalized_value, '@', 1) = split_part(y.normalized_value, '@', 1) AND damerau_levenshtein(split_part(x.normalized_value, '@', 2), split_part(y.normalized_value, '@', 2)) = 1
        AND (split_part(x.normalized_value, '@', 2) = 'gmail.com' OR split_part(y.normalized_value, '@', 2) = 'gmail.com'))
      OR (split_part(x.normalized_value, '@', 2) = split_part(y.normalized_value, '@', 2) AND x.normalized_value <> y.normalized_value AND {like("split_part(x.normalized_value, '@', 1)", "split_part(y.normalized_value, '@', 1)")} >= 0.9)"""
    return f"""
    {p}same AS (
      SELECT c.record_id, c.person_id, bool_or(h.normalized_value = r.normalized_value) AS same FROM {pairs} c
      JOIN {mine} r ON r.record_id = c.record_id AND r.identifier_type = 'nric' AND r.quality_flag = 'valid'
      JOIN {held} h ON h.person_id = c.person_id AND h.identifier_type = 'nric' AND h.quality_flag = 'valid' GROUP BY ALL),
    {p}open AS (SELECT record_id, person_id FROM {pairs} LEFT JOIN {p}same USING (record_id, person_id) WHERE same IS NULL),
    {p}usable AS (SELECT person_id, identifier_type, normalized_value, bool_or(is_verified) AS hv FROM {held} WHERE identifier_type IN ('phone', 'email') AND quality_flag IN {USABLE} GROUP BY ALL),
    {p}met AS (
      SELECT o.record_id, o.person_id, r.identifier_type, r.normalized_value, r.is_verified, hv, hv IS NOT NULL AND r.identifier_type = 'phone' AND coalesce(f.fanout, 0) > 5 AS hot
      FROM {p}open o JOIN {mine} r ON r.record_id = o.record_id AND r.identifier_type IN ('phone', 'email')
      LEFT JOIN {p}usable u ON u.person_id = o.person_id AND u.identifier_type = r.identifier_type AND u.normalized_value = r.normalized_value
      LEFT JOIN {FAN} f ON f.identifier_type = r.identifier_type AND f.normalized_value = r.normalized_value),
    {p}exact AS (
      SELECT record_id, person_id, bool_or(hot) AS hot, sum(CASE WHEN hv IS NULL THEN 0 WHEN is_verified AND hv THEN 0.35 ELSE 0.20 END - CASE WHEN hot THEN 0.25 ELSE 0 END)::DOUBLE AS evidence FROM {p}met GROUP BY ALL),
    {p}near AS (
      SELECT x.record_id, x.person_id, bool_or(x.identifier_type = 'phone' AND x.normalized_value <> y.normalized_value AND damerau_levenshtein(x.normalized_value[4:], y.normalized_value[4:]) = 1) AS phone_near,
        bool_or(x.identifier_type = 'email' AND ({close_mail})) AS email_near
      FROM {p}met x JOIN {p}usable y ON y.person_id = x.person_id AND y.identifier_type = x.identifier_type WHERE x.hv IS NULL GROUP BY ALL),
    {p}facts AS (
      SELECT o.record_id, o.person_id, coalesce(hot, false) AS hot,
        coalesce(evidence, 0) + CASE WHEN phone_near THEN 0.10 ELSE 0 END + CASE WHEN email_near THEN 0.10 ELSE 0 END AS evidence,
        CASE WHEN a.dob = b.dob THEN 0.25 WHEN a.dob <> b.dob THEN -0.30 ELSE 0 END AS born, CASE WHEN a.address = b.address THEN 0.10 ELSE 0 END AS home, {like("a.name", "b.name")} AS alike
      FROM {p}open o JOIN {people} a ON a.id = o.record_id JOIN {people} b ON b.id = o.person_id LEFT JOIN {p}exact USING (record_id, person_id) LEFT JOIN {p}near USING (record_id, person_id)),
    {p}scores AS (
      SELECT *, greatest(0, least(1, round(least(evidence, 0.85) + born + home + CASE WHEN alike > 0.8 THEN 0.20 WHEN alike >= 0.5 THEN 0.10 ELSE -0.25 END, 6)))::DOUBLE AS confidence FROM {p}facts),
    {p}judged AS (
      SELECT record_id, person_id, CASE WHEN same THEN 'government_id' ELSE 'government_id_conflict' END AS rule, CASE WHEN same THEN 'merge' ELSE 'no_match' END AS decision, CASE WHEN same THEN 1 ELSE 0 END::DOUBLE AS confidence FROM {p}same
      UNION ALL SELECT record_id, person_id, NULL, CASE WHEN confidence >= 0.4 THEN 'merge' WHEN confidence >= 0.2 THEN 'review' ELSE 'no_match' END, confidence FROM {p}scores)"""


def pairs_sql(p: str, records: str, mine: str, people: str) -> str:
    """{p}pairs of records that share a usable identifier within its cap, or address and date of birth."""
    return f"""
    {p}own AS (SELECT DISTINCT record_id, identifier_type, normalized_value FROM {mine} JOIN {records} USING (record_id) WHERE quality_flag IN {USABLE}),
    {p}kept AS (SELECT identifier_type, normalized_value FROM {p}own GROUP BY ALL HAVING count(*) <= CASE identifier_type WHEN 'phone' THEN 50 WHEN 'email' THEN 100 ELSE 5 END),
    {p}live AS (SELECT * FROM {p}own JOIN {p}kept USING (identifier_type, normalized_value)),
    {p}pairs AS (
      SELECT a.record_id, b.record_id AS person_id FROM {p}live a JOIN {p}live b USING (identifier_type, normalized_value) WHERE a.record_id > b.record_id
      UNION SELECT a.id, b.id FROM {people} a JOIN {people} b ON a.address = b.address AND a.dob = b.dob AND a.id > b.id JOIN {records} x ON x.record_id = a.id JOIN {records} y ON y.record_id = b.id)"""


def clusters_sql(p: str, mine: str) -> str:
    """{p}cluster (node, cluster): links of {p}judged that merge, taken one by one, the strongest first."""
    return f"""
    {p}link AS (SELECT least(record_id, person_id) AS a, greatest(record_id, person_id) AS b, max(confidence) AS w FROM {p}judged WHERE decision = 'merge' GROUP BY ALL),
    {p}both AS (SELECT a, b FROM {p}link UNION SELECT b, a FROM {p}link),
    {p}reach AS (SELECT a AS node, a AS at_ FROM {p}both UNION SELECT node, b FROM {p}reach JOIN {p}both ON a = at_),
    {p}comp AS (SELECT node, min(at_) AS comp FROM {p}reach GROUP BY node),
    {p}order AS (SELECT comp, a, b, row_number() OVER (PARTITION BY comp ORDER BY w DESC, md5(concat_ws('-', a, b)) DESC) AS k FROM {p}link JOIN {p}comp ON node = a),
    {p}id AS (SELECT record_id, min(normalized_value) AS g FROM {mine} WHERE identifier_type = 'nric' AND quality_flag = 'valid' GROUP BY ALL),
    {p}state AS (
      SELECT comp, 0::BIGINT AS k, list(struct_pack(n := node, c := node, g := g)) AS st FROM {p}comp LEFT JOIN {p}id ON record_id = node GROUP BY comp
      UNION ALL SELECT s.comp, s.k + 1, CASE
          WHEN len(list_distinct(list_filter(list_transform(list_filter(st, lambda x: x.c = ca OR x.c = cb), lambda x: x.g), lambda g: g IS NOT NULL))) > 1 THEN st
          ELSE list_transform(st, lambda x: struct_pack(n := x.n, c := CASE WHEN x.c = ca OR x.c = cb THEN least(ca, cb) ELSE x.c END, g := x.g)) END
      FROM (SELECT s.*, list_filter(st, lambda x: x.n = o.a)[1].c AS ca, list_filter(st, lambda x: x.n = o.b)[1].c AS cb FROM {p}state s JOIN {p}order o ON o.comp = s.comp AND o.k = s.k + 1) s),
    {p}cluster AS (SELECT x.n AS node, x.c AS cluster FROM (SELECT unnest(arg_max(st, k)) AS x FROM {p}state GROUP BY comp))"""


BATCH = f"""every AS (SELECT record_id FROM new_record), folk AS (SELECT record_id AS id, dob, name, address_id AS address FROM new_record),
    other AS (SELECT record_id AS person_id, identifier_type, normalized_value, is_verified, quality_flag FROM new_identifier),
    {pairs_sql("n_", "every", "new_identifier", "folk")}, {judged_sql("n_", "n_pairs", "new_identifier", "other", "folk")}"""


def new_records(v: Views):
    return v.new_record.select("record_id", F.lit("identity").alias("record_type"), "dob", F.array("name").alias("names"), "address_id")


@query(f"WITH {BATCH} SELECT record_id, person_id, rule, decision, confidence FROM n_judged")
def batch_links(v: Views):
    """Pairs of the new records of a batch with rule or score; a phone that a tenth of them share is no key."""
    return bt.batch_judged(v.new_identifier, new_records(v), v.identified_by)


@query(f"WITH RECURSIVE {BATCH}, {clusters_sql('n_', 'new_identifier')} SELECT record_id, coalesce(cluster, record_id) AS cluster FROM every LEFT JOIN n_cluster ON node = record_id")
def batch_persons(v: Views):
    """Persons made of a batch: members of a household with different government ids stay two persons, split at their weakest link."""
    return bt.batch_clusters(v.new_identifier, new_records(v), v.identified_by)


def records(v: Views):
    return v.person.select(F.col("person_id").alias("record_id"), F.lit("identity").alias("record_type"), F.col("preferred_dob").alias("dob"), F.array("preferred_full_name").alias("names"), F.floor(F.col("person_id") / 4).alias("address_id"))


FOLK = """mine AS (SELECT person_id AS record_id, identifier_type, normalized_value, is_verified, quality_flag FROM identified_by),
    active_edge AS (SELECT * FROM identified_by WHERE is_active),
    folk AS (SELECT person_id AS id, preferred_dob AS dob, preferred_full_name AS name, floor(person_id / 4) AS address FROM person)"""
VETO = f"""l AS {LOCKS}, cand AS ({CANDIDATES}), veto AS (
      SELECT DISTINCT c.record_id, c.person_id FROM cand c JOIN identified_by r ON r.person_id = c.record_id AND r.quality_flag IN {USABLE} JOIN identified_by o USING (identifier_type, normalized_value)
      JOIN person p ON p.person_id = o.person_id AND p.status = 'active' JOIN l ON l.a = o.person_id AND l.b = c.person_id WHERE o.is_active),
    free AS (SELECT * FROM cand ANTI JOIN veto USING (record_id, person_id))"""
JUDGED = f"{FOLK}, {VETO}, {judged_sql('j_', 'free', 'mine', 'active_edge', 'folk')}, j AS (SELECT * FROM j_judged WHERE coalesce(rule, '') <> 'government_id_conflict')"


def judged(v: Views):
    """Candidates less locked ones, by rule or score: record_id, person_id, decision, confidence; conflicts are left out."""
    pairs = cut(found(v), "pairs")
    veto = mt.locked_candidates(pairs, incoming(v), v.identified_by, v.person, v.no_match_lock, 200)
    pairs = pairs.join(veto, ["record_id", "person_id"], "left_anti").withColumn("record_type", F.lit("identity"))
    ruled = cut(mt.deterministic(pairs, incoming(v), v.identified_by), "ruled")
    hard = ruled.where("verdict = 'merge'").select("record_id", "person_id", F.col("verdict").alias("decision"), F.lit(1.0).alias("confidence"))
    evidence = mt.identifier_evidence(ruled.where("verdict is null").select("record_id", "person_id"), incoming(v), v.identified_by)
    own, held = records(v), records(v).select(F.col("record_id").alias("person_id"), F.array("dob").alias("held_dobs"), F.col("names").alias("held_names"), F.col("address_id").alias("held_address"))
    rows = cut(evidence, "evidence").join(own, "record_id").join(held, "person_id")
    rows = rows.withColumns({"name_similarity": mt.best_name_similarity("names", "held_names"), "address_match": F.col("address_id") == F.col("held_address")})
    return cut(hard.union(mt.scored(rows).select("record_id", "person_id", "decision", "confidence")), "judged")


@query(f"WITH {JUDGED} SELECT record_id, person_id, decision, confidence FROM j")
def match_full(v: Views):
    """Every candidate by locks, rules, identifiers, near misses, names, birth dates and addresses."""
    return judged(v)


@query(f"""
    WITH RECURSIVE {JUDGED}, b AS (SELECT *, CASE decision WHEN 'merge' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS rank FROM j),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rank, confidence DESC, person_id) AS n, count(*) FILTER (rank = 0) OVER (PARTITION BY record_id) AS merging FROM b),
    best AS (
      SELECT p.person_id AS record_id, CASE rank WHEN 0 THEN 'merge' WHEN 1 THEN 'review' ELSE 'no_match' END AS decision, CASE WHEN rank < 2 THEN r.confidence ELSE 0 END::DOUBLE AS confidence,
        CASE WHEN rank < 2 THEN r.person_id END AS person_id, rank = 0 AND merging > 1 AS more
      FROM person p LEFT JOIN r ON r.record_id = p.person_id AND r.n = 1),
    owned AS (
      SELECT best.*, CASE WHEN best.record_id % 7 = 3 THEN best.record_id - 1 END AS prior_id, j.confidence AS own
      FROM best LEFT JOIN j ON j.record_id = best.record_id AND j.person_id = best.record_id - 1 AND best.record_id % 7 = 3),
    m AS (
      SELECT *, coalesce(own IS NOT NULL AND decision = 'merge' AND confidence >= 0.9 AND confidence - own + 1e-12 >= 0.1 AND NOT coalesce(more, false), false) AS moves,
        coalesce(person_id = prior_id, false) AND NOT coalesce(more, false) AS stays FROM owned),
    s AS (
      SELECT record_id, CASE WHEN prior_id IS NULL OR stays THEN decision WHEN moves THEN 'merge' ELSE 'review' END AS decision, confidence,
        CASE WHEN prior_id IS NULL OR moves THEN person_id ELSE prior_id END AS person_id, prior_id IS NOT NULL AS had_owner FROM m),
    fresh AS (SELECT record_id FROM s WHERE decision = 'no_match'), other AS (SELECT person_id, identifier_type, normalized_value, is_verified, quality_flag FROM identified_by),
    {pairs_sql("f_", "fresh", "mine", "folk")}, {judged_sql("f_", "f_pairs", "mine", "other", "folk")}, {clusters_sql("f_", "mine")}
    SELECT record_id, decision, confidence, s.person_id, had_owner, CASE decision WHEN 'merge' THEN 'p:' || s.person_id WHEN 'no_match' THEN 'n:' || coalesce(cluster, record_id) END AS person
    FROM s LEFT JOIN f_cluster ON node = record_id""")
def resolution(v: Views):
    """From candidates to persons: the pick, the owner a record had before (every seventh had its neighbour), and new persons for what matched none."""
    pairs, none = judged(v), F.array().cast("array<bigint>")
    every = v.person.select(F.col("person_id").alias("record_id")).join(mt.best_match(pairs), "record_id", "left")
    every = every.select("record_id", F.coalesce("decision", F.lit("no_match")).alias("decision"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "person_id", F.coalesce("also_linked", none).alias("also_linked"))
    prior = v.person.where("person_id % 7 = 3").select(F.col("person_id").alias("record_id"), (F.col("person_id") - 1).alias("prior_id"))
    settled = cut(mt.continuity(every, prior, pairs), "settled")
    fresh = cut(records(v).join(settled.where("decision = 'no_match'"), "record_id", "left_semi"), "fresh")
    clusters = bt.batch_clusters(incoming(v).join(fresh.select("record_id"), "record_id", "left_semi"), fresh, v.identified_by)
    return settled.join(mt.person_assignment(settled, clusters), "record_id", "left").select("record_id", "decision", "confidence", "person_id", "had_owner", "person")
