"""Queries on scalar functions, exclusions, transcripts and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts, normalize, similarity
from ..functions import transcript as tr
from ..operators import lifecycle as lc
from .catalog import query
from .views import Views

MAILBOX = "CASE CAST(floor(created_at / 60) AS BIGINT) % 8 WHEN 0 THEN '  First.Last+tag@GMAIL.com ' WHEN 1 THEN 'a.b.' || person_id || '@googlemail.com' WHEN 2 THEN 'test@example.com' WHEN 3 THEN 'no at sign' WHEN 4 THEN '' WHEN 5 THEN '+only@gmail.com' ELSE upper(preferred_email) END"
TELEPHONE = "CASE CAST(floor(created_at / 60) AS BIGINT) % 8 WHEN 0 THEN 'xxx' || preferred_phone WHEN 1 THEN '9123 4567' WHEN 2 THEN '12345678' WHEN 3 THEN 'call me' WHEN 4 THEN '00 44 20 7946 0958' WHEN 5 THEN '6591234567' WHEN 6 THEN '+65 1234 5678' ELSE preferred_phone END"
PLACE = "CASE CAST(floor(created_at / 60) AS BIGINT) % 6 WHEN 0 THEN '#05-123 ' || person_id || ' Example  Street Singapore 123456' WHEN 1 THEN person_id || 'A Long Road, SG 654321' WHEN 2 THEN 'somewhere 111222 else' WHEN 3 THEN 'n/a' WHEN 4 THEN 'nowhere' ELSE 'Blk 10 North Ave 999888' END"


def _duck(expression: str) -> str:
    return expression.replace(" || person_id", " || person_id::VARCHAR").replace("THEN person_id ||", "THEN person_id::VARCHAR ||")


@query(rf"""
    WITH r AS (SELECT person_id, {_duck(MAILBOX)} AS raw FROM person), t AS (SELECT *, lower(trim(raw)) AS low FROM r),
    f AS (SELECT *, regexp_matches(low, '^[a-zA-Z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.[a-zA-Z]{{2,}}$') AS ok, replace(split_part(regexp_extract(low, '^(.*)@([^@]*)$', 1), '+', 1), '.', '') AS folded, regexp_extract(low, '^(.*)@([^@]*)$', 2) AS dom FROM t)
    SELECT person_id, CASE WHEN low = 'test@example.com' OR NOT ok THEN NULL WHEN dom IN ('gmail.com', 'googlemail.com') AND folded <> '' THEN folded || '@gmail.com' ELSE low END AS email,
      CASE WHEN raw IS NULL THEN NULL WHEN low = 'test@example.com' THEN 'placeholder_value' WHEN ok THEN 'valid' ELSE 'invalid_format' END AS quality FROM f""")
def normalize_email(v: Views):
    out = v.person.select("person_id", normalize.normalize_email(F.expr(MAILBOX)).alias("e"))
    return out.select("person_id", F.col("e.value").alias("email"), F.col("e.quality").alias("quality"))


@query(rf"""
    WITH r AS (SELECT person_id, {_duck(TELEPHONE)} AS raw FROM person), t AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^[xX]+', ''), '[xX]+$', '') AS s FROM r), d AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS g FROM t)
    SELECT person_id, CASE WHEN g = '12345678' THEN NULL WHEN s LIKE '00%' THEN '+' || g[3:] WHEN regexp_matches(g, '^[3689][0-9]{{7}}$') AND s NOT LIKE '+%' THEN '+65' || g WHEN regexp_matches(g, '^65[3689][0-9]{{7}}$') THEN '+' || g END AS phone FROM d""")
def normalize_phone(v: Views):
    return v.person.select("person_id", normalize.normalize_phone(F.expr(TELEPHONE))["value"].alias("phone"))


@query("SELECT person_id, upper(regexp_replace(trim('xXx' || preferred_nric), '^[xX]+', '')) AS nric FROM person")
def normalize_nric(v: Views):
    return v.person.select("person_id", normalize.normalize_nric(F.concat(F.lit("xXx"), "preferred_nric"))["value"].alias("nric"))


@query(rf"""
    WITH r AS (SELECT person_id, {_duck(PLACE)} AS raw FROM person), p AS (SELECT *, '(?i)^(?:#?(\d{{1,3}}-\d{{1,4}})\s+)?(?:(?:Blk|Block)\s+)?(\d+[A-Za-z]?)\s+(.+?)(?:\s*,?\s*(?:Singapore|SG))?\s+(\d{{6}})\s*$' AS pat FROM r),
    m AS (SELECT *, regexp_matches(raw, pat) AS full_, regexp_extract(raw, pat, 1) AS u, lower(regexp_extract(raw, pat, 2)) AS n, lower(trim(regexp_replace(regexp_extract(raw, pat, 3), '\s+', ' ', 'g'))) AS st, regexp_extract(raw, pat, 4) AS pc, regexp_extract(raw, '\b(\d{{6}})\b', 1) AS any_ FROM p)
    SELECT person_id, CASE WHEN full_ THEN pc WHEN any_ <> '' THEN any_ END AS postal_code, CASE WHEN full_ THEN n WHEN any_ <> '' THEN '' END AS street_number,
      CASE WHEN full_ THEN CASE WHEN u <> '' THEN '#' || u || ', ' ELSE '' END || n || ', ' || st || ', singapore ' || pc || ', sg' WHEN any_ <> '' THEN lower(raw) END AS normalized_full,
      CASE WHEN raw = 'n/a' THEN 'placeholder_value' WHEN full_ THEN 'valid' WHEN any_ <> '' THEN 'partial_parse' ELSE 'invalid_format' END AS quality FROM m""")
def normalize_address(v: Views):
    return v.person.select("person_id", normalize.normalize_address(F.expr(PLACE)).alias("a")).select("person_id", "a.postal_code", "a.street_number", "a.normalized_full", "a.quality")


@query("""
    SELECT product_id, CASE WHEN lower(trim(regexp_replace(display_name, '\\s+', ' ', 'g'))) IN ('na', 'unknown') THEN NULL ELSE trim(regexp_replace(display_name, '\\s+', ' ', 'g')) END AS name FROM product""")
def normalize_name(v: Views):
    return v.product.select("product_id", normalize.normalize_name(F.col("display_name"))["value"].alias("name"))


@query()
def name_similarity(v: Views):
    """Jaro-Winkler of each known pair's names; its form differs from DuckDB's, so tests hold a table of fixed cases."""
    p = v.person.select(F.col("person_id").alias("src"), F.col("preferred_full_name").alias("a"))
    q = v.person.select(F.col("person_id").alias("dst"), F.col("preferred_full_name").alias("b"))
    return v.knows.select("src", "dst").join(p, "src").join(q, "dst").select("src", "dst", F.round(similarity.jaro_winkler("a", "b"), 6).alias("similarity"))


@query("""
    WITH x AS (SELECT k.src, k.dst, substr(a.preferred_phone, 4) AS p, substr(b.preferred_phone, 4) AS q FROM knows k JOIN person a ON a.person_id = k.src JOIN person b ON b.person_id = k.dst)
    SELECT src, dst, coalesce(p <> q AND (levenshtein(p, q) = 1 OR (length(p) = length(q) AND levenshtein(p, q) = 2 AND list_contains([substr(p, 1, CAST(i AS INT) - 1) || substr(p, CAST(i AS INT) + 1, 1) || substr(p, CAST(i AS INT), 1) || substr(p, CAST(i AS INT) + 2) for i in [1,2,3,4,5,6,7]], q))), false) AS near FROM x""")
def phone_near_match(v: Views):
    p = v.person.select(F.col("person_id").alias("src"), F.col("preferred_phone").alias("a"))
    q = v.person.select(F.col("person_id").alias("dst"), F.col("preferred_phone").alias("b"))
    return v.knows.select("src", "dst").join(p, "src").join(q, "dst").select("src", "dst", similarity.phone_near_match(F.col("a"), F.col("b")).alias("near"))


@query("""
    SELECT record_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, NULL::VARCHAR AS error, true AS present FROM source_record""")
def payload_integers(v: Views):
    fact = facts.payload_fact(F.col("props"), "k")
    out = v.source_record.select("record_id", fact.alias("f")).withColumn("n", facts.convert_integral(F.lit("str"), F.col("f.value")))
    return out.select("record_id", F.col("n.value").alias("k"), F.col("n.error").alias("error"), F.col("f.present").alias("present"))


@query(r"""
    WITH p AS (SELECT record_id, payload, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM deal_payload),
    f AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS whole, coalesce(j->'$.amount', j->'$.opportunity', j->'$.OPPORTUNITY', j->'$.deal.amount', j->'$.deal.opportunity', j->'$.deal.OPPORTUNITY') AS a,
      coalesce(j->'$.currency', j->'$.currency_id', j->'$.CURRENCY_ID', j->'$.deal.currency', j->'$.deal.currency_id', j->'$.deal.CURRENCY_ID') AS c, coalesce(j->'$.ASSIGNED_BY_ID', j->'$.assigned_by_id', j->'$.deal.ASSIGNED_BY_ID', j->'$.deal.assigned_by_id') AS s,
      coalesce(j->'$.CONTACT_IDS', j->'$.CONTACT_ID', j->'$.deal.CONTACT_IDS', j->'$.deal.CONTACT_ID') AS k FROM p),
    n AS (SELECT *, CASE WHEN json_type(a) = 'VARCHAR' THEN TRY_CAST(trim(a->>'$') AS DOUBLE) WHEN json_type(a) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(a AS DOUBLE) END AS number, upper(trim(c->>'$')) AS code,
      json_type(c) = 'VARCHAR' AND regexp_full_match(upper(trim(c->>'$')), '\p{L}{3}') AS letters FROM f)
    SELECT record_id, CASE WHEN payload IS NULL THEN 'missing' WHEN NOT whole THEN 'invalid' WHEN a IS NULL OR json_type(a) = 'NULL' OR a->>'$' = '' THEN 'missing' WHEN NOT coalesce(number >= 0, false) THEN 'invalid' WHEN number = 0 THEN 'zero' ELSE 'known' END AS amount_state,
      CASE WHEN whole AND number >= 0 THEN number END AS amount_value,
      CASE WHEN payload IS NULL THEN 'missing' WHEN NOT whole THEN 'invalid' WHEN c IS NULL OR json_type(c) = 'NULL' OR c->>'$' = '' THEN 'missing' WHEN NOT coalesce(letters, false) THEN 'invalid' WHEN code IN ('SGD', 'USD', 'MYR') THEN 'supported' ELSE 'unsupported' END AS currency_status,
      CASE WHEN whole AND letters THEN code END AS currency, coalesce(whole AND json_type(s) IN ('VARCHAR', 'UBIGINT', 'BIGINT') AND s->>'$' NOT IN ('', '0'), false) AS assigned_known,
      CASE WHEN NOT whole THEN 0 WHEN json_type(k) = 'ARRAY' THEN len(list_filter(json_extract(k, '$[*]'), lambda x: json_type(x) IN ('VARCHAR', 'UBIGINT', 'BIGINT') AND trim(x->>'$') <> '')) WHEN k->>'$' <> '0' AND trim(k->>'$') <> '' THEN 1 ELSE 0 END::INT AS contact_count
    FROM n""")
def payload_facts(v: Views):
    return v.deal_payload.select("record_id", facts.payload_facts(F.col("payload")).alias("f")).select("record_id", "f.*")


DOBS = "SELECT record_id, CASE record_id % 9 WHEN 0 THEN '1990-13-45' WHEN 1 THEN '2090-01-01' WHEN 2 THEN '1850-02-02' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'soon' ELSE '1985-07-09' END AS dob, observed_at, (record_id % 1000) / CAST(1000 AS DOUBLE) AS share FROM {source_record}"


@query(f"""
    WITH d AS ({DOBS.replace("{source_record}", "source_record")}), x AS (SELECT *, TRY_CAST(dob AS DATE) AS day FROM d)
    SELECT record_id, strftime(observed_at, '%d %b %Y, %I:%M %p') AS at, CAST(CAST(round_even(share * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS percent,
      CASE WHEN dob IS NULL OR dob = '' THEN '—' WHEN day <= DATE '2024-01-15' AND year(day) >= 2024 - 130 THEN strftime(day, '%d %b %Y') ELSE dob END AS dob, coalesce(dob <> '' AND NOT coalesce(day <= DATE '2024-01-15' AND year(day) >= 2024 - 130, false), false) AS invalid FROM x""")
def display_forms(v: Views):
    rows = v.sql(DOBS)
    shown = facts.display_dob(F.col("dob"), F.to_date(F.lit("2024-01-15")))
    return rows.select("record_id", facts.display_datetime(F.col("observed_at")).alias("at"), facts.display_percent(F.col("share")).alias("percent"), shown["text"].alias("dob"), shown["invalid"].alias("invalid"))


@query("SELECT record_id, 'sv1:' || length(source_record_id) || ':' || source_record_id || length(record_hash) || ':' || record_hash AS version_key, sha256('{\"hash\":\"' || record_hash || '\",\"id\":\"' || source_record_id || '\"}') AS digest FROM source_record")
def version_keys(v: Views):
    digest = facts.digest(facts.canonical_json(id=F.col("source_record_id"), hash=F.col("record_hash")))
    return v.source_record.select("record_id", facts.key_of(F.col("source_record_id"), F.col("record_hash")).alias("version_key"), digest.alias("digest"))


@query("""
    SELECT order_id, CASE WHEN total_amount <= 1000 THEN 'low' WHEN total_amount <= 100000 THEN 'mid' ELSE 'high' END AS band, strftime(ordered_at, '%d %b %Y') AS shown FROM sales_order""")
def display_and_bands(v: Views):
    return v.sales_order.select("order_id", facts.band(F.col("total_amount"), [1000.0, 100000.0], ["low", "mid", "high"]).alias("band"), facts.display_date(F.col("ordered_at")).alias("shown"))


@query("SELECT true AS equal")
def two_pass_digest(v: Views):
    again = v.sales_order.select(*reversed(v.sales_order.columns)).repartition(7)
    return facts.same_rows(v.sales_order, again)


@query("SELECT person_id FROM person WHERE preferred_email IS NULL OR (split_part(preferred_email, '@', 2) <> 'example.net' AND preferred_email NOT IN (SELECT preferred_email FROM person WHERE status = 'merged' AND preferred_email IS NOT NULL))")
def record_exclusion(v: Views):
    rows = v.person.select("person_id", F.col("preferred_email").alias("email"))
    return lc.excluded(rows, emails=v.person.where("status = 'merged' and preferred_email is not null").select(F.col("preferred_email").alias("email")), domains=["example.net"]).select("person_id")


@query("""
    WITH lines AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations)
    SELECT conv_id, turn, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '^\\[\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}\\]')) AS n_stamped FROM lines WHERE line IS NOT NULL GROUP BY ALL""")
def transcript_lines(v: Views):
    rows = tr.lines_of(v.conversations, "text", ["conv_id", "turn"])
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_lines"), F.count_if("stamped").alias("n_stamped"))


@query("""
    WITH t AS (SELECT conv_id, string_agg('[2024-01-01 10:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00] ' || role || ' (+6591234567): ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn, role, text) AS body, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, n AS messages FROM t""")
def chat_transcripts(v: Views):
    stamp = F.concat(F.lit("[2024-01-01 10:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00] "), F.col("role"), F.lit(" (+6591234567): "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    talks = v.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", stamp.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
    return tr.messages(talks, "text", ["conv_id"]).groupBy("conv_id").agg(F.count("*").alias("messages"))
