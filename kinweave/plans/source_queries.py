"""Queries that write tables in a source's form and read them back, and that replay tables as streams.

Files go to new folders of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import new_folder
from ..sources import dumps
from ..streaming import incremental as inc
from .catalog import query
from .views import Views


@query("SELECT doc_id, text, lang, source FROM documents")
def dump_copy_read(v: Views):
    """Documents as PostgreSQL COPY text, with tabs, line ends and backslashes in it, read back in ranges."""
    path = new_folder(v.spark, "dump-copy")
    dumps.write_copy(v.documents.select("doc_id", "text", "lang", "source"), "documents", path)
    return dumps.read_dump(v.spark, path, "documents", "doc_id long, text string, lang string, source string")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT -doc_id, text, NULL, lang FROM documents")
def dump_insert_read(v: Views):
    """Customers and whole texts as MySQL INSERT statements; their column names come from CREATE TABLE."""
    path = new_folder(v.spark, "dump-insert")
    texts = v.documents.select(-F.col("doc_id"), "text", F.lit(None).cast("double"), "lang")
    dumps.write_inserts(v.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").union(texts), "clients", path)
    return dumps.read_dump(v.spark, path, "clients", "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


ENVELOPES = """
    SELECT CASE WHEN event_id % 41 = 0 THEN '' ELSE 'crm' END AS source_system, CAST(event_id AS STRING) AS source_record_id,
      CASE event_type WHEN 'purchase' THEN 'crm_deal' WHEN 'view' THEN 'crm_history' WHEN 'click' THEN 'conversation' WHEN 'error' THEN 'fax' ELSE 'identity' END AS record_type,
      CASE WHEN event_id % 43 <> 0 THEN 'h' || CAST(event_id % 7 AS STRING) END AS record_hash, CASE WHEN event_id % 3 <> 0 THEN 'p' END AS parent_record_id,
      CASE WHEN event_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS extraction_confidence, CASE WHEN event_id % 2 = 0 THEN 'rules' END AS extraction_method FROM {events}"""


@query(f"""
    WITH e AS ({ENVELOPES.replace("{events}", "events").replace("AS STRING", "AS VARCHAR")})
    SELECT source_record_id, record_type, CASE WHEN source_system = '' THEN 'no_source' WHEN record_hash IS NULL THEN 'no_hash' WHEN record_type = 'fax' THEN 'bad_type'
      WHEN record_type = 'crm_history' AND parent_record_id IS NULL THEN 'no_parent' WHEN record_type = 'conversation' AND extraction_method IS NULL THEN 'no_extraction'
      WHEN record_type <> 'conversation' AND extraction_method IS NOT NULL THEN 'extraction_forbidden' END AS error FROM e""")
def landed_pages_checked(v: Views):
    """Envelopes as landed JSON pages, read back and checked."""
    path = new_folder(v.spark, "landed")
    v.sql(ENVELOPES).write.json(path)
    return dumps.checked(dumps.read_landed(v.spark, path)).select("source_record_id", "record_type", "error")


def replay(v: Views, rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """rows as a stream of files, and a new folder for what becomes of it. Watermarks need moments, so local times become such."""
    path = new_folder(v.spark, f"{name}-in")
    rows = rows.select(*(F.col(c).cast("timestamp") if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes))
    rows.write.parquet(path)
    return inc.file_stream(v.spark, path, rows.schema, kind="parquet"), new_folder(v.spark, name)


def local_times(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).cast("timestamp_ntz") if kind == "timestamp" else F.col(c) for c, kind in rows.dtypes))


OBSERVATIONS = """
    SELECT 's' || CAST(user_id % 3 AS STRING) AS source_system, CAST(user_id AS STRING) AS source_record_id, ts AS observed_at, 'h' || CAST(CAST(floor(event_id / 40) AS BIGINT) % 3 AS STRING) AS record_hash FROM {events}"""
SEEN = OBSERVATIONS.replace("{events}", "events")


@query(f"""
    WITH o AS ({SEEN}), l AS (SELECT *, lag(record_hash) OVER w AS before FROM o WINDOW w AS (PARTITION BY source_system, source_record_id ORDER BY observed_at, record_hash))
    SELECT source_system, source_record_id, observed_at, record_hash, row_number() OVER (PARTITION BY source_system, source_record_id ORDER BY observed_at, record_hash) AS version
    FROM l WHERE before IS DISTINCT FROM record_hash""")
def stream_versions(v: Views):
    """Versions that keyed state allocates, in a stream: a hash that equals the one before is none."""
    stream, out = replay(v, v.sql(OBSERVATIONS), "versions")
    return inc.appended(inc.allocate_versions(stream), f"{out}/rows", f"{out}/state").transform(local_times)


@query(f"SELECT DISTINCT source_record_id, record_hash FROM ({SEEN})")
def stream_ingest_replayed(v: Views):
    """A source that is delivered twice, the second time after the first was committed: no second effect."""
    rows = v.sql(OBSERVATIONS).select("source_record_id", "record_hash")
    source, out = new_folder(v.spark, "ingest-in"), new_folder(v.spark, "ingest")
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        inc.ingest(inc.file_stream(v.spark, source, rows.schema, kind="parquet"), f"{out}/rows", f"{out}/state").awaitTermination()
    return v.spark.read.schema("source_record_id string, record_hash string, batch long").parquet(f"{out}/rows").drop("batch")


@query("SELECT DISTINCT event_id, ts, event_type FROM events")
def stream_deduplicated(v: Views):
    """Events that arrive twice within the watermark, each once."""
    rows = v.events.select("event_id", "ts", "event_type")
    stream, out = replay(v, rows.union(rows), "deduplicated")
    return inc.appended(inc.deduplicated(stream, "ts", ("event_id", "ts", "event_type")), f"{out}/rows", f"{out}/state").transform(local_times)


@query("""
    WITH h AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS rows FROM events GROUP BY 1, 2)
    SELECT * FROM h WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_hourly_counts(v: Views):
    """Counts of the hours that the watermark has closed."""
    stream, out = replay(v, v.events.select("ts", "event_type"), "hours")
    return inc.appended(inc.windowed_counts(stream, "ts", ["event_type"]), f"{out}/rows", f"{out}/state").transform(local_times)
