"""Queries that land tables as pages of a source with cursors, and read them as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import paged
from ..staging import new_folder
from .catalog import query
from .views import Views

#: Chains are kinds of events and shares of users; every 97th record is no object and every 89th has no id.
LANDED = """
    SELECT event_type || '-' || CAST(user_id % 4 AS STRING) AS chain, CAST(floor(event_id / 1000) AS BIGINT) AS page, event_id AS place,
      CASE WHEN event_id % 97 = 5 THEN CAST(event_id AS STRING) WHEN event_id % 89 = 7 THEN to_json(named_struct('user_id', user_id))
        ELSE to_json(named_struct('event_id', event_id, 'user_id', user_id, 'amount', value)) END AS record FROM {events}"""


def landed(v: Views, name: str) -> tuple[DataFrame, str]:
    """The events as pages, read as a stream of rows with their errors, and a new folder for what becomes of it."""
    pages, out = new_folder(v.spark, f"{name}-pages"), new_folder(v.spark, name)
    paged.write_pages(v.sql(LANDED), pages)
    stream = paged.paged_stream(v.spark, f"{out}/pins", path=pages, pagesPerStep="25", mostPages="6400")
    return paged.parsed(stream, "event_id long, user_id long, amount double", "event_id"), out


def drained(stream: DataFrame, out: str) -> DataFrame:
    """Runs the stream until no chain has more, and reads what it wrote."""
    run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


@query("""
    SELECT event_type || '-' || CAST(user_id % 4 AS VARCHAR) AS chain, event_id, user_id, value AS amount FROM events WHERE event_id % 97 <> 5 AND event_id % 89 <> 7""")
def paged_source_read(v: Views):
    """Records of all pages of all chains, each once."""
    rows, out = landed(v, "paged-read")
    return drained(rows, out).where("error IS NULL").select("chain", "event_id", "user_id", "amount")


@query("""
    SELECT event_type || '-' || CAST(user_id % 4 AS VARCHAR) AS chain, CASE WHEN event_id % 97 = 5 THEN 'bad_json' ELSE 'no_key' END AS error, count(*) AS letters
    FROM events WHERE event_id % 97 = 5 OR event_id % 89 = 7 GROUP BY 1, 2""")
def paged_dead_letters(v: Views):
    """Records that cannot be used, by chain and reason."""
    rows, out = landed(v, "paged-letters")
    return drained(rows, out).where("error IS NOT NULL").groupBy("chain", "error").count().withColumnRenamed("count", "letters")
