"""Incremental ingestion with Structured Streaming: overlap, duplicates, versions, late facts, retirement, absence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OVERLAP_SECONDS = 300


def since(rows: DataFrame, high_water: str | None, at: str = "updated_at", overlap: int = OVERLAP_SECONDS) -> DataFrame:
    """Rows after the high-water mark less an overlap; the overlap is read again and its repeats are dropped by hash."""
    if high_water is None:
        return rows
    return rows.where(F.col(at) >= F.to_timestamp(F.lit(high_water)) - F.expr(f"interval {overlap} seconds"))


def new_rows(incoming: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("source_record_id", "record_hash")) -> DataFrame:
    """Rows of a batch that are not held yet, each once: the same batch twice has no second effect."""
    return incoming.dropDuplicates(list(keys)).join(held.select(*keys), list(keys), "left_anti")


def deduplicated(stream: DataFrame, at: str = "observed_at", keys: tuple[str, ...] = ("source_record_id", "record_hash"), late: str = f"{OVERLAP_SECONDS} seconds") -> DataFrame:
    """A stream without repeats within the watermark, which also bounds the state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def _allocate(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version, last = state.get if state.exists else (0, None)
    # a key's rows come in several Arrow batches: they are put in order as a whole, repeats of one moment and hash once
    parts = [rows[["observed_at", "record_hash"]].drop_duplicates() for rows in batches]
    rows = pd.concat(parts).drop_duplicates().sort_values(["observed_at", "record_hash"], kind="stable")
    out = []
    for at, digest in zip(rows["observed_at"], rows["record_hash"], strict=True):
        if digest != last:
            version, last = version + 1, digest
            out.append((*key, at, digest, version))
    if out:
        yield pd.DataFrame(out, columns=["source_system", "source_record_id", "observed_at", "record_hash", "version"])
    state.update((version, last))


def allocate_versions(stream: DataFrame) -> DataFrame:
    """Versions per source identity, allocated by state: a hash that equals the one before is no new version.

    State holds two values for an identity, whatever its history; a task holds the moments and hashes that one micro-batch brings for one identity.
    """
    out = "source_system string, source_record_id string, observed_at timestamp, record_hash string, version long"
    return stream.groupBy("source_system", "source_record_id").applyInPandasWithState(_allocate, out, "version long, last string", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("source_record_id", "record_hash")) -> StreamingQuery:
    """Appends what is new of each micro-batch to the parquet table at target. The checkpoint is the committed high-water mark.

    Keys that were seen are kept as state, dealt by key, so a batch costs what it brings and never a read of the target; at a large number of
    keys take the RocksDB state store. A batch that is run again writes into its own folder, batch=<id>, and replaces it: the effect is that of one run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.dropDuplicates(list(keys)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asserted(batch: DataFrame, expected: DataFrame, keys: list[str]) -> None:
    """Fails if stored totals (keys, stored) are not those of a batch, before anything is committed."""
    actual = batch.groupBy(*keys).agg(F.count("*").alias("actual"))
    wrong = expected.join(actual, keys, "full").where(~F.coalesce("stored", F.lit(0)).eqNullSafe(F.coalesce("actual", F.lit(0))))
    first = wrong.take(1)
    if first:
        raise ValueError(f"unit does not add up: {first[0].asDict()}")


def resolve_late(facts: DataFrame, customers: DataFrame, key: str, fact_time: str, customer_time: str, wait: str = "1 hour") -> DataFrame:
    """Facts joined to customers that come up to so much later; after the wait a fact goes out without one."""
    f = facts.withWatermark(fact_time, wait).alias("f")
    c = customers.withWatermark(customer_time, wait).select(F.col(key).alias("_key"), F.col(customer_time).alias("_at"), "person_id").alias("c")
    near = (F.col(f"f.{key}") == F.col("c._key")) & (F.col("c._at") >= F.col(f"f.{fact_time}") - F.expr(f"interval {wait}")) & (F.col("c._at") <= F.col(f"f.{fact_time}") + F.expr(f"interval {wait}"))
    return f.join(c, near, "leftOuter").drop("_key", "_at")


def monthly_counts(rows: DataFrame, at: str, by: list[str]) -> DataFrame:
    """Counts by calendar month; with a stream, window() on a watermarked column takes its place."""
    return rows.groupBy(F.date_format(at, "yyyy-MM").alias("month"), *by).agg(F.count("*").alias("rows"))


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), *by, "rows")


def absence(previous: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """previous (key, missing) after a full listing: 0 where seen, one more where not; new keys start at 0."""
    seen = listing.select(key).distinct().withColumn("seen", F.lit(True))
    return previous.join(seen, key, "full").select(key, F.when(F.col("seen"), 0).otherwise(F.coalesce("missing", F.lit(0)) + 1).alias("missing"))


def dead_letters(rows: DataFrame, retries: DataFrame, key: str, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Failed rows (key) to those to try again and those given up, by the number of tries (key, tries) so far."""
    counted = rows.join(retries.select(key, "tries"), key, "left").withColumn("tries", F.coalesce("tries", F.lit(0)) + 1)
    return counted.where(F.col("tries") <= most), counted.where(F.col("tries") > most)


def extracted(conversations: DataFrame, extractor, schema: str) -> DataFrame:
    """Rows that an extractor finds in conversations (conv_id, text): a function of a frame of texts to a frame of rows, given whole batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield extractor(frame)

    return conversations.select("conv_id", "text").mapInPandas(run, schema)


def rule_extractor(frame: pd.DataFrame) -> pd.DataFrame:
    """Emails and phone numbers by pattern: what is used where no model is given."""
    kinds = {"email": r"[\w.+-]+@[\w-]+\.[\w.]*\w", "phone": r"\+\d[\d ]{6,14}\d"}
    found = [(c, k, m) for k, p in kinds.items() for c, ms in zip(frame["conv_id"], frame["text"].fillna("").str.findall(p), strict=True) for m in ms]
    return pd.DataFrame(found, columns=["conv_id", "identifier_type", "raw"]) if found else pd.DataFrame({"conv_id": pd.Series(dtype="int64"), "identifier_type": pd.Series(dtype=str), "raw": pd.Series(dtype=str)})


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def appended(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into the parquet table at target, and reads that."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
