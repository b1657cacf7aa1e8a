"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..staging import cut, new_folder

#: Settings of Spark, their defaults, and what operators set in their place: a batch is held whole by a worker, and texts may be long.
BATCH = [("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b")]


def new_path(spark: SparkSession, name: str) -> str:
    return new_folder(spark, name)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    return cut(df, name)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches handed to Python, by rows and by bytes, where the session still has Spark's own defaults."""
    for key, default, own in BATCH:
        if spark.conf.get(key) == default:
            spark.conf.set(key, own)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """Arrow batches in, columns out. each() may be called for a slice of a batch."""
    small_batches(df.sparkSession)
    out = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = each(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


_held: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one object at a time, so the caches of an operator go when another begins."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary; KINWEAVE_TOKENIZERS names another folder."""
    folder = os.environ.get("KINWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
