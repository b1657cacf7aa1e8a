"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates fit rare words fast, and L1 regularisation leaves few weights that are not zero, so the
model is a short list that is cheap to broadcast. Words, word heads, word pairs and pairs with one word skipped are
hashed into a space of fixed size. Training runs on shards of a bounded sample of labelled rows; a weight is the mean
over the shards that keep it. Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, map_batches, pa_schema, stage, table

WORD = re.compile(r"\w+")
#: Letters of a word that stand for its derivations.
HEADS = (4, 5)
CACHE = 300_000


@dataclass(frozen=True)
class Settings:
    """dim: size of the hashed space, a power of two; sample: labelled rows to train on, about, at most; shard_rows: of these,
    about as many train one after the other in a task."""

    dim: int = 1 << 20
    sample: int = 20_000
    shard_rows: int = 10_000
    epochs: int = 6
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    threshold: float = 0.3


class Features:
    """Texts to distinct feature numbers below dim."""

    def __init__(self, dim: int):
        self.mask, self.cache = np.uint64(dim - 1), {}

    def _mixed(self, x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & self.mask

    def of(self, text: str | None) -> np.ndarray:
        """Feature numbers, repeats included."""
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.int64)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        try:
            both = list(map(cache.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in cache:
                    cache[w] = (zlib.crc32(w.encode()), *(zlib.crc32(w[:n].encode()) for n in HEADS))
            both = list(map(cache.__getitem__, words))
        h, *heads = np.array(both, np.uint64).T
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        parts = [h * a, *(x * b + np.uint64(n) for n, x in zip(HEADS, heads, strict=True)), h[:-1] * a + h[1:] * b + np.uint64(2), h[:-2] * a + h[2:] * c + np.uint64(3)]
        return self._mixed(np.concatenate(parts)).astype(np.int64)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(examples: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights that are not zero: their numbers and values. Number dim is the bias, which is not regularised."""
    z, n = np.zeros(s.dim + 1), np.zeros(s.dim + 1)
    bias = np.array([s.dim])
    l1 = np.full(s.dim + 1, s.l1)
    l1[s.dim] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        own, bound = z[at], l1[at]
        return np.where(np.abs(own) <= bound, 0.0, (np.sign(own) * bound - own) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for features, label in examples:
            at = np.concatenate([features, bias])
            w = weights(at)
            g = sigmoid(w.sum()) - label
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / s.alpha * w
    w = weights(np.arange(s.dim + 1))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def fit(examples: DataFrame, rows: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """examples (doc_id, features, toxic), a bounded sample of about so many rows. Returns weights by number, at most dim + 1 of them."""
    ddl = "feature int, weight double, shard int"
    out = pa_schema(examples.sparkSession, ddl)

    def shard(own: pa.Table) -> pa.Table:
        own = own.sort_by([("turn", "ascending"), ("doc_id", "ascending")])
        kept, w = train([(np.array(f, np.int32), y) for f, y in zip(own["features"].to_pylist(), own["toxic"].to_pylist(), strict=True)], s)
        return pa.table([pa.array(kept, pa.int32()), pa.array(w), pa.array(np.full(len(kept), own["shard"][0].as_py()), pa.int32())], schema=out)

    dealt = examples.select("doc_id", "features", "toxic", F.xxhash64("doc_id", F.lit(1)).alias("turn"))
    dealt = dealt.withColumn("shard", F.pmod("turn", F.lit(max(1, round(rows / s.shard_rows)))).cast("int"))
    models = dealt.groupBy("shard").applyInArrow(shard, ddl)
    merged = models.groupBy("feature").agg(F.avg("weight").alias("weight"))  # bias included
    got = merged.toPandas().sort_values("feature")
    return got["feature"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """Labelled rows that are not held out, about s.sample of them, picked by a hash of doc_id; and about how many.

    Texts are hashed where they are read, so that numbers alone are shuffled. A doc_id of several documents gives one example.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stage(known, "toxicity-labels")
    rows = known.count()
    share = min(1.0, s.sample / max(1, rows))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # s.sample rows of two numbers

    def each(batch: pa.RecordBatch) -> dict:
        features = held(("features", s.dim), lambda: Features(s.dim))
        return {"doc_id": batch.column(0), "features": [np.unique(features.of(t)) for t in batch.column(1).to_pylist()], "toxic": batch.column(2)}

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    hashed = map_batches(texts.select("doc_id", "text", "toxic"), each, f"doc_id {kinds['doc_id']}, features array<int>, toxic {kinds['toxic']}")
    return hashed.groupBy("doc_id").agg(F.min("features").alias("features"), F.max("toxic").alias("toxic")), min(rows, s.sample)


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, held_out, score, predicted, for every input row; keep: more columns to pass on.

    labels (doc_id, toxic 0 or 1): rows held out, null ones and ones without a document teach nothing; of repeated ones the
    largest counts. An empty or null text gets the score of the bias. Without labels every score is 0. A null doc_id is not
    held out and is scored. Columns of docs that are named as those of the result are not passed on. An empty table gives no rows.
    """
    spark, keep = docs.sparkSession, keep or []
    numbers, values = fit(*training_sample(docs, labels, settings), settings)
    model = spark.sparkContext.broadcast((numbers.astype(np.int32), values.astype(np.float32)))
    dim, threshold = settings.dim, settings.threshold
    own: dict = {}

    def each(batch: pa.RecordBatch) -> dict:
        if not own:
            w = np.zeros(dim + 1, np.float32)
            numbers, values = model.value
            w[numbers] = values
            own.update(w=w, known=len(numbers))
        w, features, scores = own["w"], held(("features", dim), lambda: Features(dim)), []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            at = features.of(text)
            at = np.unique(at[w[at] != 0])
            scores.append(sigmoid(float(w[dim]) + float(w[at].sum())) if own["known"] else 0.0)
        return dict(zip(batch.schema.names, batch.columns, strict=True)) | {"score": scores, "predicted": [int(x >= threshold) for x in scores]}

    read = docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema) + ", score double, predicted int"
    out = map_batches(read, each, ddl) if "text" in keep else map_batches(read, each, ddl).drop("text")
    return out.withColumn("held_out", is_held_out(F.col("doc_id")))


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" if n not in ("doc_id", "text") else n for i, n in enumerate(names)))
    return score(plain, labels, settings, plain.columns).where("predicted = 0").select(*plain.columns).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
