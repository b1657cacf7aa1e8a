"""Exact top-k inner products by MaxScore.

Vectors become integers. A shard is a block of vectors with an inverted index: for each dimension and sign, the largest
magnitude is the bound of that posting list. A query's terms are its dimensions; a posting adds to a score only where
the signs agree, so a term's bound is its weight times the bound of that list. Terms are sorted by bound; those whose
bounds together stay below the k-th best score so far are non-essential. Essential postings are traversed; candidates go on to
the other terms, largest bound first, only while their partial score and the bounds to come can reach the k-th best.

Shards are dealt to lanes and blocks of queries to waves, both of bounded bytes; every lane meets every wave once. A task
builds each of its shards' indexes once and carries a query's k-th best score from shard to shard. Lanes give at most k
rows a query, which are merged.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pa_schema, stage, table

#: Bytes of a block, of a lane of shards and of a wave of queries, at eight bytes a component.
BLOCK_BYTES, LANE_BYTES, WAVE_BYTES = 4 << 20, 32 << 20, 16 << 20
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


class Shard:
    """An inverted index over a block of integer vectors: doubles while all scores stay below EXACT, else Python's whole numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.high, self.low = self.columns.max(axis=1), self.columns.min(axis=1)

    def search(self, q: np.ndarray, own: int, k: int, floor=-np.inf) -> list[tuple[int, int]]:
        """The k best (score, vec_id) that reach floor, ties to the smaller id; rows with the id own are left out."""
        bound = np.maximum(0, np.maximum(q * self.high, q * self.low))
        terms = np.argsort(-bound, kind="stable")  # largest bound first
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what terms from here on can add
        live = np.flatnonzero(self.ids != own)
        if not len(live) or rest[0] < floor:
            return []
        floor = max(floor, self._floor(q, terms, live, k))
        # essential terms end where the others cannot reach the floor by themselves
        essential = next((e for e in range(1, len(q)) if rest[e] < floor), len(q))
        partial = q[terms[:essential]] @ self.columns[np.ix_(terms[:essential], live)]
        step = 8
        for at in range(essential, len(q), step):  # probe, a few terms at a time, while competitive
            fit = partial + rest[at] >= floor
            live, partial = live[fit], partial[fit]
            some = terms[at : at + step]
            partial = partial + q[some] @ self.columns[np.ix_(some, live)]
        order = sorted(range(len(live)), key=lambda i: (-partial[i], self.ids[live[i]]))[:k] if self.vectors.dtype == object else np.lexsort((self.ids[live], -partial))[:k]
        return [(int(partial[i]), int(self.ids[live[i]])) for i in order]

    def _floor(self, q: np.ndarray, terms: np.ndarray, live: np.ndarray, k: int):
        """A score that k vectors reach: those that lead the postings of the strongest terms are scored."""
        lead = set()
        for t in terms[:4]:
            part = -(self.columns[t, live] * q[t])
            first = np.argsort(part, kind="stable") if part.dtype == object else np.argpartition(part, min(k, len(live)) - 1)
            lead.update(live[first[: 4 * k]].tolist())
        scores = sorted((self.vectors[sorted(lead)] @ q).tolist(), reverse=True)
        return scores[k - 1] if len(scores) >= k else -np.inf


def _blocks(vectors: DataFrame, block_bytes: int) -> DataFrame:
    """Vectors (vec_id, q array<double>) to blocks of equal width: dim, wide, no, ids and data bytes.

    wide: a product of two components may pass what doubles hold exactly. no is unique and follows from where Spark reads the rows.
    """
    ddl = "dim int, wide boolean, no long, ids binary, data binary"
    out = pa_schema(vectors.sparkSession, ddl)

    def pack(batches):
        held: dict[tuple, list] = {}
        no = TaskContext.get().partitionId() << 32

        def block(key, own):
            nonlocal no
            ids, data = zip(*own, strict=True)
            no += 1
            values = (*key, no, np.array(ids, "<i8").tobytes(), np.array(data, "<f8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = (len(v), any(len(v) * x * x >= EXACT for x in v))
                own = held.setdefault(key, [])
                own.append((i, v))
                if len(own) * max(1, len(v)) * 8 >= block_bytes:
                    yield block(key, held.pop(key))
        for key, own in held.items():
            yield block(key, own)

    return vectors.mapInArrow(pack, ddl)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q: floor(256 * x) of each component, as whole doubles; null ids and vectors are left out, and those with a component
    that is null or not finite, before or after it is multiplied. Other columns are not read."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * 256)
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def _matrix(data: bytes, dim: int, whole: bool) -> np.ndarray:
    rows = np.frombuffer(data, "<f8").reshape(-1, dim)
    return np.array([[int(x) for x in row] for row in rows.tolist()], object).reshape(rows.shape) if whole else rows


def _search(shards: list[dict], blocks: list[dict], k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best of some shards for each query, all of one width."""
    best: dict[int, list] = {}
    for s in shards:
        ids, made = np.frombuffer(s["ids"], "<i8"), {}
        for b in blocks:
            asked, dim = np.frombuffer(b["ids"], "<i8").tolist(), s["dim"]
            if dim:
                whole = s["wide"] or b["wide"]
                if whole not in made:
                    made[whole] = Shard(ids, _matrix(s["data"], dim, whole))
                rows = _matrix(b["data"], dim, whole)
            for n, own in enumerate(asked):
                had = best.get(own, [])
                floor = -had[-1][0] if len(had) == k else -np.inf
                found = made[whole].search(rows[n], own, k, floor) if dim else [(0, v) for v in np.sort(ids).tolist() if v != own][:k]
                if found:
                    best[own] = sorted([*had, *((-score, v) for score, v in found)])[:k]
    return [(own, v, min(max(-score, LONG[0]), LONG[1])) for own, found in best.items() for score, v in found]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES, lane_bytes: int = LANE_BYTES, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """vectors and queries (vec_id, q array<double>) to query_id, rank, vec_id, score: each query's k best, ties to smaller ids.

    A query's own vec_id is left out. Vectors of another width than the query's take no part. Repeated queries give one answer;
    repeated vectors are candidates each. A vector without components scores 0. Scores are exact whole numbers; one beyond a long
    counts as the nearest long. Empty tables give no rows. Other columns are not read.
    """
    distinct = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    shards, blocks = stage(_blocks(vectors, block_bytes), "maxscore-shards"), stage(_blocks(distinct, block_bytes), "maxscore-queries")
    number = lambda df, most: max(1, -(-(df.agg(F.sum(F.length("data"))).first()[0] or 0) // most))
    lanes, waves = number(shards, lane_bytes), number(blocks, wave_bytes)
    dealt = lambda name, n: F.pmod(F.xxhash64("no"), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = shards.select("*", dealt("lane", lanes)).select("*", every("wave", waves))
    right = blocks.select("*", dealt("wave", waves)).select("*", every("lane", lanes))
    ddl = "query_id long, vec_id long, score long"
    out = pa_schema(vectors.sparkSession, ddl)

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = _search(own.to_pylist(), asked.to_pylist(), k)
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], schema=out)

    key = ["dim", "lane", "wave"]
    local = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, ddl)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
