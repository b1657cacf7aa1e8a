"""Centroid clustering by weighted deduplication.

Vectors become whole numbers, and equal ones are made one with their multiplicity, so a vector that many rows share costs as
much as any other. Lloyd's rounds run over the distinct vectors: each Arrow batch assigns its rows to the centroids and
gives weighted sums of whole numbers by centroid and component, which Spark adds up exactly; the centroids, a few thousand numbers, are
what a round hands to the next. Assignments are joined back to the rows by vector.

Numbers. Distances are taken as doubles where every term stays below 2^53 and is exact, else as Python's whole numbers. Components
and distances beyond a long are given as the nearest long; sums have 38 digits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stage, table

SCALE, DIM, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, "2"
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Components up to this keep all terms of a distance of up to 2^12 components below 2^53.
EXACT = 1 << 19


def quantised(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vectors (vec_id, embedding, ...) to (vec_id, q): q the components floor(256 * x) as a binary of little-endian longs.

    Rows whose embedding is null, has another number of components, or holds null or non-finite ones are left out.
    """

    def each(batch: pa.RecordBatch) -> dict:
        rows, column = [], batch.column(1)
        ids = batch.column(0).to_pylist()
        for i, x in zip(ids, column, strict=True):
            values = x.values
            if values is None or len(values) != dim or values.null_count:
                continue
            v = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE) if np.isfinite(np.asarray(values, np.float64)).all() else None
            if v is not None:
                rows.append((i, longs(v).tobytes()))
        return {"vec_id": [r[0] for r in rows], "q": [r[1] for r in rows]}

    return map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), each, "vec_id long, q binary")


def longs(v: np.ndarray) -> np.ndarray:
    """Whole doubles as longs, the nearest one where they are beyond it; an overflow of the scale too."""
    inside = np.abs(v) < 2.0**63
    return np.where(inside, np.where(inside, v, 0).astype("<i8"), np.where(v > 0, HIGH, LOW)).astype("<i8")


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def nearest(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """For each row the number of its nearest centroid, the smaller on ties, and the squared distance."""
    c = np.array(centroids, object)
    small = len(q) == 0 or max(int(q.max()), -int(q.min()), max(abs(x) for row in centroids for x in row)) <= EXACT
    x, c = (q.astype(np.float64), c.astype(np.float64)) if small else (q.astype(object), c)
    far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    at = far.argmin(1) if small else np.array([min(range(len(centroids)), key=row.__getitem__) for row in far], int)
    return at, [min(int(far[i, k]), HIGH) for i, k in enumerate(at)]


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(q, n) with cluster and distance."""

    def each(batch: pa.RecordBatch) -> dict:
        at, far = nearest(unpacked(batch.column(0)), centroids) if batch.num_rows else ([], [])
        return {"q": batch.column(0), "n": batch.column(1), "cluster": np.asarray(at, np.int32), "distance": far}

    return map_batches(distinct.select("q", "n"), each, "q binary, n long, cluster int, distance long")


def moved(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of the weighted mean, by component; those without vectors stay.

    A batch gives one row for each centroid that it meets and each component: at most clusters x components rows, whatever its size.
    """

    def each(batch: pa.RecordBatch) -> dict:
        sums: dict[int, list] = {}
        if batch.num_rows:
            q, n = unpacked(batch.column(0)), batch.column(1).to_numpy()
            at, _ = nearest(q, centroids)
            # 2^31 rows of a batch's weight stay exact as longs; beyond that, and for large components, Python's numbers
            wide = int(n.sum()) > 1 << 31 or max(int(q.max()), -int(q.min())) > 1 << 31
            q, n = (q.astype(object), n.astype(object)) if wide else (q, n)
            sums = {int(k): [int(n[at == k].sum()), *(n[at == k][:, None] * q[at == k]).sum(0)] for k in np.unique(at)}
        rows = [(k, d, int(s)) for k, row in sums.items() for d, s in enumerate(row)]
        return {"cluster": [r[0] for r in rows], "d": [r[1] for r in rows], "s": [str(r[2]) for r in rows]}

    parts = map_batches(distinct.select("q", "n"), each, "cluster int, d int, s string")
    totals = parts.groupBy("cluster", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters x components rows
    got = {(r["cluster"], r["d"]): int(r["s"]) for r in totals}
    return [[got[k, d + 1] // got[k, 0] for d in range(len(row))] if (k, 0) in got else row for k, row in enumerate(centroids)]


def initial(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of seed:vec_id, in ascending order of it; of one vec_id the smaller vector first. Rows without vec_id are not taken."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(digest.alias("digest"), "q").orderBy("digest", "q").limit(clusters).collect()
    return [np.frombuffer(r["q"], "<i8").tolist() for r in rows]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM) -> DataFrame:
    """vectors (vec_id, embedding, ...) to vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    One row for every row that quantised() keeps, repeated ones and ones without vec_id too. With fewer rows than clusters there are
    as many centroids as rows with a vec_id; without any such row there is no result. Other columns are not read.
    """
    own = stage(quantised(vectors, dim), "clusters-vectors")
    distinct = stage(own.groupBy("q").agg(F.count("*").alias("n")), "clusters-distinct")
    centroids = initial(own, clusters, seed)
    if not centroids:
        return own.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))).where("false")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    found = stage(assigned(distinct, centroids), "clusters-assigned")
    weight = F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")
    inertia = found.groupBy("cluster").agg(F.sum(weight).alias("own")).collect()  # one row a cluster
    whole = min(sum(int(r["own"]) for r in inertia), HIGH)
    rows = [(r["cluster"], min(int(r["own"]), HIGH), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in inertia]
    known = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = own.join(found.select("q", "cluster", "distance"), "q").join(F.broadcast(known), "cluster")  # one row a cluster
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    """The rounds written out one after the other: near assigns, then means move."""
    parts = []
    for k in range(ROUNDS + 1):
        parts.append(f"""far{k} AS (
  SELECT r, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM flat v JOIN mean{k} m USING (i) GROUP BY r, c
), near{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM far{k} GROUP BY r)""")
        if k < ROUNDS:
            parts.append(f"""sums{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM near{k} JOIN flat USING (r) GROUP BY c, i),
mean{k + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE CAST((s - (((s % n) + n) % n)) // n AS BIGINT) END AS x FROM mean{k} LEFT JOIN sums{k} USING (c, i))""")
    return ",\n".join(parts)


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
), flat AS MATERIALIZED (SELECT r, unnest(q) AS x, unnest(range({DIM})) AS i FROM kept),
firsts AS (SELECT q, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS}),
mean0 AS MATERIALIZED (SELECT c, unnest(q) AS x, unnest(range({DIM})) AS i FROM firsts),
{_rounds()},
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM mean{ROUNDS} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM kept JOIN near{ROUNDS} USING (r) JOIN digests USING (c)
"""
