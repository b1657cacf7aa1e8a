"""Digests of tables as trees: equal tables have equal roots, and differing rows are found by descent.

A row lies under the digest of its key, 256 ways at each level. The lowest level folds the rows of a bucket, each level above the
256 nodes below a node, so no text is longer than one bucket and no dense numbers are needed. Where two trees differ, only nodes
below differing nodes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import cut

#: Rows of a lowest bucket that are aimed at, and the deepest tree: 256^4 buckets.
ROWS, DEEPEST = 256, 4


def depth_for(count: int) -> int:
    depth = 1
    while depth < DEEPEST and count > ROWS * 256**depth:
        depth += 1
    return depth


def leaves(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key..., at, leaf): at is the digest of the key, leaf that of the row; nulls are told from texts."""
    cell = lambda c: F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    digest = lambda cols: F.sha2(F.concat(*(cell(c) for c in cols)), 256)
    return rows.select(*key, digest(key).alias("at"), digest([*key, *columns]).alias("leaf"))


def tree(found: DataFrame, depth: int) -> DataFrame:
    """Leaves to (level, node, digest, rows) for all levels; level 0 is the root, with node ''. Equal rows count as often as they stand there."""
    fold = F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256)
    # equal rows are counted first, so a row of many copies is one part of its bucket
    distinct = found.groupBy("at", "leaf").agg(F.count("*").alias("rows")).select(F.substring("at", 1, 2 * depth).alias("node"), F.concat(F.col("leaf"), F.lit("*"), F.col("rows").cast("string")).alias("digest"), "rows")
    now = cut(distinct.groupBy("node").agg(fold.alias("digest"), F.sum("rows").alias("rows")), "tree")
    out = now.select(F.lit(depth).alias("level"), "node", "digest", "rows")
    for level in range(depth - 1, -1, -1):
        now = cut(now.withColumn("digest", F.concat("node", "digest")).groupBy(F.substring("node", 1, 2 * level).alias("node")).agg(fold.alias("digest"), F.sum("rows").alias("rows")), "tree")
        out = out.union(now.select(F.lit(level).alias("level"), "node", "digest", "rows"))
    return out


def differences(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], depth: int | None = None) -> DataFrame:
    """Rows of two tables that differ, with their key and what: only_left, only_right or changed. Equal tables give none.

    Keys should be unique; where one has several rows, it is reported once if they differ as multisets.
    """
    depth = depth or depth_for(max(a.count(), b.count()))
    left, right = (cut(leaves(x, key, columns), "leaves") for x in (a, b))
    one, two = cut(tree(left, depth), "tree-left"), cut(tree(right, depth), "tree-right")
    open_: DataFrame | None = None
    for level in range(depth + 1):
        x, y = (t.where(F.col("level") == level).select("node", "digest") for t in (one, two))
        if open_ is not None:
            x, y = (t.join(open_, F.substring(t.node, 1, 2 * (level - 1)) == open_.open, "left_semi") for t in (x, y))
        apart = x.join(y.withColumnRenamed("digest", "other"), "node", "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        open_ = cut(apart.select(F.col("node").alias("open")), "tree-open")
    near = lambda t: t.join(open_, F.substring(t.at, 1, 2 * depth) == open_.open, "left_semi")
    held = lambda t, name: near(t).groupBy("at", *key).agg(F.sort_array(F.collect_list("leaf")).alias(name))
    # joined by the digest of the key, which null keys have too
    one, two = held(left, "mine"), held(right, "theirs").select("at", "theirs", *(F.col(c).alias(f"right_{c}") for c in key))
    both = one.join(two, "at", "full")
    what: Column = F.when(F.col("theirs").isNull(), "only_left").when(F.col("mine").isNull(), "only_right").otherwise("changed")
    return both.where(~F.col("mine").eqNullSafe(F.col("theirs"))).select(*(F.coalesce(c, f"right_{c}").alias(c) for c in key), what.alias("what"))


def root(rows: DataFrame, key: list[str], columns: list[str], depth: int | None = None) -> DataFrame:
    """One row (digest, rows) of a table, the same in whatever order and partitions its rows come."""
    depth = depth or depth_for(rows.count())
    return tree(leaves(rows, key, columns), depth).where("level = 0").select("digest", "rows")
