"""Ranked full-text search over names: a table of postings kept by batches, and BM25 with the k best by bounds.

Postings (word, key, tf, size, bucket) lie in a folder split by a digest of the word, so a search reads the buckets of its own words
and never a row of the searched table. Frequencies and lengths are counted over the whole index when it is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import cut

K1, B = 1.2, 0.75
BUCKETS = 64


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats included; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def bucket_of(word: Column) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(word, key, tf, size, bucket) of every row with a word; size is the number of words of its text."""
    own = rows.select(F.col(key).alias("key"), words(F.col(column)).alias("w"))
    spread = own.select("key", F.size("w").alias("size"), F.explode("w").alias("word"))
    return spread.groupBy("word", "key", "size").agg(F.count("*").alias("tf")).select("word", "key", "tf", "size", bucket_of(F.col("word")).alias("bucket"))


def write_index(rows: DataFrame, key: str, column: str, path: str) -> None:
    """Postings at path/postings by bucket, and one row a key at path/sizes."""
    found = cut(postings(rows, key, column), "postings")
    found.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    found.select("key", "size").distinct().write.mode("overwrite").parquet(f"{path}/sizes")


def update_index(spark: SparkSession, before: str, changed: DataFrame, key: str, column: str, path: str) -> None:
    """The index at before with the rows of a batch in place of what it held for their keys, written to path; a null text takes a key out."""
    gone = changed.select(F.col(key).alias("key")).distinct()
    kept, sizes = (spark.read.parquet(f"{before}/{part}").join(gone, "key", "left_anti") for part in ("postings", "sizes"))
    new = cut(postings(changed, key, column), "postings")
    kept.select("word", "key", "tf", "size", "bucket").union(new).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    sizes.select("key", "size").union(new.select("key", "size").distinct()).write.mode("overwrite").parquet(f"{path}/sizes")


def search(spark: SparkSession, path: str, queries: list[tuple[str, str]], k: int | None = 10) -> DataFrame:
    """(query_id, key, score, place): the k best keys of each query by BM25, ties to the smaller key; k None gives all keys that share a word.

    A word's bound is what it can add at most. The word with the largest bound of a query gives first scores, whose k-th is a floor; words
    whose bounds together stay below it cannot bring a key among the best by themselves. Keys come from the postings of
    the other words, and the weak ones are only looked up for keys that have come.
    """
    asked = [(q, w) for q, text in queries for w in sorted(set(re.findall(r"[^\W_]+", text.lower())))]
    terms = spark.createDataFrame(asked, "query_id string, word string").withColumn("bucket", bucket_of(F.col("word")))
    buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS
    sizes = spark.read.parquet(f"{path}/sizes").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    n, mean = sizes.first()
    own = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(*buckets)).join(F.broadcast(terms.select("word").distinct()), "word")  # words of the queries
    held = own.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(float(mean or 1))))
    weighed = cut(own.join(F.broadcast(held.select("word", idf.alias("idf"))), "word").select("word", "key", worth.alias("worth")), "search-worth")
    bound = terms.join(weighed.groupBy("word").agg(F.max("worth").alias("bound")), "word").select("query_id", "word", "bound")
    if k is None:
        scores = bound.join(weighed, "word").groupBy("query_id", "key").agg(F.sum("worth").alias("score"))
        return scores.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
    up = Window.partitionBy("query_id").orderBy("bound", "word")
    bound = cut(bound.withColumns({"below": F.sum("bound").over(up.rowsBetween(Window.unboundedPreceding, 0)), "top": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "word")) == 1}), "search-bounds")
    first = bound.where("top").join(weighed, "word").select("query_id", "worth")
    floors = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("worth")))).where(F.col("r") == k).select("query_id", F.col("worth").alias("floor"))
    ranked = cut(bound.join(floors, "query_id", "left").withColumn("strong", F.col("top") | F.coalesce(F.col("below") >= F.col("floor"), F.lit(True))), "search-strong")
    scores = ranked.where("strong").join(weighed, "word").groupBy("query_id", "key").agg(F.sum("worth").alias("strong"))
    keys = cut(scores, "search-keys")
    weak = keys.select("query_id", "key").join(ranked.where("not strong").select("query_id", "word"), "query_id").join(weighed, ["word", "key"]).groupBy("query_id", "key").agg(F.sum("worth").alias("weak"))
    total = keys.join(weak, ["query_id", "key"], "left").select("query_id", "key", (F.col("strong") + F.coalesce("weak", F.lit(0.0))).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
    return total.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
