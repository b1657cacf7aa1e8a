"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Items are cut into windows of so many consecutive words (an item of fewer words is one window), and equal windows are made
one. A window is the set of its shingles of three words (of all its words where it has fewer). It occurs in a document only
where all of its shingles do, so a prefix of one shingle is necessary and enough to meet it. Shingles are ordered by
rarity, counted over all documents; the prefix is the rarest, and a window of which a shingle occurs nowhere is left
out at once. All shingles of the documents are joined by hash to the prefixes. A hit at word i with a prefix at offset o
of its window puts the window at word i - o: the positional bound asks that it begins within the document, the length
bound that it ends there, and what is left is verified word by word.

Documents are read twice, once to count and once to join, and nothing of a text is shuffled but hits. The windows are a
stated query set: they are broadcast in blocks of bounded bytes, one pass for each block, so a benchmark of any size is held.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

WINDOW, SHINGLE = 10, 3
#: Bytes of windows that are broadcast at once, and what a window takes besides its text.
BLOCK_BYTES, ROW_BYTES = 32 << 20, 200
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "h1", "h2"]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """items (item_id, text) to (window, wanted, len, size, block) and (window, item_id).

    window numbers a distinct list of words (wanted), size is the number of words of its shingles. A null item_id is the empty string.
    """
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(window))
    cut = cut.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("wanted"))
    cut = stage(cut.distinct(), "windows-of-items")
    own = stage(cut.select("wanted").distinct().withColumn("window", F.monotonically_increasing_id()), "windows-numbered")
    held = own.agg(F.sum(F.length(F.array_join("wanted", " ")) + ROW_BYTES)).first()[0] or 0
    blocks = max(1, math.ceil(held / BLOCK_BYTES))
    size = F.size("wanted")
    known = own.select("window", "wanted", size.alias("len"), F.least(size, F.lit(SHINGLE)).alias("size"), F.pmod(F.xxhash64("wanted"), F.lit(blocks)).alias("block"))
    return known, stage(cut.join(own, "wanted").select("window", "item_id"), "windows-items")


def shingles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h1, h2, n_words, w (all words), i, hash of the shingle at word i; a text without words has one row, i null."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"), words(F.col("text")).alias("w"))
    spread = split.select(*KEY, F.size("w").alias("n_words"), "w", F.posexplode_outer("w").alias("i", "first"))
    return spread.select(*KEY, "n_words", "w", "i", F.xxhash64("first", *(F.get("w", F.col("i") + k) for k in range(1, size))).alias("hash"))


def prefixes(docs: DataFrame, known: DataFrame, passes: list[tuple[int, int]]) -> DataFrame:
    """known with o and hash of the rarest shingle of each window; windows that cannot occur are left out."""
    each = []
    for size in sorted({s for s, _ in passes}):
        at = F.posexplode(F.sequence(F.lit(1), F.col("len") - size + 1)).alias("o", "p")
        spread = known.where(F.col("size") == size).select("*", at)
        each.append(spread.select("window", "size", "block", "o", F.xxhash64(*(F.get("wanted", F.col("o") + k) for k in range(size))).alias("hash")))
    offsets = stage(reduce(DataFrame.union, each), "windows-shingles")
    counts = []
    for size, block in passes:
        asked = offsets.where((F.col("size") == size) & (F.col("block") == block)).select("hash").distinct()
        seen = shingles(docs, size).select("hash").join(F.broadcast(asked), "hash").groupBy("hash").agg(F.count("*").alias("seen"))
        counts.append(seen.withColumns({"size": F.lit(size), "block": F.lit(block).cast("bigint")}))
    seen = stage(reduce(DataFrame.union, counts), "windows-rarity")
    rare = offsets.join(seen, ["hash", "size", "block"], "left").groupBy("window").agg(
        F.min_by(F.struct("o", "hash"), F.struct("seen", "o")).alias("x"), F.bool_and(F.col("seen").isNotNull()).alias("can"),
    )
    return stage(known.join(rare.where("can"), "window").select(known["*"], "x.o", "x.hash"), "windows-prefixes")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, n_words, start, len, window, copies) and (window, item_id).

    A row for each distinct place of a window in a text, start the number of its first word; and a row with start null for each
    text. h1 and h2 are digests of the text, copies counts equal rows of docs.
    """
    known, of_items = windows_of(items, window)
    found = {r["size"]: r["blocks"] for r in known.groupBy("size").agg(F.sort_array(F.collect_set("block")).alias("blocks")).collect()}  # three sizes at most
    passes = [(size, block) for size in sorted(found, reverse=True) for block in found[size]] or [(SHINGLE, 0)]
    rare = prefixes(docs, known, passes)
    hits = []
    for k, (size, block) in enumerate(passes):
        asked = rare.where((F.col("size") == size) & (F.col("block") == block)).select("window", "wanted", "len", "o", F.col("hash").alias("prefix"))
        own = shingles(docs, size)
        start = F.col("i") - F.col("o")
        bounds = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
        same = F.slice("w", F.greatest(start + 1, F.lit(1)), F.col("len")) == F.col("wanted")
        met = own.join(F.broadcast(asked), (own.hash == F.col("prefix")) & bounds & same, "left" if k == 0 else "inner")
        hit = met.select(*KEY, "n_words", start.alias("start"), "len", "window", (F.coalesce("i", F.lit(0)) == 0).alias("top"))
        if k == 0:  # the first word of each text also stands for the text itself
            hit = hit.where("top or window is not null")
            both = F.when(F.col("top") & F.col("window").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("window").isNull()))
            hit = hit.withColumn("text", F.explode(both))
            blank = {c: F.when(~F.col("text"), F.col(c)) for c in ("start", "len", "window")}
            hit = hit.withColumns(blank)
        hits.append(hit.select(*KEY, "n_words", "start", "len", "window"))
    rows = reduce(DataFrame.union, hits).groupBy(*KEY, "n_words", "start", "len", "window").agg(F.count("*").alias("copies"))
    return rows, of_items


def audit(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) and items (item_id, text, ...) to doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    One row for every input row, repeated ones and rows without doc_id too. Null and empty texts have no words and no hits; items without
    words have no windows. Several items of one id count once. Other columns are not read. Documents that hold the same windows share
    one list of items, so a passage of many items in many documents is not written out for each document.
    """
    rows, of_items = occurrences(docs, items, window)
    order = Window.partitionBy(*KEY).orderBy("start", "len")
    end = F.col("start") + F.col("len")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start").isNotNull(), F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))).otherwise(0)
    texts = rows.withColumn("new", new).groupBy(*KEY, "n_words").agg(
        F.sum("new").cast("long").alias("n_hit"), F.sort_array(F.collect_set("window")).alias("windows"), F.max(F.when(F.col("start").isNull(), F.col("copies"))).alias("copies"),
    )
    texts = stage(texts.withColumn("set", F.when(F.size("windows") > 0, F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256))), "decontaminate-texts")
    sets = texts.where("set is not null").groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("window"))
    ids = sets.join(of_items, "window").groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    listed = ids.select("set", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("digest"))
    row = ["doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit"]
    rest = [(F.col("n_hit") > 0).alias("contaminated"), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("copy")]
    hit = texts.where("set is not null").join(listed, "set").select(*row, F.col("n").alias("n_items"), F.col("digest").alias("items_sha256"), *rest)
    clean = texts.where("set is null").select(*row, F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), *rest)
    return hit.union(clean).select("*", F.explode("copy").alias("one")).drop("copy", "one")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT id, least(len(w), {WINDOW}) AS n, w[i + 1 : i + least(len(w), {WINDOW})] AS words FROM (SELECT id, w, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT r, s, n, w[s + 1 : s + n] AS words FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT DISTINCT r, s, n, id FROM places JOIN windows USING (n, words)),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
held AS (SELECT r, list_sort(list(DISTINCT id)) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN held USING (r)
"""
