"""Queries on ranked search, things that very many persons hold, one period of all rows, and digests as trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import trees
from ..operators import hot
from ..operators import prediction as pr
from ..operators import search as se
from ..staging import new_folder
from .catalog import query
from .matching_queries import DATASET, dataset
from .views import Views

ASKED = [("q1", "Red bolt"), ("q2", "zinc"), ("q3", "small BLUE zinc gear, gear"), ("q4", "nothing-of-the-kind")]
NAMES = "SELECT product_id, CASE WHEN product_id % 10 = 3 THEN CASE WHEN product_id % 20 = 3 THEN display_name || ' zinc' END ELSE display_name END AS name FROM product"
BM25 = f"""
    named AS ({NAMES}), w AS (SELECT product_id, list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM named),
    sized AS (SELECT product_id, len(w) AS size, w FROM w WHERE len(w) > 0), stat AS (SELECT count(*) AS n, avg(size) AS mean FROM sized),
    post AS (SELECT word, product_id, size, count(*) AS tf FROM (SELECT product_id, size, unnest(w) AS word FROM sized) GROUP BY ALL), freq AS (SELECT word, count(*) AS df FROM post GROUP BY word),
    asked AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(t), '[^a-z]+')) AS word FROM (VALUES {", ".join(f"('{q}', '{t}')" for q, t in ASKED)}) x(query_id, t)),
    scores AS (
      SELECT query_id, product_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
      FROM asked JOIN post USING (word) JOIN freq USING (word), stat GROUP BY ALL)"""


def name_index(v: Views) -> str:
    """Names of all products, and then a batch of changes: a tenth is renamed, half of it to nothing."""
    first, second = new_folder(v.spark, "names"), new_folder(v.spark, "names")
    se.write_index(v.product.select("product_id", "display_name"), "product_id", "display_name", first)
    changed = v.sql(f"SELECT product_id, name FROM ({NAMES.replace('FROM product', 'FROM {product}')}) WHERE product_id % 10 = 3")
    se.update_index(v.spark, first, changed, "product_id", "name", second)
    return second


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS place FROM scores) SELECT query_id, product_id, place, round(score, 6) AS score FROM r WHERE place <= 10")
def ranked_name_search(v: Views):
    """The ten best names of each query by BM25, after a batch of changes to the index."""
    return se.search(v.spark, name_index(v), ASKED).select("query_id", F.col("key").alias("product_id"), "place", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT query_id, product_id, round(score, 6) AS score FROM scores")
def name_scores(v: Views):
    """All names that share a word with a query."""
    return se.search(v.spark, name_index(v), ASKED, None).select("query_id", F.col("key").alias("product_id"), F.round("score", 6).alias("score"))


HELD = "held AS (SELECT DISTINCT person_id, identifier_type, normalized_value FROM crowded_identifier WHERE coalesce(is_active, true))"
THING = ["identifier_type", "normalized_value"]


@query(f"""
    WITH {HELD} SELECT a.person_id, count(DISTINCT b.person_id) AS others FROM held a JOIN held b USING (identifier_type, normalized_value) JOIN person p ON p.person_id = b.person_id AND p.status <> 'merged'
    WHERE a.person_id <> b.person_id GROUP BY a.person_id""")
def crowded_counts(v: Views):
    """With how many others each person shares an identifier, where a fifth of all share one; no pair of two of these is made."""
    return hot.others_counted(v.crowded_identifier, THING, v.person, limit=40)


@query(f"""
    WITH {HELD}, sizes AS (SELECT identifier_type, normalized_value, count(*) AS size FROM held GROUP BY ALL)
    SELECT h.person_id, CAST(NULL AS BIGINT) AS other_id, identifier_type, normalized_value, size FROM held h JOIN sizes USING (identifier_type, normalized_value) WHERE size > 40
    UNION ALL SELECT a.person_id, b.person_id, identifier_type, normalized_value, NULL FROM held a JOIN held b USING (identifier_type, normalized_value) JOIN sizes USING (identifier_type, normalized_value)
      JOIN person p ON p.person_id = b.person_id AND p.status <> 'merged' WHERE a.person_id <> b.person_id AND size <= 40""")
def crowded_sharing(v: Views):
    """Pairs for what few hold, and one row a membership, with the size, for what many hold."""
    pairs, classes = hot.sharing(v.crowded_identifier, THING, v.person, limit=40)
    rows = pairs.select("person_id", "other_id", *THING, F.lit(None).cast("long").alias("size"))
    return rows.union(classes.select("person_id", F.lit(None).cast("long"), *THING, "size"))


@query(f"""
    WITH {DATASET}, r AS (
      SELECT *, row_number() OVER (ORDER BY p DESC, row_id) AS k, sum(label) OVER (ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER () AS n, sum(label) OVER () AS pos FROM ds),
    a AS (
      SELECT 1 AS period, count(*) AS test_count, CAST(sum(label) AS BIGINT) AS positive_count, sum(CASE WHEN k <= greatest(1, ceil(0.1 * n)) THEN label ELSE 0 END) / max(greatest(1, ceil(0.1 * n))) AS pc,
        coalesce(sum(CASE WHEN label = 1 THEN tp / k END) / max(pos), 0) AS pr_auc FROM r)
    SELECT period, test_count, positive_count, round(pc, 6) AS precision_at_capacity, round(pr_auc, 6) AS pr_auc FROM a""")
def one_period_metrics(v: Views):
    """Ranks and the sweep over precision and recall where one period holds all rows: ranges of scores are ranked apart and add up."""
    rows = dataset(v).select("row_id", F.lit(1).alias("period"), "label", "p")
    out = pr.binary_metrics(rows, ["period"])
    return out.select("period", "test_count", "positive_count", *(F.round(n, 6).alias(n) for n in ("precision_at_capacity", "pr_auc")))


def changed_documents(v: Views):
    return v.sql("SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 89 = 7 THEN NULL ELSE lang END AS lang FROM {documents} WHERE doc_id % 101 <> 9 UNION ALL SELECT -1 - doc_id, text, lang FROM {documents} WHERE doc_id % 83 = 2")


@query("""
    SELECT doc_id, CASE WHEN doc_id < 0 THEN 'only_right' WHEN doc_id % 101 = 9 THEN 'only_left' ELSE 'changed' END AS what
    FROM (SELECT doc_id, text, lang FROM documents UNION ALL SELECT -1 - doc_id, NULL, NULL FROM documents WHERE doc_id % 83 = 2)
    WHERE doc_id < 0 OR doc_id % 101 = 9 OR (doc_id % 97 = 5 AND text IS NOT NULL) OR (doc_id % 89 = 7 AND lang IS NOT NULL)""")
def tree_differences(v: Views):
    """Which documents differ between two passes, found by descent in two digest trees."""
    return trees.differences(v.documents, changed_documents(v), ["doc_id"], ["text", "lang"], depth=2)


@query("""
    WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN text || '!' ELSE text END AS text FROM documents)
    SELECT 'again' AS pass, count(*)::BIGINT AS rows, (SELECT count(*) = 0 FROM (SELECT doc_id, text FROM documents EXCEPT ALL SELECT doc_id, text FROM documents)) AS equal FROM documents
    UNION ALL SELECT 'changed', (SELECT count(*) FROM changed), (SELECT count(*) = 0 FROM (SELECT doc_id, text FROM documents EXCEPT ALL SELECT doc_id, text FROM changed))
    UNION ALL SELECT 'doubled', (SELECT count(*) * 2 FROM documents), (SELECT count(*) = 0 FROM documents)""")
def tree_roots(v: Views):
    """Roots of passes against the first: the same rows in another order, a pass with changes, and one that holds every row twice."""
    rows = v.documents.select("doc_id", "text")
    changed = rows.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    passes = {"again": rows.repartition(7, "text"), "changed": changed, "doubled": rows.union(rows)}
    first = trees.root(rows, ["doc_id"], ["text"], 2).select(F.col("digest").alias("want"))
    out = None
    for name, frame in passes.items():
        one = trees.root(frame, ["doc_id"], ["text"], 2).withColumn("pass", F.lit(name))
        out = one if out is None else out.union(one)
    return out.join(F.broadcast(first)).select("pass", "rows", (F.col("digest") == F.col("want")).alias("equal"))  # one row
