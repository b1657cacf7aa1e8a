"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

A vector of transformed statistics is made for each text. For each group of language and source, for each language and for
all texts, the minimum covariance determinant estimate is sought by concentration steps: the half of the rows nearest by
Mahalanobis distance gives the next mean and covariance, which never raises the determinant, until it stops falling. Each
group starts from three robust estimates and keeps the result with the smallest determinant; up to nearly half of a
group may be outliers. A group's estimate is drawn towards that of its language, and this towards that of all, by their numbers
of rows. Every step is an aggregation over all rows of the groups, so groups of any size are estimated whole. Texts too
far from the estimate are rejected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Scope
from .common import has_rows, map_batches, stage, table

#: What a coordinate may vary at least, as a standard deviation; keeps the covariance regular where all rows are equal.
FEATURES = {"x_length": 0.08, "x_symbols": 0.05, "x_punct": 0.06, "x_upper": 0.06, "x_lines": 0.12, "x_repeat": 0.12}
SHARE = 0.5
#: Quantile SHARE of the chi-squared distribution with as many degrees of freedom as features.
CHI2_SHARE = 5.3481
#: What brings the covariance of the nearest rows to that of all: SHARE over the chi-squared distribution, with two degrees more, at CHI2_SHARE.
CONSISTENCY = 1.7845
#: Concentration stops when no determinant falls by more than this share, or after so many steps.
FALL, STEPS = 0.01, 15
#: Rows that the estimate of the wider group counts for.
PRIOR = 40
#: Quantile 0.999 of the chi-squared distribution with as many degrees of freedom as features.
CUTOFF = 22.458
#: Rows of groups, under a kilobyte each, that are broadcast; beyond, Spark joins them by key and splits hot groups.
BROADCAST_ROWS = 8000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)  # 1 punctuation, 2 upper case, 0 the rest
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_KIND[65:91] = 2


def statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the values of FEATURES)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    doubled = len(lines) - len(set(lines))
    repeats = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen, twice = set(), set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            last = 0  # words before this one are counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeats += i + 3 - max(i, last)
                    last = i + 3
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=3)
    some, size = max(n, 1), max(chars, 1)
    vector = (np.log1p(chars / some), np.sqrt(symbols / some), np.sqrt(kinds[1] / size), np.sqrt(kinds[2] / size), doubled / max(len(lines), 1), repeats / some)
    return (n, chars, symbols, doubled, repeats, *map(float, vector))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the columns of keep and the statistics of every row."""
    read = docs.select("doc_id", "text", "lang", "source", *keep)

    def each(batch: pa.RecordBatch) -> dict:
        rows = list(zip(*map(statistics, batch.column(1).to_pylist()), strict=True)) or [[]] * (len(COLUMNS) + len(FEATURES))
        return dict(zip(("doc_id", "text", "lang", "source", *keep), batch.columns, strict=True)) | dict(zip([*COLUMNS, *FEATURES], rows, strict=True))

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "text"] + [f"{c} long" for c in COLUMNS] + [f"{c} double" for c in FEATURES])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return map_batches(read, each, ddl).withColumn("base_failed", failed)


def distance(mean: str, inverse: str) -> Column:
    """Squared Mahalanobis distance from array columns: a mean, and an inverse covariance row by row."""
    gap = [F.col(x) - F.col(mean)[i] for i, x in enumerate(FEATURES)]
    p = len(gap)
    return sum((gap[i] * gap[j] * F.col(inverse)[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


P = len(FEATURES)
LEAST = np.diag(np.square(list(FEATURES.values())))
ESTIMATE = "mean array<double>, cov array<double>, inverse array<double>, determinant double"


def moments(values: list[Column]) -> list[Column]:
    """Sums and products of columns, for matrix()."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(values)]
    return [F.count("*").alias("n"), *sums, *(F.sum(a * b).alias(f"q{i}_{j}") for i, a in enumerate(values) for j, b in enumerate(values) if i <= j)]


def matrix(row: dict, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([row[f"s{i}"] for i in range(P)]) / row["n"]
    cov = np.array([[row[f"q{min(i, j)}_{max(i, j)}"] for j in range(P)] for i in range(P)]) / row["n"]
    return mean, cov - np.outer(mean, mean) if centred else cov


def estimate(key: dict, mean: np.ndarray, cov: np.ndarray) -> dict:
    return key | {"mean": mean.tolist(), "cov": cov.ravel().tolist(), "inverse": np.linalg.inv(cov).ravel().tolist(), "determinant": float(np.linalg.det(cov))}


def per_row(rows: DataFrame, each, key: str, schema: str = ESTIMATE) -> DataFrame:
    """each(row as a dict) gives a list of rows; for small tables of groups."""

    def batch(own: pa.RecordBatch) -> dict:
        made = [x for row in own.to_pylist() for x in each(row)]
        return {c: [x[c] for x in made] for c in (f.split()[0] for f in f"{key}, {schema}".split(", "))}

    return map_batches(rows, batch, f"{key}, {schema}")


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows with the row of their group; one group may have most of the rows, so they stay where they are while the groups are few."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, key, how)


def starts(rows: DataFrame) -> DataFrame:
    """Three robust starts for each group (grp): medians with median deviations, then these with the correlation of the rows'
    hyperbolic tangents, then with that of their directions."""
    names = list(FEATURES)
    centre = rows.groupBy("grp").agg(*(F.percentile_approx(c, 0.5, 2000).alias(f"m_{c}") for c in names))
    centre = stage(centre, "quality-medians")
    spread = with_groups(rows, centre, ["grp"]).groupBy("grp").agg(*(F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 2000).alias(f"d_{c}") for c in names))
    own = stage(centre.join(spread, "grp"), "quality-spread")
    z = [(F.col(c) - F.col(f"m_{c}")) / F.sqrt(F.pow(1.4826 * F.col(f"d_{c}"), 2) + FEATURES[c] ** 2) for c in names]
    size = F.sqrt(sum((x * x for x in z), F.lit(1e-12)))
    shape = [*moments([F.tanh(x) for x in z]), *(F.sum(z[i] * z[j] / (size * size)).alias(f"u{i}_{j}") for i in range(P) for j in range(i, P))]
    shapes = own.join(with_groups(rows, own, ["grp"]).groupBy("grp").agg(*shape), "grp")

    def each(row: dict) -> list[dict]:
        mean = np.array([row[f"m_{c}"] for c in names])
        scale = np.array([np.hypot(1.4826 * row[f"d_{c}"], FEATURES[c]) for c in names])
        directions = np.array([[row[f"u{min(i, j)}_{max(i, j)}"] for j in range(P)] for i in range(P)])
        out = []
        for k, kind in enumerate((np.eye(P), matrix(row)[1], directions)):
            deviation = np.sqrt(np.diag(kind) + 1e-6)
            correlation = (kind + 1e-6 * np.eye(P)) / np.outer(deviation, deviation)
            out.append(estimate({"grp": row["grp"], "start": k}, mean, correlation * np.outer(scale, scale)))
        return out

    return stage(per_row(shapes, each, "grp string, start int"), "quality-starts")


def concentrated(rows: DataFrame) -> DataFrame:
    """rows (grp, FEATURES) to one row per group: grp, mean, cov, inverse, determinant of the half with the smallest determinant found."""
    now, names = starts(rows), list(FEATURES)

    def each(row: dict) -> list[dict]:
        mean, cov = matrix(row)
        return [estimate({"grp": row["grp"], "start": row["start"]}, mean, CONSISTENCY * cov + LEAST)]

    with Scope(rows.sparkSession) as steps:
        for k in range(STEPS):
            far = with_groups(rows, now, ["grp"]).select("grp", "start", *names, distance("mean", "inverse").alias("d"))
            limit = stage(far.groupBy("grp", "start").agg(F.percentile_approx("d", SHARE, 2000).alias("limit")), "quality-limit")
            near = with_groups(far, limit, ["grp", "start"]).where("d <= limit")
            after = stage(per_row(near.groupBy("grp", "start").agg(*moments([F.col(c) for c in names])), each, "grp string, start int"), "quality-step")
            before, now = now.select("grp", "start", F.col("determinant").alias("was")), after
            if k and not has_rows(after.join(before, ["grp", "start"]).where(F.col("determinant") < (1 - FALL) * F.col("was"))):
                break
            steps.drop(keep=1)
    return now.groupBy("grp").agg(F.min_by(F.struct("mean", "cov"), F.struct("determinant", "start")).alias("e")).select("grp", "e.*")


def estimates(rows: DataFrame) -> DataFrame:
    """rows (lang, source, FEATURES) to one row per language and source: mean, inverse, scale.

    scale brings the distance at quantile SHARE to that of normal data, where it is larger.
    """
    names = list(FEATURES)
    grp = {"own": F.concat_ws("\1", F.lit("0"), "lang", "source"), "lang": F.concat_ws("\1", F.lit("1"), "lang"), "all": F.lit("2")}
    found = stage(concentrated(rows.select(F.explode(F.array(*grp.values())).alias("grp"), *names)), "quality-concentrated")
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n_own"))
    groups = groups.join(groups.groupBy("lang").agg(F.sum("n_own").alias("n_lang")), "lang")
    levels = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), key.alias("grp")) for level, key in grp.items()))).alias("x")
    links = stage(groups.select("*", levels).select("lang", "source", "n_own", "n_lang", "x.*"), "quality-levels")
    met = with_groups(links, found, ["grp"]).groupBy("lang", "source", "n_own", "n_lang").agg(F.collect_list(F.struct("level", "mean", "cov")).alias("levels"))

    def each(row: dict) -> list[dict]:
        own = {x["level"]: (np.array(x["mean"]), np.array(x["cov"])) for x in row["levels"]}
        mean, cov = own["all"]
        for level in ("lang", "own"):
            share = row[f"n_{level}"] / (row[f"n_{level}"] + PRIOR)
            mean, cov = (share * x + (1 - share) * y for x, y in zip(own[level], (mean, cov), strict=True))
        return [estimate({"lang": row["lang"], "source": row["source"], "n": row["n_own"]}, mean, cov.reshape(P, P))]

    drawn = stage(per_row(met, each, "lang string, source string, n long"), "quality-drawn")
    far = with_groups(rows, drawn, ["lang", "source"]).groupBy("lang", "source", "n").agg(F.percentile_approx(distance("mean", "inverse"), SHARE, 2000).alias("middle"))
    scale = F.pow(F.greatest(F.lit(1.0), F.col("middle") / CHI2_SHARE), F.col("n") / (F.col("n") + PRIOR))
    return stage(drawn.join(far.select("lang", "source", scale.alias("scale")), ["lang", "source"]).select("lang", "source", "mean", "inverse", "scale"), "quality-estimates")


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) to doc_id, COLUMNS, base_failed, distance, kept; one row per input row.

    Null texts are empty and fail the limits, as short texts do. A null language or source is a value of its own. Texts that the
    limits reject take no part in the estimates. Repeated rows count each. keep: more columns to pass on; others are not read.
    An empty table gives no rows.
    """
    stats = with_statistics(docs, keep).withColumns({"lang": F.coalesce("lang", F.lit("\0")), "source": F.coalesce("source", F.lit("\0"))})
    stats = stage(stats, "quality-statistics")
    found = estimates(stats.where("not base_failed").select("lang", "source", *FEATURES))
    far = with_groups(stats, found, ["lang", "source"], "left").withColumn("distance", distance("mean", "inverse") / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return far.withColumn("kept", kept).select("doc_id", *COLUMNS, "base_failed", "distance", "kept", *keep)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns.

    A verdict belongs to a text with its language and source: rows are told apart by doc_id and digests of these, so rows of one
    doc_id, null included, are judged each. Repeated rows share their verdict.
    """
    digests = ("h1 of text", "h2 of text")
    marked = docs.withColumns(dict(zip(digests, (F.xxhash64("text", "lang", "source", F.col("lang").isNull(), F.col("source").isNull()), F.crc32(F.col("text").cast("binary"))), strict=True)))
    key = ["doc_id", *digests]
    bad = stage(judge(marked, digests).where("not kept").select(*key).distinct(), "quality-rejected")
    same = reduce(lambda x, y: x & y, (marked[c].eqNullSafe(bad[c]) for c in key))
    return marked.join(bad, same, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COLUMNS, "base_failed", "kept")
