"""Intervals of any metric by a block bootstrap: metrics are sums by block, and blocks are drawn with replacement.

A metric is a protocol of two parts. Its state is a set of numbered sums that Spark makes for each block, a month as a rule, so
states of blocks add up to the state of any draw. Its value is worked out from the sums of a draw alone. Curves come from
histograms over the score, whose bins are such sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 100


@dataclass(frozen=True)
class Metric:
    """name; parts: columns (slot, amount) of a scored row; slots: how many sums; value: sums (draws, slots) to one value a draw."""

    name: str
    parts: tuple[tuple[Column, Column], ...]
    slots: int
    value: Callable[[np.ndarray], np.ndarray]


def brier() -> Metric:
    """The mean squared difference of p and label."""
    return Metric("brier", ((F.lit(0), F.pow(F.col("p") - F.col("label"), 2)), (F.lit(1), F.lit(1.0))), 2, lambda s: s[:, 0] / np.maximum(s[:, 1], 1))


def _bin(bins: int) -> Column:
    """Bins from the highest scores to the lowest."""
    return (bins - 1 - F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))).cast("int")


def _curves(sums: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    return sums[:, :bins], sums[:, bins:]


def pr_auc(bins: int = BINS) -> Metric:
    """The area under precision and recall: each bin's positives at the precision that holds at its end; 0 without positives."""

    def value(sums: np.ndarray) -> np.ndarray:
        positives, rows = _curves(sums, bins)
        precision = positives.cumsum(1) / np.maximum(rows.cumsum(1), 1)
        return (positives * precision).sum(1) / np.maximum(positives.sum(1), 1)

    return Metric("pr_auc", ((_bin(bins), F.col("label").cast("double")), (_bin(bins) + bins, F.lit(1.0))), 2 * bins, value)


def lift(share: float = 0.10, bins: int = BINS) -> Metric:
    """Precision among the best share of rows over that of all; of the bin in which they end, a share of its positives; 0 without positives."""

    def value(sums: np.ndarray) -> np.ndarray:
        positives, rows = _curves(sums, bins)
        n, pos = rows.sum(1), positives.sum(1)
        cap = np.maximum(1, np.ceil(share * n))
        before = rows.cumsum(1) - rows
        taken = np.clip(cap[:, None] - before, 0, rows)
        hits = (positives * taken / np.maximum(rows, 1)).sum(1)
        return np.where(pos > 0, hits / cap * n / np.maximum(pos, 1), 0.0)

    return Metric("lift", ((_bin(bins), F.col("label").cast("double")), (_bin(bins) + bins, F.lit(1.0))), 2 * bins, value)


def states(scores: DataFrame, metrics: list[Metric], block: str) -> DataFrame:
    """(block, metric, slot, amount): the sums of every block."""
    each = [F.struct(F.lit(m.name).alias("metric"), slot.cast("int").alias("slot"), amount.cast("double").alias("amount")) for m in metrics for slot, amount in m.parts]
    spread = scores.select(F.col(block).cast("string").alias("block"), F.explode(F.array(*each)).alias("x"))
    return spread.groupBy("block", "x.metric", "x.slot").agg(F.sum("x.amount").alias("amount"))


def intervals(scores: DataFrame, metrics: list[Metric], resamples: int = 1000, seed: int = 42, block: str = "bucket") -> DataFrame:
    """scores (p, label, block) to one row a metric: metric, point, mean, lower, upper (2.5 % and 97.5 %).

    All metrics see the same draws. A task holds one metric: blocks x slots numbers. No rows give no result.
    """
    by_name = {m.name: (m.slots, m.value) for m in metrics}  # what tasks need of a metric; its columns stay here

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        slots, value = by_name[key[0]]
        blocks = sorted(rows["block"].fillna("").unique())
        sums = np.zeros((len(blocks), slots))
        sums[np.searchsorted(blocks, rows["block"].fillna("")), rows["slot"]] = rows["amount"]
        picks = np.random.default_rng(seed).integers(0, len(blocks), (resamples, len(blocks)))
        times = np.zeros((resamples, len(blocks)))
        np.add.at(times, (np.arange(resamples)[:, None], picks), 1)
        values = np.sort(value(times @ sums))
        point = value(sums.sum(0, keepdims=True))[0]
        return pd.DataFrame({"metric": [key[0]], "point": [point], "mean": [values.mean()], "lower": [values[int(0.025 * resamples)]], "upper": [values[int(0.975 * resamples)]]})

    return states(scores, metrics, block).groupBy("metric").applyInPandas(draw, "metric string, point double, mean double, lower double, upper double")
