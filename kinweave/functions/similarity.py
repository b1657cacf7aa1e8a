"""Similarity of names and near misses of identifiers.

Jaro has no built-in function, so it is an Arrow-batched UDF; its matching order is greedy from the left and the prefix bonus is
given at any similarity, which differs from the textbook form. Edit distance one is written with built-in functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Domains that anchor the domain axis of near misses.
KNOWN_DOMAINS = ["gmail.com", "hotmail.com", "hotmail.sg", "yahoo.com", "yahoo.com.sg", "outlook.com", "icloud.com", "live.com"]
LOCAL_SIMILAR, LOCAL_LEAST = 0.90, 4


def jaro_of(a: str, b: str) -> float:
    """1 for equal strings, 0 if one alone is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, order = list(b), []
    for i, ch in enumerate(a):
        at = next((j for j in range(max(i - reach, 0), min(i + reach + 1, len(b))) if free[j] == ch), None)
        if at is not None:
            free[at] = None
            order.append(ch)
    if not order:
        return 0.0
    taken = [b[j] for j, ch in enumerate(free) if ch is None]
    swapped = sum(x != y for x, y in zip(order, taken, strict=True)) / 2
    m = len(order)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str, weight: float = 0.1) -> float:
    a, b = a.lower().strip(), b.lower().strip()
    base, common = jaro_of(a, b), 0
    while common < min(len(a), len(b), 4) and a[common] == b[common]:
        common += 1
    return base + common * weight * (1 - base)


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best pair of two lists of names; null where a side has none."""
    return pd.Series([max(jaro_winkler_of(x, y) for x in p for y in q) if p is not None and q is not None and len(p) and len(q) else None for p, q in zip(a, b, strict=True)], dtype="float64")


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    n = F.length(a)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((n == F.length(b)) & (n >= 2) & (F.levenshtein(a, b) == 2) & swap))


def region_of(e164: Column) -> Column:
    """The calling prefix of an E.164 number as far as it is known here; null for numbers without a country."""
    known = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "852", "853", "855", "856", "880", "886"]
    prefix = lambda n: F.substring(e164, 2, n)
    return F.when(~e164.startswith("+"), None).when(prefix(3).isin(*known), prefix(3)).when(prefix(2).isin(*known), prefix(2)).when(prefix(1).isin("1", "7"), prefix(1))


def phone_near_match(a: Column, b: Column) -> Column:
    """Same country and one edit in the national number."""
    own = lambda x: F.substring(x, F.length(region_of(x)) + 2, F.lit(32))
    return F.coalesce((region_of(a) == region_of(b)) & one_edit_apart(own(a), own(b)), F.lit(False))


def email_near_match(a: Column, b: Column, similar: Column | None = None) -> Column:
    """One fuzzy axis: equal local parts with domains one edit apart, one of them known; or equal domains with like local parts.

    similar replaces the similarity of the local parts, for plans that must stay without Python.
    """
    cut = r"^(.+)@([^@]+)$"
    la, da, lb, db = (F.regexp_extract(x, cut, k) for x in (a, b) for k in (1, 2))
    whole = (la != "") & (lb != "")
    domains = (la == lb) & (da != db) & (da.isin(*KNOWN_DOMAINS) | db.isin(*KNOWN_DOMAINS)) & one_edit_apart(da, db)
    long_enough = (F.length(la) >= LOCAL_LEAST) & (F.length(lb) >= LOCAL_LEAST)
    locals_ = (da == db) & (la != lb) & long_enough & ((similar if similar is not None else jaro_winkler(la, lb)) >= LOCAL_SIMILAR)
    return F.coalesce(whole & (domains | locals_), F.lit(False))
