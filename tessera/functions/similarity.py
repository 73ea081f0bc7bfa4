"""String similarities as column expressions; Jaro-Winkler as an Arrow UDF."""

from __future__ import annotations

from bisect import bisect_left
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """(len a + len b - edits) / (len a + len b); 1 for equal strings, 0 if one is empty."""
    both = F.length(a) + F.length(b)
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise((both - F.levenshtein(a, b)) / both)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once and standing once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda t: t != "")


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def token_sort(a: Column, b: Column) -> Column:
    ordered = lambda s: F.array_join(F.array_sort(_tokens(s)), " ")
    return let(_pair(ordered(a), ordered(b)), lambda p: ratio(p["a"], p["b"]))


def token_set(a: Column, b: Column) -> Column:
    """The best ratio among shared tokens and shared tokens with either side's rest."""
    text = lambda x: F.array_join(F.array_sort(x), " ")

    def of_tokens(t: Column) -> Column:
        return F.struct(text(F.array_intersect(t["a"], t["b"])).alias("s"), text(F.array_except(t["a"], t["b"])).alias("a"), text(F.array_except(t["b"], t["a"])).alias("b"))

    def whole(w: Column) -> Column:
        return F.struct(w["s"].alias("s"), F.trim(F.concat_ws(" ", w["s"], w["a"])).alias("a"), F.trim(F.concat_ws(" ", w["s"], w["b"])).alias("b"))

    def best(w: Column) -> Column:
        rests = ratio(w["a"], w["b"])
        return F.when(w["s"] == "", rests).otherwise(F.greatest(ratio(w["s"], w["a"]), ratio(w["s"], w["b"]), rests))

    return let(let(let(_pair(_tokens(a), _tokens(b)), of_tokens), whole), best)


def partial(a: Column, b: Column) -> Column:
    """The best ratio of the shorter string and a window of the longer; the first that reaches 0.99 counts."""
    a_first = F.length(a) <= F.length(b)

    def windows(p: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(p["b"]) - F.length(p["a"]) + 1)
        return F.transform(places, lambda i: ratio(p["a"], F.substring(p["b"], i, F.length(p["a"]))))

    first_or_best = lambda r: F.coalesce(F.get(F.filter(r, lambda x: x >= 0.99), F.lit(0)), F.array_max(r))
    best = let(let(_pair(F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a)), windows), first_or_best)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(best)


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler with half transpositions counted as they are and the prefix bonus always given."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free: dict[str, list[int]] = {}
    for j, ch in enumerate(b):
        free.setdefault(ch, []).append(j)
    matched = []  # (place in a, place in b)
    for i, ch in enumerate(a):
        at = free.get(ch, [])
        k = bisect_left(at, i - reach)
        if k < len(at) and at[k] <= i + reach:
            matched.append((i, at.pop(k)))
    if not matched:
        return 0.0
    n = len(matched)
    crossed = sum(a[i] != b[j] for (i, _), j in zip(matched, sorted(j for _, j in matched)))
    jaro = (n / len(a) + n / len(b) + (n - crossed / 2) / n) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


def _jaro_winkler_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a, b))
    of = {p: jaro_winkler_of(*p) for p in set(pairs)}  # a name meets many candidates of the same name
    return pd.Series([of[p] for p in pairs], dtype="float64")


@cache
def _jaro_winkler_udf():
    return F.pandas_udf(_jaro_winkler_batch, "double")  # made on the driver only; workers import this module too


def jaro_winkler(a: Column, b: Column) -> Column:
    return _jaro_winkler_udf()(a, b)


def no_space(a: Column, b: Column) -> Column:
    return ratio(F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit("")))
