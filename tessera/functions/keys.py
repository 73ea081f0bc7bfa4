"""Blocking keys of a record: words, skeletons, skeleton pairs, glued openings, address words and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.normalize import skeleton

MOST_SKELETONS = 6


def skeletons(name: Column) -> Column:
    """Distinct skeletons of the first tokens, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.slice(name, 1, MOST_SKELETONS), skeleton), lambda s: s != "")))


def record_keys(name: Column, skels: Column, address: Column) -> Column:
    """Distinct keys of name tokens, their skeletons (as skeletons() gives them) and address tokens."""
    marked = lambda mark, a: F.transform(a, lambda t: F.concat(F.lit(mark), t))
    n = F.size(skels)
    rest = lambda i: F.slice(skels, i + 2, n)
    pairs = F.flatten(F.transform(skels, lambda a, i: F.transform(rest(i), lambda b: F.concat(F.lit("p:"), a, F.lit("_"), b))))
    heads = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: i <= F.size(name))
    glued = F.transform(heads, lambda i: F.concat(F.lit("c:"), F.array_join(F.slice(name, F.lit(1), i), "")))
    m = F.greatest(F.size(address) - 1, F.lit(0))
    neighbours = F.zip_with(F.slice(address, F.lit(1), m), F.slice(address, F.lit(2), m), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    return F.array_distinct(F.concat(marked("n:", name), marked("k:", skels), pairs, glued, marked("a:", address), neighbours))
