"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are quantised to integers and held dimension by dimension. For a query,
scores accumulate over blocks of dimensions; after each block a candidate's
final score can still move by at most the product of the norms of what is left
of query and candidate (Cauchy-Schwarz). Candidates whose best case is below the
query's threshold are dropped and the survivors compacted, so later blocks touch
few rows. The last block leaves exact scores.

Queries (a stated set, every QUERY_EVERY-th id, repeats asked once) are cut into
blocks of QUERY_BLOCK, candidates into chunks by descending norm. Two steps:

1. every block meets one chunk of the longest vectors; the k-th best score there
   is a query's threshold, which no row of the result can be below;
2. a query meets another chunk only if its norm times the chunk's largest norm
   reaches its threshold; a candidate is sent to a block only if its norm is as
   large as some query of the block needs. The search starts from the threshold.

A cell of that grid is one bounded task and returns at most k rows for each of
its queries; a window over those picks the final k. Blocks and chunks are as
large as a worker's memory bears, since a candidate is sent once for each block
that its chunk meets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

QUERY_EVERY = 50
TOP = 5
SCALE = 256
BLOCK_DIMS = 8
QUERY_BLOCK = 8192
CHUNK = 16384
#: Norms are told apart by so many quantiles at most; what is larger than a chunk within one is dealt by hash.
LEVELS = 1024
#: Rows that are searched at once.
PART = 8192
#: Sums of products of integers are exact in float64 below this.
EXACT = float(1 << 52)


def _scores(queries: np.ndarray, chunk: np.ndarray, own: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query row, chunk row, score) of the k best rows of chunk for each query, if not below least[i]; own[i]: the id to leave out."""
    dims = chunk.shape[1]
    starts = list(range(0, dims, BLOCK_DIMS))
    columns = np.ascontiguousarray(chunk.T)  # a dimension is contiguous
    rest_c = np.zeros((len(starts) + 1, len(chunk)))
    rest_q = np.zeros((len(starts) + 1, len(queries)))
    for n in reversed(range(len(starts))):
        part = slice(starts[n], starts[n] + BLOCK_DIMS)
        rest_c[n] = rest_c[n + 1] + (columns[part] ** 2).sum(0)
        rest_q[n] = rest_q[n + 1] + (queries[:, part] ** 2).sum(1)
    rest_c, rest_q = np.sqrt(rest_c) * (1 + 1e-9), np.sqrt(rest_q) * (1 + 1e-9)
    reach = rest_c[0].max(initial=0)
    found = []
    for i, query in enumerate(queries):
        if reach * rest_q[0][i] + 1e-6 < least[i]:
            continue
        able = ids != own[i]
        if np.isfinite(least[i]):
            able &= rest_c[0] * rest_q[0][i] + 1e-6 >= least[i]
        alive = np.flatnonzero(able)
        partial = np.zeros(len(alive))
        for n, at in enumerate(starts):
            if not len(alive):
                break
            part = slice(at, at + BLOCK_DIMS)
            partial = partial + query[part] @ (columns[part] if len(alive) == len(chunk) else np.take(columns[part], alive, axis=1))
            if n + 1 < len(starts):
                slack = rest_c[n + 1][alive] * rest_q[n + 1][i] + 1e-6
                worst = least[i]
                if len(alive) > k:
                    worst = max(worst, np.partition(partial - slack, len(alive) - k)[len(alive) - k])
                stays = partial + slack >= worst
                if stays.sum() < 0.8 * len(alive):
                    alive, partial = alive[stays], partial[stays]
        best = np.lexsort((ids[alive], -partial))[:k]
        found += [(i, int(alive[b]), int(partial[b])) for b in best if partial[b] >= least[i]]
    return found


def _cell(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            queries, chunk = np.array(left["v"].tolist(), float), np.array(right["v"].tolist(), float)
            asked, own = left["q"].to_numpy("int64"), left["query_id"].to_numpy("int64")
            least = left["least"].astype("float64").fillna(-np.inf).to_numpy()
            for c in range(0, len(chunk), PART):
                ids, part = right["vec_id"].to_numpy("int64")[c : c + PART], chunk[c : c + PART]
                if max(np.abs(queries).max(initial=0), 1) * max(np.abs(part).max(initial=0), 1) * part.shape[1] < EXACT:
                    rows += [(int(asked[i]), int(ids[j]), s) for i, j, s in _scores(queries, part, own, ids, least, k)]
                else:  # too large for float64: whole integers, no bound
                    whole = np.vectorize(int, otypes=[object])
                    for i, query in enumerate(whole(queries)):
                        scores = whole(part) @ query
                        order = sorted((j for j in range(len(ids)) if ids[j] != own[i]), key=lambda j: (-scores[j], ids[j]))[:k]
                        rows += [(int(asked[i]), int(ids[j]), int(scores[j]) if abs(scores[j]) < 1 << 63 else None) for j in order]
        return pd.DataFrame(rows, columns=["q", "vec_id", "score"], dtype="object").astype({"q": "int64", "vec_id": "int64", "score": "Int64"})

    return run


def top_k(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Vectors that are null, empty, or hold a null or non-finite component take no
    part. Rows without an id are no candidates either, as they can't be named.
    A query is compared with vectors of its own length. Candidates that repeat
    an id are candidates of their own; a query skips every row of its own id.
    Rows that repeat a query, id and vector, ask once; rows that share an id but
    not the vector are queries of their own, each with ranks from 1. Products
    must fit a long. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    usable = F.size(vector_col) > 0
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(vector_col).isNotNull() & usable & F.col(id_col).isNotNull()).filter(~bad)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(vector_col).alias("dims"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)) * (1 + 1e-9)
    rows, _ = common.materialize(rows.withColumn("norm", norm))
    n_rows = rows.count()
    levels = min(LEVELS, max(1, -(-n_rows // CHUNK)))
    cuts = rows.approxQuantile("norm", [1 - i / levels for i in range(1, levels)], 0.1 / levels) if levels > 1 else []
    rank = F.array_position(F.transform(F.lit([*cuts, -1.0]).cast("array<double>"), lambda c: F.col("norm") >= c), True) - 1
    levelled = rows.withColumn("level", rank.cast("int"))
    sizes = levelled.groupBy("dims", "level").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()  # LEVELS rows for each length
    first = {r["dims"]: min(o["level"] for o in sizes if o["dims"] == r["dims"]) for r in sizes}
    listed = [(r["dims"], r["level"], max(1, round(r["n"] / CHUNK)), r["top"], r["level"] == first[r["dims"]]) for r in sizes]
    grid = F.broadcast(spark.createDataFrame(listed, "dims int, level int, parts int, top double, longest boolean"))
    chunked = levelled.join(grid, ["dims", "level"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    opens = F.col("longest") & (F.col("part") == 0)

    asked = rows.filter(F.col("vec_id") % every == 0).select("dims", F.col("vec_id").alias("query_id"), "v", "norm").distinct()
    asked, _ = common.materialize(asked.withColumn("q", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks).cast("long")))
    cell = ["dims", "block", "level", "part"]

    def meet(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        asks, offers = queries.select(*cell, "q", "query_id", "v", "least"), candidates.select(*cell, "vec_id", "v")
        return asks.groupBy(*cell).cogroup(offers.groupBy(*cell)).applyInPandas(_cell(k), "q long, vec_id long, score long")

    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    opening = asked.join(grid.filter("longest"), "dims").withColumn("part", F.lit(0)).withColumn("least", F.lit(None).cast("double"))
    best, _ = common.materialize(meet(opening, chunked.filter(opens).withColumn("block", every_block)))
    kth = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    known = best.withColumn("rank", F.row_number().over(kth)).filter(F.col("rank") == k).select("q", F.col("score").cast("double").alias("least"))
    known, _ = common.materialize(asked.join(known, "q", "left"))

    # the norm that a candidate needs to matter to a query, and to any of a block
    need = F.coalesce((F.col("least") - 1) / F.greatest("norm", F.lit(1e-9)), F.lit(float("-inf")))
    of_block = F.broadcast(known.groupBy("dims", "block").agg(F.min(need).alias("need")).toDF("dims", "block", "need"))  # a row for each QUERY_BLOCK queries
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    later = known.join(grid.filter("parts > 1 or not longest"), "dims").filter(F.col("top") >= need).withColumn("part", every_part).filter(~opens)
    rest = chunked.filter(~opens).join(of_block, "dims").filter(F.col("norm") >= F.col("need"))
    found = best.unionByName(meet(later, rest))
    found = found.withColumn("score", F.coalesce("score", F.raise_error(F.lit("a score is out of the range of a long")).cast("long")))
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).join(asked.select("q", "query_id"), "q")
    return named.select("query_id", "rank", "vec_id", "score")
