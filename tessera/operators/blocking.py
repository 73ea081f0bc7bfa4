"""Candidate generation: rare-key index, cosine of IDF vectors, top k for each S1 record.

The index is a long table (id, country, key); probing is an equi-join on the
key, and a dot product is a hash aggregate with map-side combine. Keys that most
records share only cost, so they are dropped by document frequency before the
join; max_df_mode="hard" drops them whatever their share, which bounds the join
at any scale. AQE splits the posting lists that stay large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import keys, normalize

#: Cosines are compared after rounding, so that ties don't hang on the order of a sum.
DIGITS = 9


@dataclass(frozen=True)
class BlockingConfig:
    top_k: int = 50
    max_df: int = 5000
    df_share: float = 0.4
    max_df_mode: str = "share"  # or "hard": drop above max_df alone
    idf_scope: str = "pool"  # or "country"
    dialect: str = "batch"
    prefixes: tuple[str, ...] = ()  # only keys of these kinds, as "n:"; all if empty


def prepare(records: DataFrame, dialect: str = "batch") -> DataFrame:
    """Everything about a record that pairs need, once per record."""
    toks = records.select("*", normalize.name_tokens("name", dialect).alias("name_toks"), normalize.address_tokens("address", dialect).alias("addr_toks"))
    more = toks.select(
        "*",
        F.array_join("name_toks", " ").alias("name_text"),
        F.array_join("addr_toks", " ").alias("addr_text"),
        normalize.skeleton_text(F.col("name_toks")).alias("skel_text"),
        F.array_join(normalize.core_tokens(F.col("name_toks"), F.col("country")), " ").alias("core_text"),
        normalize.numbers(F.col("addr_toks"), dialect).alias("numbers"),
        keys.skeletons(F.col("name_toks")).alias("skels"),
    )
    return more.select("*", keys.record_keys(F.col("name_toks"), F.col("skels"), F.col("addr_toks")).alias("keys"))


def exploded_keys(prepared: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    # an outer explode: for an inner one the optimizer would copy the whole key expression into a filter
    rows = prepared.select("id", "country", F.explode_outer("keys").alias("key")).filter("key is not null")
    if config.prefixes:
        rows = rows.filter(F.substring("key", 1, 2).isin(*config.prefixes))
    return rows


def _scope(config: BlockingConfig) -> list[str]:
    return ["country", "key"] if config.idf_scope == "country" else ["key"]


def document_frequency(pool_keys: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    return pool_keys.groupBy(*_scope(config)).agg(F.count("*").alias("df"))


def inverse_frequency(pool: DataFrame, pool_keys: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """(key, df, idf) of the keys that are kept."""
    df = document_frequency(pool_keys, config)
    if config.idf_scope == "country":
        sized = df.join(pool.groupBy("country").agg(F.count("*").alias("n")), "country")
    else:
        sized = df.withColumn("n", F.lit(pool.count()))
    common = F.col("df") > config.max_df
    if config.max_df_mode == "share":
        common &= F.col("df") > config.df_share * F.col("n")
    kept = sized.filter(~common)
    return kept.select(*_scope(config), "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def norms(weighted: DataFrame) -> DataFrame:
    """(id, norm) of weighted(id, idf)."""
    return weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))


def candidates(s1: DataFrame, pool: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """(s1_id, pool_id, cos, block_rank, best_cos): the top k pool records of each prepared S1 record.

    Records of different countries never pair; an empty country pairs with all.
    Ties go to the smaller pool id. S1 records without a candidate have no row.
    """
    pool_keys = exploded_keys(pool, config)
    idf = inverse_frequency(pool, pool_keys, config).drop("df")
    scope = _scope(config)
    a, b = (k.join(idf, scope) for k in (exploded_keys(s1, config), pool_keys))
    left = a.select(F.col("id").alias("s1_id"), F.col("country").alias("s1_country"), "key", "idf")
    right = b.select(F.col("id").alias("pool_id"), F.col("country").alias("pool_country"), F.col("key").alias("pool_key"))
    agree = (F.col("s1_country") == F.col("pool_country")) | (F.col("s1_country") == "") | (F.col("pool_country") == "")
    dots = left.join(right, (F.col("key") == F.col("pool_key")) & agree).groupBy("s1_id", "pool_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    of_s1, of_pool = norms(a).toDF("s1_id", "s1_norm"), norms(b).toDF("pool_id", "pool_norm")
    cos = F.round(F.col("dot") / (F.col("s1_norm") * F.col("pool_norm")), DIGITS)
    scored = dots.join(of_s1, "s1_id").join(of_pool, "pool_id").select("s1_id", "pool_id", cos.alias("cos"))
    order = Window.partitionBy("s1_id").orderBy(F.desc("cos"), "pool_id")
    ranked = scored.withColumn("block_rank", F.row_number().over(order)).filter(F.col("block_rank") <= config.top_k)
    best = F.max("cos").over(Window.partitionBy("s1_id"))
    return ranked.withColumn("best_cos", best)


def merged_passes(*passes: DataFrame) -> DataFrame:
    """The union of candidate pairs of several passes."""
    first, *rest = [p.select("s1_id", "pool_id") for p in passes]
    for p in rest:
        first = first.unionByName(p)
    return first.distinct()


def cut_relative(found: DataFrame, share: float) -> DataFrame:
    """Candidates that reach a share of their record's best cosine."""
    return found.filter(F.col("cos") >= share * F.col("best_cos"))
