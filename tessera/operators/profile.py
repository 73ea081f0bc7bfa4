"""Profiles of records and truth: counts, histograms, agreement, empty fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_by_country_and_source(records: DataFrame) -> DataFrame:
    """A row per country and one for all (ALL), a column per source and a total."""
    named = records.withColumn("country", F.when(F.col("country") == "", "(none)").otherwise(F.col("country")))
    per = [F.sum(F.when(F.col("src") == s, 1).otherwise(0)).alias(s.lower()) for s in ("S1", "S2", "S3")]
    rolled = named.rollup("country").agg(*per, F.count("*").alias("total"), F.grouping("country").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("country")).alias("country"), "s1", "s2", "s3", "total")


def truth_sanity(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: S1 records without truth, repeated pairs, pairs with unknown ids, pool records with several owners, pairs by source."""
    owners = truth.groupBy("pool_id").agg(F.countDistinct("s1_id").alias("n"))
    repeated = truth.groupBy("s1_id", "pool_id").agg(F.count("*").alias("n"))
    measured = {
        "n_singletons": s1.select(F.col("id").alias("s1_id")).join(truth, "s1_id", "left_anti").select(F.lit(1).alias("v")),
        "n_dangling": truth.join(pool.select(F.col("id").alias("pool_id")), "pool_id", "left_anti").select(F.lit(1).alias("v")),
        "n_repeated": repeated.select((F.col("n") - 1).alias("v")),
        "n_multi_owner": owners.filter("n > 1").select(F.lit(1).alias("v")),
        "n_pairs": truth.select(F.lit(1).alias("v")),
        "n_s2": truth.filter(F.col("pool_id").startswith("S2-")).select(F.lit(1).alias("v")),
        "n_s3": truth.filter(F.col("pool_id").startswith("S3-")).select(F.lit(1).alias("v")),
    }
    rows = [df.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")).select(F.lit(name).alias("name"), "v") for name, df in measured.items()]
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r)
    return all_rows.agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in measured])


def match_histogram(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """(country, n_matches, n_entities)."""
    counted = s1.select(F.col("id").alias("s1_id"), "country").join(truth.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left")
    return counted.groupBy("country", F.coalesce("n", F.lit(0)).alias("n_matches")).agg(F.count("*").alias("n_entities"))


def source_mix(truth: DataFrame) -> DataFrame:
    """(sources, n_entities): matched entities by whether their matches are in S2, in S3 or in both."""
    of = truth.groupBy("s1_id").agg(F.max(F.col("pool_id").startswith("S2-")).alias("s2"), F.max(F.col("pool_id").startswith("S3-")).alias("s3"))
    kind = F.when(F.col("s2") & F.col("s3"), "both").when(F.col("s2"), "S2").otherwise("S3")
    return of.groupBy(kind.alias("sources")).agg(F.count("*").alias("n_entities"))


def country_agreement(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_country, pool_country, n_pairs) of true pairs."""
    a = s1.select(F.col("id").alias("s1_id"), F.col("country").alias("s1_country"))
    b = pool.select(F.col("id").alias("pool_id"), F.col("country").alias("pool_country"))
    return truth.join(a, "s1_id").join(b, "pool_id").groupBy("s1_country", "pool_country").agg(F.count("*").alias("n_pairs"))


def empty_fields(records: DataFrame) -> DataFrame:
    """(src, country, share of empty names, of empty addresses)."""
    share = lambda c: F.round(F.avg(F.when(F.col(c) == "", 1.0).otherwise(0.0)), 9)
    return records.groupBy("src", "country").agg(F.count("*").alias("n"), share("name").alias("empty_name"), share("address").alias("empty_address"))


def seeded_sample(records: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """n records in a seeded order: a report's sample."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), "id").cast("binary"))
    return records.orderBy(mark, "id").limit(n)


def prediction_summary(s1: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """By country: entities, mean candidates, mean matches, share without a match."""
    count = lambda df, n: df.groupBy("s1_id").agg(F.count("*").alias(n))
    rows = s1.select(F.col("id").alias("s1_id"), "country").join(count(candidates, "c"), "s1_id", "left").join(count(matches, "m"), "s1_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.groupBy("country").agg(
        F.count("*").alias("n_entities"), F.round(F.avg(zero("c")), 9).alias("mean_candidates"), F.round(F.avg(zero("m")), 9).alias("mean_matches"),
        F.round(F.avg(F.when(zero("m") == 0, 1.0).otherwise(0.0)), 9).alias("share_without"),
    )
