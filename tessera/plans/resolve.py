"""The resolve plan: prepared records, candidates, features, re-ranking, matching, competition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocking, competition, features, scoring
from tessera.plans.store import stored


@dataclass(frozen=True)
class ResolveConfig:
    blocking: blocking.BlockingConfig = blocking.BlockingConfig()
    match: scoring.MatchConfig = scoring.MatchConfig()


def prepared_sides(records: DataFrame, dialect: str = "batch") -> tuple[DataFrame, DataFrame]:
    """(S1, pool) of records with a src column.

    Every step reads the prepared records, so they are computed once and stored
    in the shared folder. That also keeps the normalisation out of the plans
    above, which the optimizer would otherwise copy into their filters and joins.
    """
    prepared = stored(blocking.prepare(records, dialect))
    return prepared.filter("src = 'S1'"), prepared.filter("src <> 'S1'")


def candidate_pairs(s1: DataFrame, pool: DataFrame, config: ResolveConfig = ResolveConfig()) -> DataFrame:
    """Candidates with both records' prepared columns."""
    return features.paired(blocking.candidates(s1, pool, config.blocking), s1, pool)


def scored_pairs(s1: DataFrame, pool: DataFrame, config: ResolveConfig = ResolveConfig()) -> DataFrame:
    """The re-ranked few of each S1 record with their match probability."""
    top = scoring.rerank(features.extract(candidate_pairs(s1, pool, config), config.match.dialect, config.match.dialect == "studio"), config.match)
    return scoring.score_matches(top, config.match)


def matches(scored: DataFrame, config: ResolveConfig = ResolveConfig()) -> DataFrame:
    """(s1_id, pool_id, prob): accepted pairs, each pool record with one owner."""
    kept = scored.filter(scoring.accepted(config.match)).select("s1_id", "pool_id", "prob")
    return competition.owners(kept)


def resolve(records: DataFrame, config: ResolveConfig = ResolveConfig()) -> DataFrame:
    """(s1_id, n_matches, matched_ids) for every S1 record."""
    s1, pool = prepared_sides(records, config.match.dialect)
    found = matches(scored_pairs(s1, pool, config), config)
    lists = found.groupBy("s1_id").agg(F.array_sort(F.collect_list("pool_id")).alias("ids"))
    joined = s1.select(F.col("id").alias("s1_id")).join(lists, "s1_id", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select("s1_id", F.size(ids).cast("long").alias("n_matches"), F.array_join(ids, ",").alias("matched_ids"))
