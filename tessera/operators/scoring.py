"""Pair models as data: weighted features, conditions, and a logistic link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vocab

# fixed values: weights of the re-ranker
RERANK_BIAS = -3.2
RERANK = {"block_score": 4.2, "name_token_set": 3.8, "block_score_rel": 2.1, "name_jw": 2.5, "skel_token_set": 1.8, "addr_token_set": 2.2, "core_token_set": 1.5}
RERANK_SHARED, RERANK_DISJOINT = 1.4, -1.8


# fixed values: weights of the matchers of both dialects
@dataclass(frozen=True)
class MatchModel:
    bias: float
    names: tuple[tuple[str, float], ...]
    with_address: tuple[tuple[str, float], ...]
    without_address: float
    exact_without_address: float
    sibling: float
    clip: tuple[float, float]


BATCH = MatchModel(
    -3.2, (("name_jw", 3.4), ("name_token_set", 3.6), ("skel_token_set", 2.0), ("core_token_set", 2.0), ("name_ratio", 1.5)),
    (("addr_token_set", 3.2), ("addr_partial", 1.2)), -0.6, 1.2, -6.0, (1e-4, 0.9999),
)
STUDIO = MatchModel(
    -3.5, (("name_jw", 3.2), ("name_token_set", 3.5), ("skel_token_set", 1.9), ("core_token_set", 2.2), ("name_ratio", 1.8)),
    (("addr_token_set", 3.1), ("addr_partial", 1.5)), -0.6, 1.2, -4.2, (0.001, 0.999),
)


@dataclass(frozen=True)
class MatchConfig:
    threshold: float = 0.675
    unseen_strict: bool = True
    unseen_threshold: float = 0.85
    unseen_countries: tuple[str, ...] = ("France",)
    keep: int = 10
    min_rerank: float = 0.005
    dialect: str = "batch"


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def weighted(weights) -> Column:
    total = None
    for name, w in dict(weights).items():
        total = F.col(name) * w if total is None else total + F.col(name) * w
    return total


def _numbers_disjoint() -> Column:
    return (F.col("num_s1") > 0) & (F.col("num_pool") > 0) & (F.col("num_shared") == 0)


def rerank_probability() -> Column:
    numbers = F.when(F.col("num_shared") > 0, RERANK_SHARED).when(_numbers_disjoint(), RERANK_DISJOINT).otherwise(0.0)
    return sigmoid(F.lit(RERANK_BIAS) + weighted(RERANK) + numbers)


def rerank(features: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """features with rerank_p, cut to the best few of each S1 record; ties go to the better block rank."""
    scored = features.withColumn("rerank_p", rerank_probability()).filter(F.col("rerank_p") >= config.min_rerank)
    order = Window.partitionBy("s1_id").orderBy(F.desc(F.round("rerank_p", 9)), "block_rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).filter(F.col("rerank_rank") <= config.keep)


def sibling_word(dialect: str = "batch") -> Column:
    """Whether the pool name has a raw word, not in the S1 name, that tells branches apart."""
    raw = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")
    own = raw(F.col("a_name"))
    return F.exists(raw(F.col("b_name")), lambda t: t.isin(*vocab.SIBLING_WORDS[dialect]) & ~F.array_contains(own, t))


def match_probability(model: MatchModel = BATCH, sibling: Column | None = None) -> Column:
    sibling = sibling if sibling is not None else F.col("sibling")
    z = F.lit(model.bias) + weighted(model.names)
    z += F.when(F.col("pool_addr_empty") == 0, weighted(model.with_address)).otherwise(
        F.lit(model.without_address) + F.when(F.col("name_token_set") > 0.95, model.exact_without_address).otherwise(0.0)
    )
    if model is BATCH:
        numbers = F.when(F.col("primary_match") == 1, 2.8).when(F.col("primary_conflict") == 1, -5.0).when(F.col("num_shared") > 0, 1.5).when(_numbers_disjoint(), -3.0)
        veto = sibling
    else:
        numbers = F.when(F.col("num_shared") > 0, 2.0).when(_numbers_disjoint(), -2.6)
        veto = sibling & _numbers_disjoint()
    z += numbers.otherwise(0.0) + F.when(veto, model.sibling).otherwise(0.0)
    low, high = model.clip
    return F.greatest(F.lit(low), F.least(F.lit(high), sigmoid(z)))


def score_matches(top: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """top with sibling and prob."""
    model = BATCH if config.dialect == "batch" else STUDIO
    return top.withColumn("sibling", sibling_word(config.dialect)).withColumn("prob", match_probability(model))


def accepted(config: MatchConfig = MatchConfig()) -> Column:
    """Whether a scored pair passes its country's threshold and no veto speaks against it."""
    unseen = F.col("a_country").isin(*config.unseen_countries) & F.lit(config.unseen_strict)
    threshold = F.when(unseen, config.unseen_threshold).otherwise(config.threshold)
    return (F.col("prob") >= threshold) & ~F.col("sibling") & ~(unseen & _numbers_disjoint())


def label(scored: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """scored with status and reason, as the studio shows them."""
    threshold = F.when(F.col("a_country").isin(*config.unseen_countries) & F.lit(config.unseen_strict), config.unseen_threshold).otherwise(config.threshold)
    status = F.when(F.col("sibling") & (F.col("prob") < threshold), "REJECTED_SIBLING").when(F.col("prob") < threshold, "REJECTED_PROBABILITY").otherwise("MATCHED")
    reason = F.when(status == "REJECTED_SIBLING", "sibling word in the candidate's name").when(status == "REJECTED_PROBABILITY", F.format_string("probability %.3f below %.3f", F.col("prob"), threshold))
    return scored.withColumn("status", status).withColumn("reason", reason)


@dataclass(frozen=True)
class EvaluatorConfig:
    threshold: float = 0.68
    unseen_strict: bool = True
    unseen_threshold: float = 0.85
    require_address: bool = True
    suppress_primary_conflict: bool = True
    suppress_sibling: bool = True
    competition: bool = True


# fixed values: the named configurations of the evaluation sweep, in order
SWEEP = (
    EvaluatorConfig(0.55, False, 0.55, False, False, False, False),
    EvaluatorConfig(0.60, False, 0.60, False, False, False, True),
    EvaluatorConfig(0.62, False, 0.62, True, True, False, True),
    EvaluatorConfig(0.65, False, 0.65, True, True, True, True),
    EvaluatorConfig(0.65, True, 0.82, True, True, True, True),
    EvaluatorConfig(0.62, True, 0.82, True, True, True, True),
)
FINE_THRESHOLDS, FINE_UNSEEN = (0.61, 0.62, 0.63, 0.64, 0.65), (0.81, 0.82, 0.83, 0.84)


def fine_grid() -> tuple[EvaluatorConfig, ...]:
    return tuple(EvaluatorConfig(t, True, u) for t in FINE_THRESHOLDS for u in FINE_UNSEEN)


def composite_score() -> Column:
    base = F.col("name_token_set") * 0.40 + F.col("name_jw") * 0.20 + F.col("skel_token_set") * 0.15 + F.col("addr_token_set") * 0.25
    return base + F.when(F.col("primary_match") == 1, 0.08).otherwise(0.0) + F.when(F.col("num_shared") > 0, 0.04).otherwise(0.0)


def sweep(scored: DataFrame, configs: tuple[EvaluatorConfig, ...], unseen_countries: tuple[str, ...] = ("France",)) -> DataFrame:
    """(iteration, s1_id, pool_id, score): pairs that pass each configuration; the grid is a literal, so pairs are read once."""
    grid = F.array(*[F.struct(F.lit(i + 1).alias("iteration"), *[F.lit(v).alias(k) for k, v in vars(c).items()]) for i, c in enumerate(configs)])
    rows = scored.withColumn("sibling", sibling_word("evaluator")).withColumn("score", composite_score()).withColumn("g", F.explode(grid))
    unseen = F.col("a_country").isin(*unseen_countries) & F.col("g.unseen_strict")
    vetoes = [
        F.col("g.suppress_primary_conflict") & (F.col("primary_conflict") == 1),
        _numbers_disjoint(),
        F.col("g.suppress_sibling") & F.col("sibling") & ((F.col("primary_match") == 0) | (F.col("addr_token_set") < 0.75)),
        F.col("g.require_address") & (F.col("pool_addr_empty") == 0) & (F.col("addr_token_set") < 0.35) & (F.col("primary_match") == 0),
        unseen & ((F.col("addr_token_set") < 0.50) | (F.col("primary_conflict") == 1)),
        F.greatest("name_token_set", "skel_token_set", "name_jw") < 0.65,
    ]
    vetoed = vetoes[0]
    for v in vetoes[1:]:
        vetoed |= v
    passed = F.round("score", 9) >= F.when(unseen, F.col("g.unseen_threshold")).otherwise(F.col("g.threshold"))
    return rows.filter(~vetoed & passed).select(F.col("g.iteration").alias("iteration"), F.col("g.competition").alias("competition"), "s1_id", "pool_id", F.round("score", 9).alias("score"))
