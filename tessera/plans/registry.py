"""Queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.functions import normalize, vocab

from tessera.operators import blocking, competition, evaluate, features, learn, profile, scoring, validate
from tessera.plans import duck, resolve, store
from tessera.sources import benchmark, records, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MATCH = scoring.MatchConfig(unseen_countries=("fr",))
STUDIO = scoring.MatchConfig(unseen_countries=("fr",), dialect="studio")
CONFIG = resolve.ResolveConfig(match=MATCH)
KS = (5, 10, 20, 30, 50, 100)
THRESHOLDS = [round(0.3 + 0.025 * i, 3) for i in range(27)]


def query(oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_known_sides: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(S1, pool) of the pages' records; prepared once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known_sides:
        _known_sides[key] = resolve.prepared_sides(records.from_pages(spark, sf_dir))
    return _known_sides[key]


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, pool = _sides(spark, sf_dir)
    return s1.unionByName(pool)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.candidate_pairs(*_sides(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extract(_pairs(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rerank(_features(spark, sf_dir), MATCH)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_matches(_top(spark, sf_dir), MATCH)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.proxy_truth(*_sides(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[0].select(F.col("id").alias("s1_id"), "country")


def _joined(c: str, sep: str = " ") -> F.Column:
    return F.array_join(c, sep).alias(c)


# --- normalisation -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5(c) AS cleaned_md5, length(c) AS cleaned_length FROM (SELECT doc_id, {duck.clean('text')} AS c FROM documents)")
def clean_text(spark, sf_dir):
    c = normalize.clean("text")
    rows = _table(spark, sf_dir, "documents").select("doc_id", c.alias("c"))
    return rows.select("doc_id", F.md5(F.col("c").cast("binary")).alias("cleaned_md5"), F.length("c").cast("long").alias("cleaned_length"))


@query(f"WITH {duck.PREPARED} SELECT id, name_text FROM prep")
def name_tokens(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", "name_text")


@query(f"WITH {duck.PREPARED} SELECT id, addr_text FROM prep")
def address_tokens(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", "addr_text")


@query(f"WITH {duck.PREPARED} SELECT id, skel_text, array_to_string(skels, ' ') AS skels FROM prep")
def skeleton_keys(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", "skel_text", _joined("skels"))


@query(f"SELECT DISTINCT t AS word, {duck.repair_digits('t')} AS repaired FROM (SELECT unnest({duck.tokens(duck.clean('text'))}) AS t FROM documents)")
def digit_repair(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(normalize.tokens(normalize.clean("text"))).alias("word")).distinct()
    return words.select("word", normalize.repair_digits(F.col("word")).alias("repaired"))


@query(f"SELECT c_custkey, array_to_string({duck.name_tokens('c_name')}, ' ') AS tokens FROM customer")
def zero_strip(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(normalize.name_tokens("c_name"), " ").alias("tokens"))


@query(f"WITH {duck.PREPARED} SELECT id, core_text FROM prep")
def core_name(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", "core_text")


@query(f"WITH {duck.PREPARED} SELECT id, array_to_string(numbers, ' ') AS numbers FROM prep")
def number_tokens(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", _joined("numbers"))


@query(f"WITH {duck.PREPARED} SELECT id, array_to_string(list_sort(keys), ' ') AS keys FROM prep")
def record_keys(spark, sf_dir):
    return _prepared(spark, sf_dir).select("id", F.array_join(F.array_sort("keys"), " ").alias("keys"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'steel')")
def lookup(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.filter(F.lower("p_name").contains("a") | F.lower("p_type").contains("steel")).select("p_partkey", "p_name")


# --- sources and sinks -------------------------------------------------------------------------------------------------------


@query(f"WITH {duck.RECORDS} SELECT * FROM records")
def standard_records(spark, sf_dir):
    return records.from_pages(spark, sf_dir)


@query(f"WITH {duck.RECORDS} SELECT id, name FROM records WHERE src = 'S2' UNION ALL SELECT id, name FROM records WHERE src = 'S3'")
def pool_union(spark, sf_dir):
    all_records = records.from_pages(spark, sf_dir)
    return records.pool_of(all_records.filter("src = 'S2'"), all_records.filter("src = 'S3'")).select("id", "name")


_SAMPLE = f"sampled AS (SELECT id, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY {duck.seeded()}, id) AS r, count(*) OVER (PARTITION BY country) AS n FROM s1) WHERE r <= greatest(1, floor(n * 0.1)))"


@query(f"WITH {duck.PREPARED}, {_SAMPLE} SELECT id, country FROM sampled")
def stratified_sample(spark, sf_dir):
    return records.sample_by_country(_sides(spark, sf_dir)[0]).select("id", "country")


@query(f"WITH {duck.PREPARED}, {duck.TRUTH}, {_SAMPLE} SELECT id FROM pool WHERE id IN (SELECT pool_id FROM truth WHERE s1_id IN (SELECT id FROM sampled)) OR ('0x' || substr({duck.seeded()}, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1")
def pool_sample(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    return records.sample_pool(pool, records.proxy_truth(s1, pool), records.sample_by_country(s1)).select("id")


@query()
def synthetic_benchmark(spark, sf_dir):
    return benchmark.synthetic_records(spark)


@query(f"WITH {duck.owned()} SELECT s1.id AS source1_entity_id, coalesce(string_agg(pool_id, ',' ORDER BY pool_id), '') AS matched_entity_ids FROM s1 LEFT JOIN owned ON s1_id = s1.id GROUP BY 1")
def matching_results(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    return sinks.as_lists(s1, resolve.matches(resolve.scored_pairs(s1, pool, CONFIG), CONFIG))


@query(f"WITH {duck.reranked()} SELECT s1.id AS source1_entity_id, coalesce(string_agg(pool_id, ',' ORDER BY pool_id), '') AS candidate_entity_ids FROM s1 LEFT JOIN top ON s1_id = s1.id GROUP BY 1")
def candidate_lists(spark, sf_dir):
    return sinks.as_lists(_sides(spark, sf_dir)[0], _top(spark, sf_dir), "candidate_entity_ids")


# --- blocking ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {duck.INDEX} SELECT key, df FROM df")
def key_df(spark, sf_dir):
    return blocking.document_frequency(blocking.exploded_keys(_sides(spark, sf_dir)[1]))


@query(f"WITH {duck.INDEX} SELECT key, df, round(idf, 9) AS idf FROM idf")
def key_idf(spark, sf_dir):
    pool = _sides(spark, sf_dir)[1]
    return blocking.inverse_frequency(pool, blocking.exploded_keys(pool)).select("key", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {duck.PREPARED}, k AS (SELECT id, country, unnest(keys) AS key FROM pool) SELECT country, key, count(*) AS df FROM k GROUP BY ALL")
def key_df_by_country(spark, sf_dir):
    return blocking.document_frequency(blocking.exploded_keys(_sides(spark, sf_dir)[1]), blocking.BlockingConfig(idf_scope="country")).select("country", "key", "df")


@query(f"WITH {duck.INDEX} SELECT id, round(norm, 9) AS norm FROM pool_norms")
def pool_norms(spark, sf_dir):
    pool = _sides(spark, sf_dir)[1]
    keys = blocking.exploded_keys(pool)
    weighted = keys.join(blocking.inverse_frequency(pool, keys).drop("df"), "key")
    return blocking.norms(weighted).select("id", F.round("norm", 9).alias("norm"))


@query(f"WITH {duck.candidates()} SELECT s1_id, pool_id, cos, block_rank FROM cands")
def candidates_topk(spark, sf_dir):
    return blocking.candidates(*_sides(spark, sf_dir)).select("s1_id", "pool_id", "cos", "block_rank")


@query(f"WITH {duck.candidates()} SELECT s1.id AS s1_id, max(cos) AS best_cos, count(pool_id) AS n FROM s1 LEFT JOIN cands ON s1_id = s1.id GROUP BY 1")
def best_block(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    found = blocking.candidates(s1, pool).groupBy("s1_id").agg(F.max("best_cos").alias("best_cos"), F.count("*").alias("n"))
    return s1.select(F.col("id").alias("s1_id")).join(found, "s1_id", "left").select("s1_id", "best_cos", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {duck.candidates()} SELECT s1_id, pool_id FROM cands WHERE cos >= 0.5 * best_cos")
def relative_cut(spark, sf_dir):
    return blocking.cut_relative(blocking.candidates(*_sides(spark, sf_dir)), 0.5).select("s1_id", "pool_id")


@query(
    f"WITH {duck.PREPARED}, {duck.blocking_pass('name', 20, ('n:', 'k:', 'p:', 'c:'))}, {duck.blocking_pass('addr', 20, ('a:', 'b:'))}, {duck.blocking_pass('full')} "
    "SELECT s1_id, pool_id FROM ranked_name UNION SELECT s1_id, pool_id FROM ranked_addr UNION SELECT s1_id, pool_id FROM ranked_full"
)
def multi_pass(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    name = blocking.candidates(s1, pool, blocking.BlockingConfig(top_k=20, prefixes=("n:", "k:", "p:", "c:")))
    address = blocking.candidates(s1, pool, blocking.BlockingConfig(top_k=20, prefixes=("a:", "b:")))
    return blocking.merged_passes(name, address, blocking.candidates(s1, pool))


@query(f"WITH {duck.PREPARED}, {duck.blocking_pass('own', by_country=True, hard=True)} SELECT s1_id, pool_id, cos, block_rank FROM ranked_own")
def candidates_by_country(spark, sf_dir):
    config = blocking.BlockingConfig(idf_scope="country", max_df_mode="hard")
    return blocking.candidates(*_sides(spark, sf_dir), config).select("s1_id", "pool_id", "cos", "block_rank")


# --- similarities and features -----------------------------------------------------------------------------------------------


def _one(name: str, column) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("s1_id", "pool_id", F.bround(column(), 4).alias(name))

    run.__name__ = name
    query(f"WITH {duck.candidates()} SELECT s1_id, pool_id, {duck.FEATURES[name]} AS {name} FROM pairs")(run)


for _name in ("name_ratio", "name_token_sort", "name_token_set", "name_partial", "name_nospace_ratio", "skel_ratio", "skel_token_set", "core_ratio", "core_token_set", "name_jw"):
    _one(_name, lambda n=_name: features.name_similarities()[n])
for _name in ("addr_ratio", "addr_token_set", "addr_partial"):
    _one(_name, lambda n=_name: features.address_similarities()[n])

_NUMBERS = ("num_shared", "num_s1", "num_pool", "num_pool_share", "primary_conflict", "primary_match")


@query(f"WITH {duck.features(_NUMBERS)} SELECT s1_id, pool_id, {', '.join(_NUMBERS)} FROM feats")
def number_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("s1_id", "pool_id", *[(F.bround(c, 4) if k == "num_pool_share" else c).alias(k) for k, c in features.number_features().items()])


@query(f"WITH {duck.features()} SELECT s1_id, pool_id, block_rank, {', '.join(duck.FEATURES)}, round_even(name_token_set - 1.0, 4) AS name_token_set_vs_best, round_even(addr_token_set - 1.0, 4) AS addr_token_set_vs_best FROM feats")
def pair_features(spark, sf_dir):
    return _features(spark, sf_dir).select("s1_id", "pool_id", "block_rank", *duck.FEATURES, "name_token_set_vs_best", "addr_token_set_vs_best")


@query(f"WITH {duck.features(('name_token_set', 'addr_token_set'))} SELECT s1_id, pool_id, round_even(name_token_set - max(name_token_set) OVER w, 4) AS name_vs_best, round_even(addr_token_set - max(addr_token_set) OVER w, 4) AS addr_vs_best FROM feats WINDOW w AS (PARTITION BY s1_id)")
def vs_best(spark, sf_dir):
    rows = features.extract(_pairs(spark, sf_dir), relative_to_best=True)
    return rows.select("s1_id", "pool_id", F.col("name_token_set_vs_best").alias("name_vs_best"), F.col("addr_token_set_vs_best").alias("addr_vs_best"))


_scores = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in vocab.WORD_SCORES.items()) + "}"


def _word_columns(kind: str, here: str, there: str) -> str:
    words = f"list_filter({here}, lambda t: NOT list_contains({there}, t))"
    scores = f"list_transform({words}, lambda t: coalesce({_scores}[t], 0.5::DOUBLE))"
    return f"coalesce(list_min({scores}), 1.0) AS {kind}_min, round_even(CASE WHEN len({words}) > 0 THEN list_sum({scores}) / len({words}) ELSE 1.0 END, 4) AS {kind}_mean, len({words})::INT AS n_{kind}"


@query(f"WITH {duck.candidates()} SELECT s1_id, pool_id, {_word_columns('extra', 'b_name_toks', 'a_name_toks')}, {_word_columns('missing', 'a_name_toks', 'b_name_toks')} FROM pairs")
def word_diff(spark, sf_dir):
    return _pairs(spark, sf_dir).select("s1_id", "pool_id", *[(F.bround(c, 4) if k.endswith("_mean") else c).alias(k) for k, c in features.word_differences().items()])


_gaps = "flatten(list_transform(a_numbers, lambda x: list_transform(b_numbers, lambda y: abs(x::HUGEINT - y::HUGEINT))))"


@query(
    f"WITH {duck.candidates()} SELECT s1_id, pool_id, (len(list_filter(a_numbers, lambda x: len(list_filter(b_numbers, lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0)::INT AS num_dropped_digit, "
    f"(CASE WHEN coalesce(list_min({_gaps}), 999) >= 999 THEN 0 ELSE list_min({_gaps}) END)::BIGINT AS num_min_diff FROM pairs"
)
def number_diff(spark, sf_dir):
    return _pairs(spark, sf_dir).select("s1_id", "pool_id", *[c.alias(k) for k, c in features.number_differences().items()])


@query(
    f"WITH {duck.candidates()}, met AS (SELECT x.s1_id, x.pool_id, {duck.ratio('x.b_name_text', 'y.b_name_text')} AS n, {duck.ratio('x.b_addr_text', 'y.b_addr_text')} AS a FROM pairs x JOIN pairs y ON x.s1_id = y.s1_id AND x.pool_id <> y.pool_id) "
    "SELECT c.s1_id, c.pool_id, round(coalesce(max(n), 0), 9) AS clu_name_max, round(coalesce(max(a), 0), 9) AS clu_addr_max, count(*) FILTER (n >= 0.85) AS clu_n_similar FROM cands c LEFT JOIN met ON met.s1_id = c.s1_id AND met.pool_id = c.pool_id GROUP BY ALL"
)
def cluster_features(spark, sf_dir):
    found = features.cluster_features(_pairs(spark, sf_dir))
    return found.select("s1_id", "pool_id", F.round("clu_name_max", 9).alias("clu_name_max"), F.round("clu_addr_max", 9).alias("clu_addr_max"), F.col("clu_n_similar").cast("long").alias("clu_n_similar"))


@query(f"WITH {duck.PREPARED} SELECT id, count(*) OVER (PARTITION BY name_text) AS name_n, count(*) OVER (PARTITION BY addr_text) AS addr_n FROM s1")
def name_counts(spark, sf_dir):
    return features.shared_counts(_sides(spark, sf_dir)[0])


@query()
def match_features(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    wide = features.match_features(resolve.candidate_pairs(s1, pool), s1, pool)
    return wide.drop(*[c for c in wide.columns if c.startswith(("a_", "b_"))])


# --- models and decisions ----------------------------------------------------------------------------------------------------


@query(f"WITH {duck.reranked()} SELECT s1_id, pool_id, round(rerank_p, 6) AS rerank_p FROM rr0")
def rerank_score(spark, sf_dir):
    return _features(spark, sf_dir).select("s1_id", "pool_id", F.round(scoring.rerank_probability(), 6).alias("rerank_p"))


@query(f"WITH {duck.reranked()} SELECT s1_id, pool_id, rerank_rank FROM top")
def top10(spark, sf_dir):
    return _top(spark, sf_dir).select("s1_id", "pool_id", "rerank_rank")


@query(f"WITH {duck.candidates()} SELECT s1_id, pool_id, {duck.sibling()} AS sibling FROM pairs")
def sibling_flag(spark, sf_dir):
    return _pairs(spark, sf_dir).select("s1_id", "pool_id", scoring.sibling_word().alias("sibling"))


@query(f"WITH {duck.scored()} SELECT s1_id, pool_id, round(prob, 6) AS prob FROM scored")
def match_prob(spark, sf_dir):
    return _scored(spark, sf_dir).select("s1_id", "pool_id", F.round("prob", 6).alias("prob"))


@query(f"WITH {duck.scored('studio')} SELECT s1_id, pool_id, round(prob, 6) AS prob FROM scored")
def match_prob_studio(spark, sf_dir):
    return scoring.score_matches(_top(spark, sf_dir), STUDIO).select("s1_id", "pool_id", F.round("prob", 6).alias("prob"))


@query(f"WITH {duck.accepted()} SELECT s1_id, pool_id FROM accepted")
def threshold_decision(spark, sf_dir):
    return _scored(spark, sf_dir).filter(scoring.accepted(MATCH)).select("s1_id", "pool_id")


_LABELLED = f"""{duck.scored()}, l0 AS (SELECT *, CASE WHEN {duck.UNSEEN} THEN 0.85 ELSE 0.675 END AS limit_ FROM scored),
labelled AS (SELECT s1_id, pool_id, prob, CASE WHEN sibling AND prob < limit_ THEN 'REJECTED_SIBLING' WHEN prob < limit_ THEN 'REJECTED_PROBABILITY' ELSE 'MATCHED' END AS status FROM l0)"""


@query(f"WITH {_LABELLED} SELECT s1_id, pool_id, status FROM labelled")
def status_labels(spark, sf_dir):
    return scoring.label(_scored(spark, sf_dir), MATCH).select("s1_id", "pool_id", "status")


@query(f"WITH {_LABELLED} SELECT s1_id, pool_id, CASE WHEN status = 'MATCHED' AND row_number() OVER (PARTITION BY pool_id, status = 'MATCHED' ORDER BY round(prob, 9) DESC, s1_id) > 1 THEN 'REJECTED_COMPETITION' ELSE status END AS status FROM labelled")
def competition_labels(spark, sf_dir):
    return competition.label_losers(scoring.label(_scored(spark, sf_dir), MATCH)).select("s1_id", "pool_id", "status")


@query(f"WITH {duck.owned()} SELECT s1_id, pool_id, round(prob, 6) AS prob FROM owned")
def owner_competition(spark, sf_dir):
    return resolve.matches(_scored(spark, sf_dir), CONFIG).select("s1_id", "pool_id", F.round("prob", 6).alias("prob"))


@query(f"WITH {duck.owned()} SELECT s1.id AS s1_id, count(pool_id) AS n_matches, coalesce(string_agg(pool_id, ',' ORDER BY pool_id), '') AS matched_ids FROM s1 LEFT JOIN owned ON s1_id = s1.id GROUP BY 1")
def resolved_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every S1 record with its matches."""
    return resolve.resolve(records.from_pages(spark, sf_dir), CONFIG)


# --- evaluation --------------------------------------------------------------------------------------------------------------


@query(f"WITH {duck.owned()}, {duck.TRUTH}, {duck.entity_scores('owned')} SELECT s1_id, n_true, n_predicted, n_hits, round(f05, 9) AS f05 FROM scores_")
def f05_entity(spark, sf_dir):
    scores = evaluate.entity_scores(_entities(spark, sf_dir), resolve.matches(_scored(spark, sf_dir), CONFIG), _truth(spark, sf_dir))
    return scores.withColumn("f05", F.round("f05", 9))


@query(f"WITH {duck.owned()}, {duck.TRUTH}, {duck.entity_scores('owned')} {duck.report()}")
def macro_f05(spark, sf_dir):
    return evaluate.report(evaluate.entity_scores(_entities(spark, sf_dir), resolve.matches(_scored(spark, sf_dir), CONFIG), _truth(spark, sf_dir)))


@query(f"WITH {duck.PREPARED}, {duck.TRUTH}, none_ AS (SELECT s1_id, pool_id FROM truth WHERE false), {duck.entity_scores('none_')} {duck.report()}")
def empty_baseline(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return evaluate.report(evaluate.entity_scores(_entities(spark, sf_dir), truth.filter(F.lit(False)), truth))


@query(f"WITH {duck.candidates()}, {duck.TRUTH}, found_ AS (SELECT s1_id, pool_id FROM cands SEMI JOIN truth USING (s1_id, pool_id)), {duck.entity_scores('found_')} {duck.report()}")
def oracle_f05(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    found = blocking.candidates(*_sides(spark, sf_dir)).join(truth, ["s1_id", "pool_id"], "left_semi")
    return evaluate.report(evaluate.entity_scores(_entities(spark, sf_dir), found, truth))


def _sweep(spark, sf_dir, configs):
    kept = scoring.sweep(_top(spark, sf_dir), configs, ("fr",))
    contested = competition.owners(kept.filter("competition"), "score", ("iteration",)).unionByName(kept.filter("not competition"))
    cells = _entities(spark, sf_dir).withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(len(configs)))))
    return evaluate.report(evaluate.entity_scores(cells, contested, _truth(spark, sf_dir), ("iteration",)), ("iteration",))


def _sweep_sql(configs) -> str:
    cells = f"(SELECT id AS s1_id, unnest(range(1, {len(configs) + 1}))::INT AS iteration FROM s1)"
    return f"WITH {duck.swept(configs)}, {duck.TRUTH}, {duck.entity_scores('kept', 'iteration', cells)} {duck.report('iteration')}"


@query(_sweep_sql(scoring.SWEEP))
def param_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir, scoring.SWEEP)


@query(_sweep_sql(scoring.fine_grid()))
def fine_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir, scoring.fine_grid())


@query(f"SELECT * FROM ({_sweep_sql(scoring.SWEEP)}) ORDER BY macro_f05 DESC, iteration LIMIT 1")
def best_sweep(spark, sf_dir):
    return evaluate.best_configuration(_sweep(spark, sf_dir, scoring.SWEEP))


_T = "[" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]"


@query(
    f"WITH {duck.scored()}, {duck.TRUTH}, over_ AS (SELECT s1_id, pool_id, prob, t.threshold FROM scored, (SELECT unnest({_T}) AS threshold) t WHERE round(prob, 9) >= t.threshold), "
    f"won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY threshold, pool_id ORDER BY round(prob, 9) DESC, s1_id) AS place FROM over_) WHERE place = 1), "
    f"{duck.entity_scores('won', 'threshold', f'(SELECT id AS s1_id, unnest({_T}) AS threshold FROM s1)')} {duck.report('threshold')}"
)
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(_scored(spark, sf_dir), _entities(spark, sf_dir), _truth(spark, sf_dir), THRESHOLDS)


_K = "[" + ", ".join(map(str, KS)) + "]"


@query(
    f"WITH {duck.candidates(100)}, {duck.TRUTH}, cut AS (SELECT s1_id, pool_id, k FROM cands, (SELECT unnest({_K}) AS k) WHERE block_rank <= k), found_ AS (SELECT cut.* FROM cut SEMI JOIN truth USING (s1_id, pool_id)), "
    f"{duck.entity_scores('found_', 'k', f'(SELECT id AS s1_id, unnest({_K}) AS k FROM s1)')}, n_cut AS (SELECT k, s1_id, count(*) AS n FROM cut GROUP BY ALL) "
    "SELECT s.k, CASE WHEN grouping(country) = 1 THEN 'ALL' ELSE country END AS country, round(sum(n_hits) / nullif(sum(n_true), 0)::DOUBLE, 9) AS pair_recall, round(avg(f05), 9) AS oracle_f05, round(sum(coalesce(n, 0)) / count(*)::DOUBLE, 9) AS candidates_per_entity "
    "FROM scores_ s JOIN s1 ON s1.id = s.s1_id LEFT JOIN n_cut c ON c.k = s.k AND c.s1_id = s.s1_id GROUP BY GROUPING SETS ((s.k), (s.k, country))"
)
def recall_by_k(spark, sf_dir):
    found = blocking.candidates(*_sides(spark, sf_dir), blocking.BlockingConfig(top_k=100))
    return evaluate.recall_by_k(found, _truth(spark, sf_dir), _entities(spark, sf_dir), KS)


@query(
    f"WITH {duck.reranked()}, n_top AS (SELECT s1.id AS s1_id, s1.country, count(pool_id) AS n FROM s1 LEFT JOIN top ON s1_id = s1.id GROUP BY ALL) "
    "SELECT country, count(*) AS n_entities, round(avg(n), 9) AS mean_n, quantile_cont(n, 0.5) AS median_n, quantile_cont(n, 0.95) AS p95_n, round(avg((n = 0)::INT), 9) AS share_empty FROM n_top GROUP BY 1"
)
def candidate_stats(spark, sf_dir):
    return evaluate.candidate_statistics(_entities(spark, sf_dir), _top(spark, sf_dir))


@query(f"WITH {duck.PREPARED} SELECT id, CASE WHEN row_number() OVER (ORDER BY {duck.seeded()}, id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'validation' END AS part FROM s1")
def split_entities(spark, sf_dir):
    return evaluate.split(_sides(spark, sf_dir)[0]).select("id", "part")


# --- validation --------------------------------------------------------------------------------------------------------------


def _mark(c, of: int):
    """A seeded number below of for each text."""
    return (F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long") % of).cast("int")


_mark_sql = "('0x' || substr(md5({}), 1, 8))::BIGINT % {}"


def _file(spark, sf_dir):
    """(line, id, ids) of the proxy truth as a result file; the page's number orders the lines."""
    s1, pool = _sides(spark, sf_dir)
    rows = sinks.as_lists(s1, records.proxy_truth(s1, pool)).toDF("id", "ids")
    return rows.select((F.regexp_extract("id", "([0-9]+)$", 1).cast("int") + 2).alias("line"), "id", "ids")


def _lines(spark, sf_dir):
    body = _file(spark, sf_dir).select("line", F.concat_ws("\t", "id", "ids").alias("value"))
    return spark.createDataFrame([(1, validate.HEADER)], "line int, value string").unionByName(body)


def _broken_lines(spark, sf_dir):
    """The file with a wrong header and, by a seeded number of the id, a fault of each sort."""
    rows = _file(spark, sf_dir).withColumn("d", _mark(F.col("id"), 9))
    fault = F.col("d")
    first = F.when(fault == 1, "").otherwise(F.col("id"))
    ids = F.when(fault == 2, "S2-1,S2-1").when(fault == 3, "X9-77").when(fault == 5, "S3-999999999").when(fault == 7, "S2-1 S2-1").otherwise(F.col("ids"))
    body = rows.filter(fault != 4).select("line", F.concat(first, F.lit("\t"), ids, F.when(fault == 0, "\tmore").otherwise("")).alias("value"))
    again = rows.filter(fault == 6).select(F.col("line") + 1_000_000, F.concat_ws("\t", "id", "ids"))
    return spark.createDataFrame([(1, "source1_entity_id\tmatches")], "line int, value string").unionByName(body.union(again).toDF("line", "value"))


_LISTS = f"{duck.PREPARED}, {duck.TRUTH}, lists AS (SELECT s1.id AS s1_id, coalesce(string_agg(DISTINCT pool_id, ',' ORDER BY pool_id), '') AS ids FROM s1 LEFT JOIN truth ON s1_id = s1.id GROUP BY 1), file_ AS (SELECT regexp_extract(s1_id, '([0-9]+)$', 1)::INT + 2 AS line, s1_id, ids, {_mark_sql.format('s1_id', 9)} AS d FROM lists)"
_BROKEN = (
    f"{_LISTS}, rows_ AS (SELECT line, CASE WHEN d = 1 THEN '' ELSE s1_id END AS s1_id, CASE d WHEN 2 THEN 'S2-1,S2-1' WHEN 3 THEN 'X9-77' WHEN 5 THEN 'S3-999999999' WHEN 7 THEN 'S2-1 S2-1' ELSE ids END AS ids, d = 0 AS wide FROM file_ WHERE d <> 4 "
    "UNION ALL SELECT line + 1000000, s1_id, ids, false FROM file_ WHERE d = 6), whole_ AS (SELECT *, list_filter(string_split(ids, ','), lambda x: x <> '') AS list FROM rows_ WHERE NOT wide), "
    "both_ AS (SELECT 'error' AS severity, 1 AS line, '' AS s1_id, 'header' AS rule UNION ALL SELECT 'error', line, s1_id, 'columns' FROM rows_ WHERE wide UNION ALL SELECT 'error', line, s1_id, 'empty_s1' FROM whole_ WHERE s1_id = '' "
    "UNION ALL SELECT 'error', line, s1_id, 'duplicate_s1' FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY line) AS nth FROM whole_) WHERE nth > 1)"
)


@query(f"WITH {_BROKEN} SELECT * FROM both_ UNION ALL SELECT 'warning', line, s1_id, 'repeated_match' FROM whole_ WHERE ids = 'S2-1 S2-1' UNION ALL SELECT 'error', line, s1_id, 'comma' FROM whole_ WHERE contains(ids, ',')")
def submission_issues(spark, sf_dir):
    return validate.issues(_broken_lines(spark, sf_dir), "studio")


@query(
    f"WITH {_BROKEN} SELECT * FROM both_ UNION ALL SELECT 'error', line, s1_id, 'repeated_match' FROM whole_ WHERE len(list) <> len(list_distinct(list)) "
    "UNION ALL SELECT 'error', line, s1_id, 'foreign_id' FROM whole_ WHERE len(list_filter(list, lambda x: NOT regexp_matches(x, '^S[23]-'))) > 0 UNION ALL SELECT 'error', 0, id, 'missing_s1' FROM s1 WHERE id NOT IN (SELECT s1_id FROM whole_) "
    "UNION ALL SELECT DISTINCT 'error', line, s1_id, 'unknown_id' FROM (SELECT line, s1_id, unnest(list) AS id FROM whole_) ANTI JOIN pool USING (id)"
)
def submission_issues_strict(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    return validate.issues(_broken_lines(spark, sf_dir), "batch", s1, pool)


@query(
    f"WITH {_LISTS}, first_ AS (SELECT 'warning' AS severity, 1 AS line, '' AS s1_id, 'candidate_header' AS rule) SELECT * FROM first_ UNION ALL SELECT 'summary', count(*)::INT, '', 'lines' FROM file_"
)
def candidate_file_issues(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    counted = lines.filter("line > 1").agg(F.count("*").cast("int").alias("line"))
    return validate.candidate_issues(lines).unionByName(counted.select(F.lit("summary").alias("severity"), "line", F.lit("").alias("s1_id"), F.lit("lines").alias("rule")))


_DROPPED = f"top_ AS (SELECT * FROM top WHERE {_mark_sql.format('pool_id', 3)} > 0 AND {_mark_sql.format('s1_id', 7)} > 0)"


@query(
    f"WITH {duck.reranked()}, {duck.TRUTH}, {_DROPPED}, t AS (SELECT DISTINCT s1_id, pool_id FROM truth) SELECT s1.id AS s1_id, NULL::VARCHAR AS pool_id, 'missing_in_candidates' AS rule FROM s1 WHERE id NOT IN (SELECT s1_id FROM top_) "
    "UNION ALL SELECT s1_id, pool_id, 'match_not_candidate' FROM t ANTI JOIN top_ USING (s1_id, pool_id)"
)
def subset_issues(spark, sf_dir):
    """A candidate file that lacks a third of the pool records and a seventh of the S1 records."""
    s1, pool = _sides(spark, sf_dir)
    truth = records.proxy_truth(s1, pool).groupBy("s1_id").agg(F.array_distinct(F.collect_list("pool_id")).alias("ids"))
    lists = s1.select(F.col("id").alias("s1_id")).join(truth, "s1_id", "left").select("s1_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    kept = _top(spark, sf_dir).filter((_mark(F.col("pool_id"), 3) > 0) & (_mark(F.col("s1_id"), 7) > 0))
    return validate.subset_issues(lists, kept.groupBy("s1_id").agg(F.collect_list("pool_id").alias("ids")))


@query(f"WITH {duck.PREPARED}, {duck.TRUTH}, n AS (SELECT s1.id, count(DISTINCT pool_id) AS n FROM s1 LEFT JOIN truth ON s1_id = s1.id GROUP BY 1) SELECT count(*) AS n_s1, count(*) FILTER (n = 0) AS n_singletons, sum(n)::BIGINT AS n_pairs, max(n) AS max_ids, round(avg(n), 2) AS mean_ids FROM n")
def submission_stats(spark, sf_dir):
    parsed = validate.parsed(_lines(spark, sf_dir))
    return validate.statistics(parsed)


# --- profiles ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {duck.RECORDS} SELECT CASE WHEN grouping(country) = 1 THEN 'ALL' WHEN country = '' THEN '(none)' ELSE country END AS country, count(*) FILTER (src = 'S1') AS s1, count(*) FILTER (src = 'S2') AS s2, count(*) FILTER (src = 'S3') AS s3, count(*) AS total FROM records GROUP BY GROUPING SETS ((), (country))")
def rows_by_source(spark, sf_dir):
    return profile.rows_by_country_and_source(records.from_pages(spark, sf_dir))


@query(
    f"WITH {duck.PREPARED}, {duck.TRUTH} SELECT (SELECT count(*) FROM s1 WHERE id NOT IN (SELECT s1_id FROM truth)) AS n_singletons, (SELECT count(*) FROM truth WHERE pool_id NOT IN (SELECT id FROM pool)) AS n_dangling, "
    "(SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM truth GROUP BY s1_id, pool_id)) AS n_repeated, (SELECT count(*) FROM (SELECT pool_id FROM truth GROUP BY 1 HAVING count(DISTINCT s1_id) > 1)) AS n_multi_owner, "
    "count(*) AS n_pairs, count(*) FILTER (starts_with(pool_id, 'S2-')) AS n_s2, count(*) FILTER (starts_with(pool_id, 'S3-')) AS n_s3 FROM truth"
)
def truth_sanity(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    return profile.truth_sanity(s1, pool, records.proxy_truth(s1, pool))


@query(f"WITH {duck.PREPARED}, {duck.TRUTH}, n AS (SELECT s1.id, s1.country, count(pool_id) AS n FROM s1 LEFT JOIN truth ON s1_id = s1.id GROUP BY ALL) SELECT country, n AS n_matches, count(*) AS n_entities FROM n GROUP BY ALL")
def match_histogram(spark, sf_dir):
    return profile.match_histogram(_sides(spark, sf_dir)[0], _truth(spark, sf_dir))


@query(f"WITH {duck.PREPARED}, {duck.TRUTH}, o AS (SELECT s1_id, bool_or(starts_with(pool_id, 'S2-')) AS a, bool_or(starts_with(pool_id, 'S3-')) AS b FROM truth GROUP BY 1) SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'S2' ELSE 'S3' END AS sources, count(*) AS n_entities FROM o GROUP BY 1")
def source_mix(spark, sf_dir):
    return profile.source_mix(_truth(spark, sf_dir))


@query(f"WITH {duck.PREPARED}, {duck.TRUTH} SELECT x.country AS s1_country, y.country AS pool_country, count(*) AS n_pairs FROM truth JOIN s1 x ON x.id = s1_id JOIN pool y ON y.id = pool_id GROUP BY ALL")
def country_agreement(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    return profile.country_agreement(s1, pool, records.proxy_truth(s1, pool))


@query(f"WITH {duck.RECORDS} SELECT src, country, count(*) AS n, round(avg((name = '')::INT), 9) AS empty_name, round(avg((address = '')::INT), 9) AS empty_address FROM records GROUP BY ALL")
def empty_fields(spark, sf_dir):
    return profile.empty_fields(records.from_pages(spark, sf_dir))


@query(f"WITH {duck.RECORDS} SELECT * FROM records ORDER BY {duck.seeded()}, id LIMIT 20")
def record_sample(spark, sf_dir):
    return profile.seeded_sample(records.from_pages(spark, sf_dir))


@query(
    f"WITH {duck.owned()}, c AS (SELECT s1_id, count(*) AS c FROM top GROUP BY 1), m AS (SELECT s1_id, count(*) AS m FROM owned GROUP BY 1) SELECT country, count(*) AS n_entities, round(avg(coalesce(c, 0)), 9) AS mean_candidates, round(avg(coalesce(m, 0)), 9) AS mean_matches, round(avg((coalesce(m, 0) = 0)::INT), 9) AS share_without "
    "FROM s1 LEFT JOIN c ON c.s1_id = s1.id LEFT JOIN m ON m.s1_id = s1.id GROUP BY 1"
)
def prediction_summary(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return profile.prediction_summary(_sides(spark, sf_dir)[0], scored, resolve.matches(scored, CONFIG))


# --- learning ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {duck.PREPARED}, w AS (SELECT country, unnest(list_distinct(name_toks)) AS word FROM prep), t AS (SELECT country, count(*) AS n FROM prep GROUP BY 1) SELECT w.country, word, count(*) AS df, round(count(*) / n::DOUBLE, 9) AS share FROM w JOIN t ON t.country = w.country GROUP BY w.country, word, n HAVING round(count(*) / n::DOUBLE, 9) >= 0.05")
def frequent_words(spark, sf_dir):
    return learn.frequent_words(_prepared(spark, sf_dir))


_only = "list_distinct(list_filter({}, lambda t: NOT list_contains({}, t)))"
_WORDS = f"words_ AS (SELECT s1_id, pool_id, a_country AS country, 'extra' AS kind, unnest({_only.format('b_name_toks', 'a_name_toks')}) AS word FROM pairs UNION ALL SELECT s1_id, pool_id, a_country, 'missing', unnest({_only.format('a_name_toks', 'b_name_toks')}) FROM pairs)"


_SCORES = (
    f"of_fold AS (SELECT kind, word, ({_mark_sql.format('w.s1_id', 5)})::INT AS fold, count(*) AS n, count(t.s1_id) AS hits FROM words_ w LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.s1_id = w.s1_id AND t.pool_id = w.pool_id GROUP BY ALL), "
    "left_out AS (SELECT kind, word, fold, sum(n) OVER (PARTITION BY kind, word) - n AS n, sum(hits) OVER (PARTITION BY kind, word) - hits AS hits FROM of_fold UNION ALL SELECT kind, word, -1, sum(n), sum(hits) FROM of_fold GROUP BY 1, 2)"
)


@query(f"WITH {duck.candidates()}, {duck.TRUTH}, {_WORDS}, {_SCORES} SELECT kind, word, fold, n::BIGINT AS n, round((hits + 2.5) / (n + 5.0), 9) AS score FROM left_out")
def learned_word_scores(spark, sf_dir):
    return learn.word_scores(_pairs(spark, sf_dir), _truth(spark, sf_dir))


_ADDRESS_KEYS = (
    "aw AS (SELECT country, unnest(list_distinct(addr_toks)) AS word FROM prep), af AS (SELECT country, word, count(*) AS df FROM aw GROUP BY ALL), "
    "ak AS (SELECT p.id, word, row_number() OVER (PARTITION BY p.id ORDER BY df, word) AS r FROM (SELECT id, country, unnest(list_distinct(addr_toks)) AS word FROM prep) p JOIN af USING (country, word) WHERE NOT regexp_full_match(word, '[0-9]+')), "
    "akeys AS (SELECT prep.id, CASE WHEN len(numbers) > 0 AND word IS NOT NULL THEN numbers[1] || '_' || word END AS addr_key FROM prep LEFT JOIN ak ON ak.id = prep.id AND r = 1)"
)
_logged = lambda kind, best: f"round(ln(1 + {best}(df) FILTER (kind = '{kind}')), 9) AS {kind}_df_{best}"


@query(
    f"WITH {duck.candidates()}, {duck.TRUTH}, {_WORDS}, {_ADDRESS_KEYS}, n_words AS (SELECT kind, word FROM words_ GROUP BY ALL HAVING count(*) >= 3), held AS (SELECT word, count(*) AS df FROM (SELECT id, unnest(list_distinct(name_toks)) AS word FROM pool) GROUP BY 1), "
    "w AS (SELECT words_.s1_id, words_.pool_id, words_.kind, coalesce(df, 0) AS df, n_words.word IS NULL AS strange FROM words_ LEFT JOIN held ON held.word = words_.word LEFT JOIN n_words ON n_words.word = words_.word AND n_words.kind = words_.kind), "
    f"of_pair AS (SELECT s1_id, pool_id, {', '.join(_logged(k, b) for k in ('extra', 'missing') for b in ('min', 'max'))}, count(*) FILTER (kind = 'extra' AND strange) AS extra_unknown FROM w GROUP BY 1, 2), cores AS (SELECT id, count(*) OVER (PARTITION BY core_text) AS s1_core_n FROM s1) "
    "SELECT p.s1_id, p.pool_id, s1_core_n, extra_df_min, extra_df_max, missing_df_min, missing_df_max, coalesce(extra_unknown, 0) AS extra_unknown, coalesce(x.addr_key = y.addr_key, false)::INT AS same_addr_key "
    "FROM pairs p JOIN cores ON cores.id = p.s1_id JOIN akeys x ON x.id = p.s1_id JOIN akeys y ON y.id = p.pool_id LEFT JOIN of_pair o ON o.s1_id = p.s1_id AND o.pool_id = p.pool_id"
)
def differing_counts(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    known = learn.word_scores(pairs, _truth(spark, sf_dir)).filter("fold = -1 and n >= 3")
    return learn.differing_counts(pairs, *_sides(spark, sf_dir), known)


_LATIN, _INDIC = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x0915, 0x0915 + 26)))


@query(
    f"WITH {duck.PREPARED}, {duck.TRUTH}, named AS (SELECT string_split(x.name_text, ' ') AS a, string_split(translate(y.name_text, '{_LATIN}', '{_INDIC}'), ' ') AS b FROM truth t JOIN s1 x ON x.id = t.s1_id JOIN pool y ON y.id = t.pool_id), "
    "met AS (SELECT unnest(a) AS latin, unnest(b) AS word FROM named WHERE len(a) = len(b)), counted AS (SELECT word, latin, count(*) AS n FROM met WHERE regexp_matches(word, '[\u0900-\u0D7F]') AND regexp_full_match(latin, '[ -~]+') GROUP BY ALL) "
    "SELECT word, latin, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, latin) AS r FROM counted WHERE n >= 2) WHERE r = 1"
)
def learned_dictionary(spark, sf_dir):
    """From true pairs whose pool names are written in Devanagari letters, one letter for each Latin one."""
    s1, pool = _sides(spark, sf_dir)
    left = s1.select(F.col("id").alias("s1_id"), F.col("name_text").alias("left_name"))
    right = pool.select(F.col("id").alias("pool_id"), F.translate("name_text", _LATIN, _INDIC).alias("right_name"))
    return learn.learn_dictionary(_truth(spark, sf_dir).join(left, "s1_id").join(right, "pool_id"))


@query(f"WITH {duck.owned()} SELECT s1_id, pool_id, round(prob, 6) AS prob FROM owned")
def reused_scores(spark, sf_dir):
    """The decision rule applied again to stored probabilities, without candidates or features."""
    stored = store.stored(_scored(spark, sf_dir))
    return resolve.matches(stored, CONFIG).select("s1_id", "pool_id", F.round("prob", 6).alias("prob"))


@query()
def matcher_importances(spark, sf_dir):
    """A tree model trained on the kept pairs and the proxy truth: what each feature weighs in it."""
    columns = ["name_ratio", "name_token_set", "name_jw", "addr_ratio", "skel_ratio", "core_ratio", "num_shared"]
    true = _truth(spark, sf_dir).distinct().withColumn("y", F.lit(1.0))
    rows = _top(spark, sf_dir)
    columns = [c for c in columns if c in rows.columns]
    labelled = rows.join(true, ["s1_id", "pool_id"], "left").select(*[F.col(c).cast("double").alias(c) for c in columns], F.coalesce("y", F.lit(0.0)).alias("y"))
    return learn.importances(learn.train_matcher(store.stored(labelled), columns), columns, spark)


_conflict = "(len(a_numbers) > 0 AND len(b_numbers) > 0 AND a_numbers[1] <> b_numbers[1])::INT"


@query(f"WITH {duck.candidates()}, {_WORDS}, r AS (SELECT w.country, word, {_conflict} AS y FROM words_ w JOIN pairs p ON p.s1_id = w.s1_id AND p.pool_id = w.pool_id WHERE kind = 'extra'), m AS (SELECT country, avg(y) AS mean FROM r GROUP BY 1) SELECT r.country, word, count(*) AS n, round((sum(y) + 5.0::DOUBLE * mean) / (count(*) + 5.0::DOUBLE), 9) AS rate FROM r JOIN m ON m.country = r.country GROUP BY r.country, word, mean")
def sibling_rates(spark, sf_dir):
    return learn.sibling_rates(_pairs(spark, sf_dir))


_elsewhere = lambda short, c: f"(b_{c} <> '' AND EXISTS (SELECT 1 FROM s1 WHERE s1.{c} = p.b_{c} AND s1.id <> p.s1_id))::INT AS cand_{short}_other_s1"


@query(f"WITH {duck.candidates()} SELECT s1_id, pool_id, {_elsewhere('name', 'name_text')}, {_elsewhere('core', 'core_text')}, {_elsewhere('addr', 'addr_text')} FROM pairs p")
def owned_elsewhere(spark, sf_dir):
    s1, pool = _sides(spark, sf_dir)
    return learn.owned_elsewhere(resolve.candidate_pairs(s1, pool), s1)


@query(f"WITH {duck.scored()} SELECT s1_id, pool_id, (prob >= 0.9)::INT AS y FROM scored WHERE prob >= 0.9 OR prob <= 0.1")
def pseudo_labels(spark, sf_dir):
    return learn.pseudo_labels(_scored(spark, sf_dir))


# --- further rows of the inventory -------------------------------------------------------------------------------------------


@query(f"WITH {duck.PREPARED} SELECT id, {duck.clean('name')} AS cleaned, name_text, array_to_string(list_transform(name_toks, lambda t: {duck.skeleton('t')}), ' ') AS skeletons, addr_text FROM prep")
def normalisation_trace(spark, sf_dir):
    skeletons = F.array_join(F.transform("name_toks", lambda t: normalize.skeleton(t)), " ")
    return _prepared(spark, sf_dir).select("id", normalize.clean("name").alias("cleaned"), "name_text", skeletons.alias("skeletons"), "addr_text")


@query(f"WITH {duck.INDEX} SELECT substr(key, 1, 1) AS kind, count(*) AS n_keys, sum(df)::BIGINT AS n_postings, max(df) AS longest FROM df GROUP BY 1")
def key_kinds(spark, sf_dir):
    df = blocking.document_frequency(blocking.exploded_keys(_sides(spark, sf_dir)[1]))
    return df.groupBy(F.substring("key", 1, 1).alias("kind")).agg(F.count("*").alias("n_keys"), F.sum("df").alias("n_postings"), F.max("df").alias("longest"))


_STUDIO = {k: v.replace("round_even(", "round(") for k, v in duck.FEATURES.items() if k.startswith(("name_", "skel_", "core_", "addr_", "block_"))}


@query(
    f"WITH {duck.candidates()} SELECT s1_id, pool_id, {', '.join(f'{v} AS {k}' for k, v in _STUDIO.items())}, round(({_STUDIO['name_token_set']}) - max({_STUDIO['name_token_set']}) OVER (PARTITION BY s1_id), 4) AS name_token_set_vs_best FROM pairs"
)
def pair_features_studio(spark, sf_dir):
    return features.extract(_pairs(spark, sf_dir), "studio", relative_to_best=True).select("s1_id", "pool_id", *_STUDIO, "name_token_set_vs_best")


SLIDER = [round(0.3 + 0.005 * i, 3) for i in range(111)]


def _swept_sql(thresholds: list[float], one_owner: bool) -> str:
    listed = "[" + ", ".join(f"{t}::DOUBLE" for t in thresholds) + "]"
    place = "row_number() OVER (PARTITION BY threshold, pool_id ORDER BY round(prob, 9) DESC, s1_id)" if one_owner else "1"
    return (
        f"WITH {duck.scored()}, {duck.TRUTH}, over_ AS (SELECT s1_id, pool_id, prob, t.threshold FROM scored, (SELECT unnest({listed}) AS threshold) t WHERE round(prob, 9) >= t.threshold), "
        f"won AS (SELECT * FROM (SELECT *, {place} AS place FROM over_) WHERE place = 1), {duck.entity_scores('won', 'threshold', f'(SELECT id AS s1_id, unnest({listed}) AS threshold FROM s1)')} {duck.report('threshold')}"
    )


@query(_swept_sql(SLIDER, True))
def slider_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(_scored(spark, sf_dir), _entities(spark, sf_dir), _truth(spark, sf_dir), SLIDER)


@query(_swept_sql(THRESHOLDS, False))
def threshold_sweep_shared(spark, sf_dir):
    return evaluate.threshold_sweep(_scored(spark, sf_dir), _entities(spark, sf_dir), _truth(spark, sf_dir), THRESHOLDS, one_owner=False)


_SPLIT = f"split_ AS (SELECT id AS s1_id, row_number() OVER (ORDER BY {duck.seeded()}, id) > floor(count(*) OVER () * 0.8) AS validation FROM s1)"


@query(f"WITH {duck.owned()}, {duck.TRUTH}, {_SPLIT}, {duck.entity_scores('owned', '', '(SELECT s1_id FROM split_ WHERE validation)')} {duck.report()}")
def full_competition(spark, sf_dir):
    """Every owner competes; only the validation part is scored."""
    part = evaluate.split(_sides(spark, sf_dir)[0]).filter("part = 'validation'").select(F.col("id").alias("s1_id"))
    return evaluate.report(evaluate.entity_scores(part, resolve.matches(_scored(spark, sf_dir), CONFIG), _truth(spark, sf_dir)))


@query(
    f"WITH {duck.candidates()}, {_WORDS}, r AS (SELECT w.country, word, {_conflict} AS y FROM words_ w JOIN pairs p ON p.s1_id = w.s1_id AND p.pool_id = w.pool_id WHERE kind = 'extra'), m AS (SELECT country, avg(y) AS mean FROM r GROUP BY 1), "
    "rates AS (SELECT r.country, word, round((sum(y) + 5.0::DOUBLE * mean) / (count(*) + 5.0::DOUBLE), 9) AS rate FROM r JOIN m ON m.country = r.country GROUP BY r.country, word, mean) "
    "SELECT s1_id, pool_id, max(rate) AS sib_max, round(avg(rate), 6) AS sib_mean, count(*) FILTER (rate > 0.5) AS sib_n_high FROM words_ w JOIN rates ON rates.country = w.country AND rates.word = w.word WHERE kind = 'extra' GROUP BY ALL"
)
def sibling_features(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    found = learn.sibling_features(pairs, learn.sibling_rates(pairs))
    return found.select("s1_id", "pool_id", "sib_max", F.round("sib_mean", 6).alias("sib_mean"), "sib_n_high")


@query(
    f"WITH {duck.PREPARED}, w AS (SELECT country, unnest(list_distinct(addr_toks)) AS word FROM prep), f AS (SELECT country, word, count(*) AS df FROM w GROUP BY ALL), "
    "k AS (SELECT p.id, word, row_number() OVER (PARTITION BY p.id ORDER BY df, word) AS r FROM (SELECT id, country, unnest(list_distinct(addr_toks)) AS word FROM prep) p JOIN f USING (country, word) WHERE NOT regexp_full_match(word, '[0-9]+')) "
    "SELECT prep.id, CASE WHEN len(numbers) > 0 AND word IS NOT NULL THEN numbers[1] || '_' || word END AS addr_key FROM prep LEFT JOIN k ON k.id = prep.id AND r = 1"
)
def address_keys(spark, sf_dir):
    return learn.address_keys(_prepared(spark, sf_dir))
