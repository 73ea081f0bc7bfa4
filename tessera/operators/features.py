"""Pair features: one projection over candidates joined to both prepared records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import vocab

PREPARED = ("name", "name_toks", "name_text", "addr_text", "skel_text", "core_text", "numbers", "country")


def paired(candidates: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """candidates with a_* columns of the S1 record and b_* columns of the pool record."""
    side = lambda p, df, key: df.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in PREPARED])
    return candidates.join(side("a", s1, "s1_id"), "s1_id").join(side("b", pool, "pool_id"), "pool_id")


def rounded(c: Column, dialect: str = "batch") -> Column:
    """Four digits; half to even in the batch dialect, half up in the studio's."""
    return (F.bround if dialect == "batch" else F.round)(c, 4)


def name_similarities(jaro_winkler: bool = True) -> dict[str, Column]:
    a, b = F.col("a_name_text"), F.col("b_name_text")
    found = {
        "name_ratio": sim.ratio(a, b),
        "name_token_set": sim.token_set(a, b),
        "name_token_sort": sim.token_sort(a, b),
        "name_partial": sim.partial(a, b),
        "name_nospace_ratio": sim.no_space(a, b),
        "skel_ratio": sim.ratio(F.col("a_skel_text"), F.col("b_skel_text")),
        "skel_token_set": sim.token_set(F.col("a_skel_text"), F.col("b_skel_text")),
        "core_ratio": sim.ratio(F.col("a_core_text"), F.col("b_core_text")),
        "core_token_set": sim.token_set(F.col("a_core_text"), F.col("b_core_text")),
    }
    return found | ({"name_jw": sim.jaro_winkler(a, b)} if jaro_winkler else {})


def address_similarities() -> dict[str, Column]:
    a, b = F.col("a_addr_text"), F.col("b_addr_text")
    missing = (a == "") | (b == "")
    either = lambda c: F.when(missing, 0.0).otherwise(c)
    return {"addr_ratio": either(sim.ratio(a, b)), "addr_token_set": either(sim.token_set(a, b)), "addr_partial": either(sim.partial(a, b))}


def number_features() -> dict[str, Column]:
    """Overlap of house numbers; repeats in the pool record count."""
    a, b = F.col("a_numbers"), F.col("b_numbers")
    shared = F.size(F.filter(b, lambda x: F.array_contains(a, x)))
    first_a, first_b = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    both = first_a.isNotNull() & first_b.isNotNull()
    return {
        "num_shared": shared,
        "num_s1": F.size(a),
        "num_pool": F.size(b),
        "num_pool_share": F.when(F.size(b) > 0, shared / F.size(b)).otherwise(0.0),
        "primary_conflict": (both & (first_a != first_b)).cast("int"),
        "primary_match": (both & (first_a == first_b)).cast("int"),
    }


_EXACT = {"num_shared", "num_s1", "num_pool", "primary_conflict", "primary_match"}


def extract(pairs: DataFrame, dialect: str = "batch", relative_to_best: bool = False) -> DataFrame:
    """pairs with the 28 features; relative_to_best: *_vs_best against the record's best candidate instead of 1.0."""
    # the UDF comes first and alone, so that the rest stays one code-generated projection
    jw = pairs.withColumn("name_jw_", sim.jaro_winkler(F.col("a_name_text"), F.col("b_name_text")))
    columns = name_similarities(jaro_winkler=False) | {"name_jw": F.col("name_jw_")} | address_similarities() | number_features()
    with_similarities = jw.select(
        *[c for c in pairs.columns],
        rounded(F.col("cos"), dialect).alias("block_score"),
        rounded(F.when(F.col("best_cos") > 0, F.col("cos") / F.col("best_cos")).otherwise(1.0), dialect).alias("block_score_rel"),
        *[(c if k in _EXACT else rounded(c, dialect)).alias(k) for k, c in columns.items()],
        F.size("a_name_toks").alias("name_words_s1"),
        F.size("b_name_toks").alias("name_words_pool"),
        (F.col("b_addr_text") == "").cast("int").alias("pool_addr_empty"),
        F.col("pool_id").startswith("S3-").cast("int").alias("is_s3"),
    )
    of_record = Window.partitionBy("s1_id")
    best = lambda c: F.max(c).over(of_record) if relative_to_best else F.lit(1.0)
    for c in ("name_token_set", "addr_token_set"):
        with_similarities = with_similarities.withColumn(f"{c}_vs_best", rounded(F.col(c) - best(c), dialect))
    return with_similarities


def word_score(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.WORD_SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, word), F.lit(vocab.NEUTRAL_SCORE))


def word_differences() -> dict[str, Column]:
    """Words of one name that the other lacks, and what their scores say."""
    a, b = F.col("a_name_toks"), F.col("b_name_toks")
    out: dict[str, Column] = {}
    only = lambda here, there: F.filter(here, lambda t: ~F.array_contains(there, t))
    for kind, words in (("extra", only(b, a)), ("missing", only(a, b))):
        scores = F.transform(words, word_score)
        total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
        out[f"{kind}_min"] = F.coalesce(F.array_min(scores), F.lit(1.0))
        out[f"{kind}_mean"] = F.when(F.size(words) > 0, total / F.size(words)).otherwise(1.0)
        out[f"n_{kind}"] = F.size(words)
    return out


def number_differences() -> dict[str, Column]:
    """Whether one number contains another, and the least difference (0 for none, or for 999 and more)."""
    a, b = F.col("a_numbers"), F.col("b_numbers")
    dropped = F.exists(a, lambda x: F.exists(b, lambda y: x.contains(y) | y.contains(x)))
    big = lambda x: x.cast("decimal(38,0)")
    gaps = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(big(x) - big(y)))))
    least = F.coalesce(F.array_min(gaps), F.lit(999))
    return {"num_dropped_digit": dropped.cast("int"), "num_min_diff": F.when(least >= 999, 0).otherwise(least).cast("long")}


def cluster_features(pairs: DataFrame) -> DataFrame:
    """(s1_id, pool_id, clu_name_max, clu_addr_max, clu_n_similar): a candidate against the record's other candidates."""
    mine = pairs.select("s1_id", "pool_id", "b_name_text", "b_addr_text")
    other = mine.toDF("s1_id", "other_id", "o_name", "o_addr")
    joined = mine.join(other, "s1_id").filter(F.col("pool_id") != F.col("other_id"))
    name, addr = sim.ratio(F.col("b_name_text"), F.col("o_name")), sim.ratio(F.col("b_addr_text"), F.col("o_addr"))
    stats = joined.select("s1_id", "pool_id", name.alias("n"), addr.alias("a")).groupBy("s1_id", "pool_id").agg(
        F.max("n").alias("clu_name_max"), F.max("a").alias("clu_addr_max"), F.sum(F.when(F.col("n") >= 0.85, 1).otherwise(0)).cast("int").alias("clu_n_similar")
    )
    filled = mine.select("s1_id", "pool_id").join(stats, ["s1_id", "pool_id"], "left")
    return filled.select("s1_id", "pool_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("clu_name_max", "clu_addr_max", "clu_n_similar")])


def shared_counts(records: DataFrame) -> DataFrame:
    """(id, name_n, addr_n): how many records of a table have the same name and the same address."""
    count = lambda c, n: records.groupBy(c).agg(F.count("*").alias(n))
    texts = records.select("id", "name_text", "addr_text")
    return texts.join(count("name_text", "name_n"), "name_text").join(count("addr_text", "addr_n"), "addr_text").select("id", "name_n", "addr_n")


def format_features() -> dict[str, Column]:
    """How the two raw names are written."""
    a, b = F.col("a_name"), F.col("b_name")
    style = F.when(b == F.lower(b), 0).when(b == F.upper(b), 1).when(b == F.initcap(b), 2).otherwise(3)
    return {
        "name_len_diff": F.length(b) - F.length(a),
        "raw_equal": (a == b).cast("int"),
        "raw_equal_nocase": (F.lower(a) == F.lower(b)).cast("int"),
        "cand_style": style,
        "cand_accent": b.rlike(r"[^\x00-\x7F]").cast("int"),
        "cand_symbols": F.length(F.regexp_replace(b, r"[A-Za-z0-9 ]", "")),
    }


def match_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """pairs with the features of extract() and the word, number, cluster, count and format features."""
    base = extract(pairs)
    extra = word_differences() | number_differences() | format_features()
    wide = base.select("*", *[(F.bround(c, 4) if k.endswith("_mean") else c).alias(k) for k, c in extra.items()])
    a, b = (shared_counts(t).toDF(key, f"{p}_name_n", f"{p}_addr_n") for t, key, p in ((s1, "s1_id", "s1"), (pool, "pool_id", "pool")))
    return wide.join(cluster_features(pairs), ["s1_id", "pool_id"]).join(a, "s1_id").join(b, "pool_id")
