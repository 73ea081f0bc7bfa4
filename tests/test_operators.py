import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import vocab
from tessera.operators import blocking, competition, evaluate, features, learn, scoring, validate
from tessera.plans import resolve
from tessera.sources import benchmark, records, sinks


@pytest.fixture(scope="module")
def bench(spark):
    rows = benchmark.synthetic_records(spark).cache()
    return rows


@pytest.fixture(scope="module")
def sides(bench):
    return resolve.prepared_sides(bench.drop("owner"))


def test_resolve_finds_owners(spark, bench, sides):
    s1, pool = sides
    found = resolve.matches(resolve.scored_pairs(s1, pool))
    truth = bench.filter("owner <> ''").select(F.col("owner").alias("s1_id"), F.col("id").alias("pool_id"))
    report = evaluate.report(evaluate.entity_scores(s1.select(F.col("id").alias("s1_id")), found, truth)).first()
    assert report["n_entities"] == 510 and report["macro_f05"] > 0.9
    assert found.groupBy("pool_id").count().filter("count > 1").isEmpty()


def test_candidate_invariants(sides):
    found = blocking.candidates(*sides, blocking.BlockingConfig(top_k=10)).collect()
    assert all(0 < r["cos"] <= 1 + 1e-9 and 1 <= r["block_rank"] <= 10 for r in found)
    by = {}
    for r in found:
        by.setdefault(r["s1_id"], []).append(r["block_rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_country_wildcard_and_hard_cut(spark):
    rows = [("S1", "S1-1", "acme steel", "", "US"), ("S2", "S2-1", "acme steel", "", ""), ("S2", "S2-2", "acme steel", "", "India"), ("S3", "S3-1", "acme", "", "US")]
    s1, pool = resolve.prepared_sides(spark.createDataFrame(rows, "src string, id string, name string, address string, country string"))
    pairs = lambda **k: {r["pool_id"] for r in blocking.candidates(s1, pool, blocking.BlockingConfig(**k)).collect()}
    assert pairs() == {"S2-1", "S3-1"}
    assert pairs(max_df=2) == {"S2-1"}
    assert pairs(max_df=0, max_df_mode="hard") == set()


def test_idf(spark):
    rows = [("S2", f"S2-{i}", n, "", "US") for i, n in enumerate(("alpha", "beta"))]
    _, pool = resolve.prepared_sides(spark.createDataFrame(rows, "src string, id string, name string, address string, country string"))
    idf = {r["key"]: round(r["idf"], 4) for r in blocking.inverse_frequency(pool, blocking.exploded_keys(pool)).collect()}
    assert idf["n:alpha"] == 1.4055


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [([12], [14, 12], {"primary_conflict": 1, "num_shared": 1}), ([5], [5, 5], {"num_shared": 2, "num_pool_share": 1.0}), ([826], [26], {"num_dropped_digit": 1, "num_min_diff": 800}), ([5], [2000], {"num_min_diff": 0}), ([], [], {"primary_match": 0, "num_pool_share": 0.0, "num_min_diff": 0})],
)
def test_number_features(spark, a, b, expected):
    row = spark.createDataFrame([([str(x) for x in a], [str(x) for x in b])], "a_numbers array<string>, b_numbers array<string>")
    got = row.select(*[c.alias(k) for k, c in (features.number_features() | features.number_differences()).items()]).first().asDict()
    assert {k: got[k] for k in expected} == expected


def test_word_differences(spark):
    row = spark.createDataFrame([(["a"], ["a", "midtown", "foo"]), (["a"], ["a"])], "a_name_toks array<string>, b_name_toks array<string>")
    got = [r.asDict() for r in row.select(*[c.alias(k) for k, c in features.word_differences().items()]).collect()]
    assert (got[0]["extra_min"], round(got[0]["extra_mean"], 4), got[0]["n_extra"]) == (0.01, 0.255, 2)
    assert got[1]["extra_min"] == got[1]["extra_mean"] == 1.0
    assert len(vocab.WORD_SCORES) == 62 and len(vocab.INDIC_WORDS) == 48 and len(vocab.STUDIO_INDIC_WORDS) == 31


def test_competition(spark):
    rows = [("s1", "p", 0.9), ("s1", "q", 0.8), ("s2", "p", 0.9), ("s2", "r", 0.7), ("s3", "q", 0.95)]
    won = {(r["s1_id"], r["pool_id"]) for r in competition.owners(spark.createDataFrame(rows, "s1_id string, pool_id string, prob double")).collect()}
    assert won == {("s1", "p"), ("s2", "r"), ("s3", "q")}


@pytest.mark.parametrize(("p", "t", "expected"), [({"a", "b", "c"}, {"a", "c"}, 0.714), ({"a"}, {"a"}, 1.0), (set(), set(), 1.0), ({"a"}, set(), 0.0), (set(), {"a"}, 0.0)])
def test_f05(spark, p, t, expected):
    pairs = lambda s: spark.createDataFrame([("e", x) for x in s], "s1_id string, pool_id string")
    scores = evaluate.entity_scores(spark.createDataFrame([("e",)], "s1_id string"), pairs(p), pairs(t))
    assert round(scores.first()["f05"], 3) == expected


def test_validation(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("wrong\theader\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-1\tS2-9\nS1-3\tS2-1\textra\nS1-4\tS2-5,S2-5\n")
    rules = lambda dialect: sorted(r["rule"] for r in validate.issues(validate.read_lines(spark, str(path)), dialect).collect())
    assert rules("batch") == ["columns", "duplicate_s1", "header", "repeated_match"]
    assert rules("studio") == ["columns", "comma", "comma", "duplicate_s1", "header"]


def test_round_trip_of_files(spark, tmp_path):
    source = tmp_path / "s1.tsv"
    source.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t "A ""x"" B"\t3172\\1, G\\Ngr\tUS\nS1-2\t"two\tparts"\t\t\n')
    rows = records.with_source(records.standardise(records.read_tsv(spark, str(source)))).collect()
    assert [(r["id"], r["name"], r["address"], r["src"]) for r in rows][1] == ("S1-2", "two\tparts", "", "S1")
    assert rows[0]["address"] == "3172\\1, G\\Ngr"
    s1 = spark.createDataFrame([("S1-2",), ("S1-1",)], "id string")
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1")], "s1_id string, pool_id string")
    sinks.write_results(s1, pairs, str(tmp_path / "out"), pairs)
    written = [line for part in sorted((tmp_path / "out/matching_results.tsv").glob("part-*")) for line in part.read_text().splitlines()]
    assert [w for w in written if not w.startswith("source1")] == ["S1-1\tS2-1,S3-2", "S1-2\t"]
    truth = records.read_truth(spark, str(tmp_path / "out/matching_results.tsv")).collect()
    assert {r["s1_id"]: r["matches"] for r in truth} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}


def test_learning(spark):
    pairs = spark.createDataFrame([("शिव works", "shiv works"), ("शिव mill", "shiv mill"), ("x", "y")], "left_name string, right_name string")
    assert [tuple(r) for r in learn.learn_dictionary(pairs).collect()] == [("शिव", "shiv", 2)]


def test_trainable_matcher(spark, bench, sides):
    s1, pool = sides
    rows = features.extract(resolve.candidate_pairs(s1, pool)).join(bench.filter("owner <> ''").select(F.col("owner").alias("s1_id"), F.col("id").alias("pool_id"), F.lit(1.0).alias("y")), ["s1_id", "pool_id"], "left").fillna(0.0, ["y"])
    columns = ["block_score", "name_token_set", "addr_token_set", "name_jw", "num_shared", "primary_conflict"]
    model = learn.train_matcher(rows.select("y", *columns), columns)
    assert learn.importances(model, columns, spark).count() == 6


def test_sweep_and_labels(spark, bench, sides):
    s1, pool = sides
    scored = resolve.scored_pairs(s1, pool)
    labelled = competition.label_losers(scoring.label(scored))
    assert {r["status"] for r in labelled.select("status").distinct().collect()} <= {"MATCHED", "REJECTED_PROBABILITY", "REJECTED_SIBLING", "REJECTED_COMPETITION"}
    kept = scoring.sweep(scored, scoring.SWEEP)
    assert {r["iteration"] for r in kept.select("iteration").distinct().collect()} == set(range(1, 7))


def test_file_checks(spark, tmp_path):
    assert validate.file_issue(spark, str(tmp_path / "none.tsv")) == "missing"
    (tmp_path / "empty.tsv").write_text("")
    assert validate.file_issue(spark, str(tmp_path / "empty.tsv")) == "empty"
    (tmp_path / "c.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n")
    lines = validate.read_lines(spark, str(tmp_path / "c.tsv"))
    assert validate.file_issue(spark, str(tmp_path / "c.tsv")) is None
    assert validate.summary(validate.candidate_issues(lines)) == (True, ["warning: line 1: : candidate_header"])
    assert validate.summary(validate.issues(lines)) == (True, [])


def test_config_file(tmp_path):
    sinks.write_config(scoring.SWEEP[4], str(tmp_path / "best.json"), macro_f05=0.5)
    written = json.loads((tmp_path / "best.json").read_text())
    assert written["configuration"]["unseen_threshold"] == 0.82 and written["macro_f05"] == 0.5


def test_flattened_pools(spark):
    cases = spark.createDataFrame([("c1", [("S2-1", "a"), ("S3-1", "b")]), ("c2", [])], "id string, pool array<struct<id:string,name:string>>")
    assert sorted(map(tuple, records.flatten_pool(cases).collect())) == [("S2-1", "a"), ("S3-1", "b")]


def test_split_has_exact_sizes(spark):
    parts = {r["part"]: r["count"] for r in evaluate.split(spark.range(1003).selectExpr("cast(id as string) as id")).groupBy("part").count().collect()}
    assert parts == {"train": 802, "validation": 201}


def test_lines_are_numbered_over_parts(spark, tmp_path):
    path = tmp_path / "long.tsv"
    path.write_text("\n".join(f"row {i}" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = validate.read_lines(spark, str(path))
        assert {r["line"]: r["value"] for r in lines.collect()} == {i: f"row {i}" for i in range(1, 5001)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sample_by_country_takes_the_share(spark):
    from tessera.sources import records

    rows = spark.createDataFrame([(f"S1-{i}", "ab"[i % 2] if i else "c") for i in range(1001)], "id string, country string")
    for share in (0.001, 0.1, 0.5, 1.0):
        got = {r["country"]: r["count"] for r in records.sample_by_country(rows, share, buckets=16).groupBy("country").count().collect()}
        assert got == {"a": max(1, int(500 * share)), "b": max(1, int(500 * share)), "c": 1}


def test_scaled_records(spark):
    from tessera.sources import benchmark

    rows = benchmark.scaled_records(spark, 200)
    assert rows.count() == 1000 and rows.select("id").distinct().count() == 1000 and rows.filter("src = 'S1'").count() == 200
