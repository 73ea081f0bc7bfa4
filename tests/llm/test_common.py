from fixtures import frame
from pyspark.sql import functions as F
from test_near_copies import planted, slow_classes

from tessera.llm import common, packing, pii_sanitize
from tessera.llm import simhash_dedup as s


def test_sift_parts_rows_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(common, "SIFT_BITS", 1 << 12)
    rows = spark.range(5000).select(F.expr("shiftleft(id, 40) - 7").alias("row"), F.lit("x").alias("word"))
    keys = rows.filter("pmod(row, 50) = 9").select("row")
    out, maybe = common.sift(rows, keys, "row")
    assert out.columns == maybe.columns == ["row", "word"]
    a, b, k = ({r["row"] for r in x.select("row").collect()} for x in (out, maybe, keys))
    assert k <= b and not a & b and len(a) + len(b) == 5000 and len(k) <= len(b) < 5000
    none, _ = common.sift(rows, keys.limit(0), "row")
    assert none.count() == 5000


def test_sifted_texts_are_joined_exactly(spark, monkeypatch):
    monkeypatch.setattr(common, "SIFT_BITS", 64)  # nearly every row may be among the keys
    rows = planted(originals=8)
    assert sorted(r["doc_id"] for r in s.keep_one(frame(spark, rows)).collect()) == sorted(slow_classes(rows))


def test_texts_that_stay_are_not_shuffled(spark):
    kept = s.keep_one(frame(spark, planted(originals=8)))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "shiftleft" in plan


def test_a_worker_remembers_for_one_operator():
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    first = packing.word_tokenizer(path)
    first.encode(["some words here"])
    assert packing.word_tokenizer(path) is first
    list(pii_sanitize._count_terms(b"", None)(iter([])))
    assert packing.word_tokenizer(path) is not first
