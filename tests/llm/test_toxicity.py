import random

import numpy as np
from fixtures import DOCS, documents, frame
from pyspark.sql import functions as F

from tessera.llm import toxicity as t

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("ba ce di fo gu la me".split(), k=rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = rng.choices(plain, k=rng.randint(10, 200))
        for k in range(0, len(words), 25) if toxic else ():
            words[k] = rng.choice(["idiot", "Scum,", "zorgl" + rng.choice("abcd"), "zorgl" + rng.choice("efgh") + "ta"])
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = corpus()
    more = [(10_000 + (r[0] if r[0] is not None else 500) if r[0] is not None else None, *r[1:]) for r in documents()]
    got = t.classify(frame(spark, docs + more).withColumn("score", F.lit("clash")), spark.createDataFrame(labels + [(3, 1, 0), (None, 1, 1), (5, None, None), (10_001, 1, 7)], LABELS)).collect()
    assert len(got) == len(docs) + len(more)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert not any(r["predicted"] for r in got if r["doc_id"] is None or r["doc_id"] >= 10_000)


def test_labels_of_held_out_rows_are_never_used(spark):
    import zlib

    docs, labels = corpus(300)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    score = lambda ls: {r["doc_id"]: r["score"] for r in t.classify(frame(spark, docs), spark.createDataFrame(ls, LABELS)).collect()}
    assert score(labels) == score(flipped)


def test_correlated_voters_count_once():
    """Six voters that copy a poor one do not outvote three independent ones; a quarter of the labels is wrong."""
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    voter = lambda hit, false: np.where(rng.random(6000) < np.where(y, hit, false), 1, 0)
    poor = voter(0.3, 0.12)
    copies = [np.where(rng.random(6000) < 0.03, 1 - poor, poor) for _ in range(6)]
    votes = np.stack([*copies, *(voter(0.75, 0.02) for _ in range(3))], axis=1)
    post, rates, of = t.label_model(votes, 0.2, np.where(rng.random(6000) < 0.25, ~y, y))
    assert np.abs(rates[0, 6:] - 0.75).max() < 0.08 and np.abs(rates[1, 6:] - 0.02).max() < 0.03
    assert ((post > 0.5) == y).mean() > 0.95 and abs(post.mean() - 0.2) < 0.01


def test_repeated_voters_are_one_clique():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    voter = lambda: np.where(rng.random(4000) < np.where(y, 0.6, 0.05), 1, 0)
    same = voter()
    one = t.label_model(np.stack([same, voter(), voter()], axis=1), 0.3, y)[0]
    rng = np.random.default_rng(1)
    y, same = rng.random(4000) < 0.3, voter()
    post, _, of = t.label_model(np.stack([same, same, same, voter(), voter()], axis=1), 0.3, y)
    assert ((post > 0.5) == (one > 0.5)).mean() > 0.97


def test_label_model_does_not_follow_the_label(spark):
    """One label in eight is wrong, of the toxic one in four: the posteriors follow the votes, so the classifier finds the truth."""
    docs, labels = corpus(900)
    truth = {i: y for i, _, y in labels}
    wrong = [(i, q, (1 - y) if i % 24 in (0, 3, 9) else y) for i, q, y in labels]
    assert sum(a != b for a, b in zip(labels, wrong)) > 100
    got = t.classify(frame(spark, docs), spark.createDataFrame(wrong, LABELS)).collect()
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97


def test_without_labels_and_empty(spark):
    no_labels = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in t.classify(frame(spark), no_labels).collect()} == {0}
    assert t.classify(frame(spark, [], DOCS), no_labels).collect() == []
    assert t.keep_clean(frame(spark, [], DOCS), no_labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]
