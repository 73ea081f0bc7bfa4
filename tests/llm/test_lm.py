import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import DOCS, documents, frame
from pyspark.sql import functions as F

from tessera.llm import lbl_lm as m


def words(text):
    return [re.sub("[A-Z]", lambda x: x[0].lower(), w) for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


@pytest.mark.parametrize("common", [150_000, 30])
def test_base_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(m, "COMMON", common)
    rows = documents(80)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, texts = Counter(), 0
    for i, text, *_ in rows:
        if not held(i):
            counts.update(words(text))
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    got = sorted(m.score(frame(spark, rows).withColumn("row", F.lit(1))).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows)
    for r, (i, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        tokens = words(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens) + math.log10((texts + 1) / (n + v + 1))
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (i, held(i), len(tokens) + 1, n)
        assert r["n_known"] == sum(w in counts for w in tokens) + 1 and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0 and math.isfinite(r["score"])


def model_of(texts, n_words):
    counts = np.bincount(np.concatenate(texts), minlength=n_words + m.RARE + 1).astype(float)
    return m.Model(counts)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    n_words = 300
    texts = [np.append(rng.integers(0, n_words + m.RARE, 50), n_words + m.RARE).astype(np.int16) for _ in range(60)]
    model = model_of(texts, n_words)
    model.train(texts, 2, 1, 0.2, 1)
    for context in ([1, 2, 3], [model.end] * 3, [5, model.end, model.end]):
        each = np.array([x for w in range(model.size) for x in (*reversed(context), w)], np.int16)
        log_p = model.log_probabilities(each, np.arange(model.size) * 4 + 3)
        assert abs((10.0**log_p).sum() - 1) < 1e-4


def test_longer_context_than_one_word():
    """The next word is told by the words two and three back only; the one before is noise."""
    rng = np.random.default_rng(3)

    def text():
        a, b = rng.integers(0, 4, 2)
        words = []
        for _ in range(40):
            words += [a, 10 + rng.integers(0, 6), 4 + b, 10 + rng.integers(0, 6), 20 + 4 * a + b]
        return np.array([*words, 40 + m.RARE], np.int16)

    texts = [text() for _ in range(1500)]
    model = model_of(texts, 40)
    model.train(texts[:1300], 6, 1, 0.1, 1)
    entries, at = model.lay_out(texts[1300:])
    told = at[(entries[at] >= 20) & (entries[at] < 36)]
    unigram = np.log10(model.share[entries[told]]).mean()
    log_p = model.log_probabilities(entries, told)
    assert log_p.mean() > unigram + 0.9  # 16 words in 40: one word of context can't tell them apart


def test_averaged_trainers(spark, monkeypatch):
    monkeypatch.setattr(m, "TRAINER_TOKENS", 3000)
    monkeypatch.setattr(m, "BATCH", 64)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{k}" for k in range(30)]) for _ in range(40)), "en", "s", 1) for i in range(400)]
    got = m.score(frame(spark, rows)).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0] * 0.9


def test_context_helps_on_held_out_texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        a = i % 2
        text = " ".join(rng.choice([f"{'ab'[a]}{k}" for k in range(30)]) for _ in range(40))
        rows.append((i, text, "en", "s", 1))
    got = m.score(frame(spark, rows)).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0] * 0.9


def test_empty(spark):
    assert m.score(frame(spark, [], DOCS)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = m.score(frame(spark, [(only, "some words", "en", "s", 1)])).first()
    assert (r["train_tokens"], r["base_score"], r["n_known"]) == (0, 0.0, 0)
