import random

from fixtures import frame

from tessera.llm import simhash_dedup as s


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted(seed=9, originals=60):
    """Texts and near copies of them with some words replaced, at similarities on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for _ in range(originals):
        base = [word() for _ in range(rng.randint(60, 400))]
        rows.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]


def slow_classes(rows):
    sets, label = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {rows[x][0] for x in label}


def test_planted_near_copies(spark):
    rows = planted()
    kept = {r["doc_id"] for r in s.keep_one(frame(spark, rows)).collect()}
    expected = slow_classes(rows)
    assert len(expected) < len(rows) * 2 // 3
    assert kept == expected


def test_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(s, "CELL", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(70):
        copy = list(base)
        for at in rng.sample(range(200), 1 + i % 4):
            copy[at] = f"x{i}y{at}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    assert {r["doc_id"] for r in s.keep_one(frame(spark, rows)).collect()} == slow_classes(rows)
