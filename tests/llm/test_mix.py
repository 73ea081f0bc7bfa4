import re
from fractions import Fraction

from fixtures import DOCS, documents, frame
from pyspark.sql import functions as F

from tessera.llm import source_mix as m


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    left, open_, target = Fraction(sum(sizes.values())), set(names), {}
    while True:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > 3 * sizes[n]]
        if not over:
            break
        for n in over:
            target[n] = Fraction(3 * sizes[n])
            left -= target[n]
            open_.remove(n)
    return target | {n: left * weight[n] / sum(weight[x] for x in open_) for n in open_}


def size(text):
    return len([w for w in re.split("[\x20\x09-\x0d]+", text or "") if w])


def test_targets_sizes_and_copies(spark):
    rows = documents(400) + [(900 + i, "tiny text", "en", "a-small", 9) for i in range(3)]
    got = m.mix(frame(spark, rows).withColumn("size", F.lit(1)).withColumn("base", F.lit(2))).collect()
    assert sorted((r["id"] if r["id"] is not None else -1, r["size"]) for r in got) == sorted((r[0] if r[0] is not None else -1, size(r[1])) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    expected = slow_targets(sizes)
    taken, longest = {}, {}
    for r in got:
        assert abs(r["target"] - float(expected[r["source"]])) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
    for name, t in taken.items():
        assert abs(t - float(expected[name])) <= max(longest[name], 0.02 * float(expected[name])), name
    again = m.mix(frame(spark, rows, slices=7)).collect()
    key = lambda r: (str(r["id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rows_repeat_as_planned(spark):
    docs = frame(spark)
    planned = {}
    for r in m.mix(docs).collect():
        planned[r["id"]] = planned.get(r["id"], 0) + r["copies"]
    rows = m.repeat_rows(docs.withColumn("copies", F.lit("clash")))
    assert rows.columns == [*docs.columns, "copies"]
    counted = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counted == {k: v for k, v in planned.items() if v}


def test_no_words_and_empty(spark):
    got = m.mix(frame(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]
    assert m.mix(frame(spark, [], DOCS)).collect() == [] and m.repeat_rows(frame(spark, [], DOCS)).collect() == []


def test_more_salts_keep_the_mix(spark, monkeypatch):
    rows = documents(300)
    monkeypatch.setattr(m, "SALTED", 16)  # hundreds of documents: two digits
    got = m.mix(frame(spark, rows)).collect()
    goal = {r["source"]: r["target"] for r in got}
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in goal}
    longest = max(r["size"] for r in got if r["size"] < 20_000)
    assert all(abs(taken[s] - t) <= max(longest, 30_000 if s == "src3" else 0) for s, t in goal.items()) and len(got) == len(rows)


def test_rows_of_equal_id_and_size_are_told_apart(spark):
    rows = [(1, f"{a} {b} {c}", "en", "s", 1) for a in "ab" for b in "cd" for c in "ef"] + [(2, "x " * 40, "en", "t", 1)]
    run = lambda n: sorted(map(tuple, m.repeat_rows(frame(spark, rows, slices=n)).collect()))
    assert run(1) == run(3) == run(5)
