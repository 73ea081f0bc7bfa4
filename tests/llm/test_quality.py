import re
from collections import Counter

from fixtures import DOCS, documents, frame
from pyspark.sql import functions as F

from tessera.llm import quality_rules as q

SPACE = "[\x20\x09-\x0d]+"


def slow(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


EXTRA = [
    "a b c d e a b c d e", "a a a a a a", "x\ny\nx\n\n \nx", "one two three four five six one two three four five seven eight nine ten eleven twelve", "# * < > &|%$ 😀é\u2003wide",
    "a b c d e f a b c d e f a b c d e", "\r\x0b\x0c", "same line here\nsame line here\n" * 30,
]


def test_counts(spark):
    rows = documents() + [(500 + i, t, "en", "s", 1) for i, t in enumerate(EXTRA)]
    got = q.judge(frame(spark, rows).withColumn("n_words", F.lit("clash")).withColumn("votes", F.lit(1))).collect()
    assert len(got) == len(rows)
    expected = {r[0]: slow(r[1]) for r in rows}
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected[r["doc_id"]], r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_verdicts(spark):
    good = [(i, r[1], *r[2:]) for i, r in enumerate(documents(300)) if i < 300]
    words = lambda r: r[1].split()
    marked = [(1000 + i, " ".join(w + "%%%" for w in words(r)), "en", "s", 1) for i, r in enumerate(good[:15])]
    loud = [(2000 + i, " ".join(w.upper() + "!!" for w in words(r)), "en", "s", 1) for i, r in enumerate(good[:15])]
    cells = [(3000 + i, " | ".join(words(r)), "en", "s", 1) for i, r in enumerate(good[:15])]
    got = {r["doc_id"]: r for r in q.judge(frame(spark, good + marked + loud + cells)).collect()}
    assert all(got[r[0]]["kept"] for r in good if not got[r[0]]["base_failed"])
    assert not any(got[r[0]]["kept"] for r in marked + loud + cells)


def test_no_python_in_the_plan(spark):
    plan = q.features(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_em_learns_accuracies():
    patterns = [("2" * len(q.RULES), 700), ("0" + "0" + "2" * (len(q.RULES) - 2), 150), ("2" * (len(q.RULES) - 1) + "1", 150)]
    prior, weights = q.fit(patterns)
    assert prior > 0 and weights[0][0] < 0 and weights[1][0] < 0 and weights[-1][1] >= 0
    assert q.fit([]) == q.fit([])


def test_empty(spark):
    assert q.judge(frame(spark, [], DOCS)).collect() == []
