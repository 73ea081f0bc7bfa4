"""Document quality by weak supervision over hand-made rules.

Every rule votes bad (0), good (1) or abstains. Expectation-maximisation over
the counts of vote patterns estimates how often each vote is cast on good and on
bad documents, and so each rule's accuracy; a document is kept when its
posterior probability of being good reaches KEEP. No rule alone decides.

All features are column expressions on the row itself, so the only shuffle is
the count of vote patterns (at most 3 to the number of rules, whatever the
input). EM runs on that bounded table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

WINDOW = 5
BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP = 0.5
ROUNDS = 25
#: Prior beliefs that EM starts from, and their weight in documents per document.
PRIOR_GOOD = 0.85
PRIOR_BAD_VOTE = (0.40, 0.02)  # a bad vote on a bad, on a good document
PRIOR_GOOD_VOTE = (0.35, 0.60)  # a good vote on a bad, on a good document
PRIOR_WEIGHT = 0.25

#: A rule: name, numerator, denominator, "votes bad above" and "votes good at or below" (None: never votes so).
RULES = (
    ("symbols", "n_symbols", "n_words", 0.10, None),
    ("marked_words", "n_marked", "n_words", 0.20, 0.02),
    ("capitals", "n_upper", "n_letters", 0.40, None),
    ("exclaims", "n_exclaims", "n_words", 0.30, 0.05),
    ("repeats", "n_repeat_words", "n_words", 0.20, 0.05),
    ("same_words", "n_same", "n_words", 0.85, None),
    ("dup_lines", "n_dup_lines", "n_lines", 0.30, None),
    ("no_letters", "n_bare", "n_words", 0.25, 0.05),
)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def repeat_words(found: Column) -> Column:
    """How many words of the array stand in a window of WINDOW words that the array holds twice or more."""

    def shifted(a: Column, b: Column, by: int) -> Column:
        n = F.greatest(F.size(b) - by, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), lambda x, y: F.xxhash64(x, y))

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))

        def places(s: Column) -> Column:
            return F.array_sort(F.transform(F.filter(s, lambda x, j: _same(s, x, j)), lambda x: x["p"]))

        def total(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda t, x: t + x) + WINDOW

        return let(let(placed, places), total)

    def windows(h: Column) -> Column:
        pairs = lambda two: let(shifted(two, two, 2), lambda four: shifted(four, h, 4))
        return let(shifted(h, h, 1), pairs)

    distinct = lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k))
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(F.size(found) > WINDOW, let(let(hashed, windows), distinct)).otherwise(F.lit(0)).cast("long")


def _same(s: Column, x: Column, j: Column) -> Column:
    """Whether x, at place j of s, has the key of either neighbour."""
    before = F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
    after = F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
    return before | after


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each row's whole text; all 0 for null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    worded = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_same"),
            repeat_words(w).alias("n_repeat_words"),
        )

    lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    counted = rows.select(
        "doc_id",
        let(words(F.col("text")), of_words).alias("w"),
        let(worded, lines).alias("l"),
        count(SYMBOLS).alias("n_symbols"),
        count(r"[#*$%&|<>=_^~][\x20\x09-\x0D]").alias("n_marked"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\p{L}").alias("n_letters"),
        count("!").alias("n_exclaims"),
        count(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])").alias("n_bare"),
    )
    return counted.select("doc_id", "w.*", "l.*", "n_symbols", "n_marked", "n_upper", "n_letters", "n_exclaims", "n_bare")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vote(rule: tuple) -> Column:
    """0 for bad, 1 for good, 2 for none."""
    _, top, under, bad, good = rule
    share = F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))
    voted = F.when(share > bad, 0)
    if good is not None:
        voted = voted.when((share <= good) & (F.col("n_words") >= MIN_WORDS), 1)
    return voted.otherwise(2).cast("int")


def fit(patterns: list[tuple[str, int]]) -> tuple[float, list[tuple[float, float]]]:
    """EM over (vote pattern, documents): the prior log-odds of good, and each rule's log-odds of a bad and a good vote."""
    total = sum(n for _, n in patterns)
    if not total:
        total, patterns = 1, []
    weight = PRIOR_WEIGHT * total
    good = PRIOR_GOOD
    rate = {(j, v): p for j in range(len(RULES)) for v, p in ((0, PRIOR_BAD_VOTE), (1, PRIOR_GOOD_VOTE))}

    def odds(pattern: str) -> float:
        z = math.log(good / (1 - good))
        for j, v in enumerate(pattern):
            if v != "2":
                on_bad, on_good = rate[j, int(v)]
                z += math.log(on_good / on_bad)
        return z

    for _ in range(ROUNDS if patterns else 0):
        post = [(p, n, 1 / (1 + math.exp(-odds(p)))) for p, n in patterns]
        n_good = sum(n * q for _, n, q in post)
        n_bad = total - n_good
        new = {}
        for (j, v), (on_bad, on_good) in rate.items():
            prior_bad, prior_good = PRIOR_BAD_VOTE if v == 0 else PRIOR_GOOD_VOTE
            cast = [(n, q) for p, n, q in post if p[j] == str(v)]
            bad_share = (sum(n * (1 - q) for n, q in cast) + weight * prior_bad) / (n_bad + weight)
            good_share = (sum(n * q for n, q in cast) + weight * prior_good) / (n_good + weight)
            # a vote may turn out uninformative, but never means its opposite
            good_share = min(good_share, bad_share) if v == 0 else max(good_share, bad_share)
            new[j, v] = (bad_share, good_share)
        rate = new
        good = (n_good + weight * PRIOR_GOOD) / (total + weight)
    prior = math.log(good / (1 - good))
    return prior, [tuple(math.log(rate[j, v][1] / rate[j, v][0]) for v in (0, 1)) for j in range(len(RULES))]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: its counts, base_failed, p_good and kept.

    Null and empty texts have no words and fail the base rules; null ids and
    repeated rows keep their rows; very long texts are counted whole; an empty
    table gives an empty result; other columns are ignored.
    """
    votes = F.concat(*[vote(r).cast("string") for r in RULES])
    counted, _ = common.materialize(features(docs, id_col, text_col).withColumn("votes", votes))
    patterns = counted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3 ** len(RULES) rows
    prior, weights = fit([(r["votes"], r["n"]) for r in patterns])
    z = F.lit(prior)
    for j, (bad, good) in enumerate(weights):
        v = F.substring("votes", j + 1, 1)
        z += F.when(v == "0", F.lit(bad)).when(v == "1", F.lit(good)).otherwise(F.lit(0.0))
    p_good = 1 / (1 + F.exp(-z))
    judged = counted.withColumn("base_failed", base_failed()).withColumn("p_good", p_good)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))
