"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. The voters are stated lexicons, shape patterns, and word and word-stem
   patterns that labelled rows propose: those that toxic rows of a bounded sample
   hold more often. A voter votes toxic or abstains. The recorded label is not a
   voter.
2. A generative model learns from the votes alone, by expectation-maximisation.
   Either class is a mixture of kinds of rows (languages, manners), in which
   voters fire together or exclude each other. Votes that still go together given
   the kind are correlated: their residual correlations, estimated anew in every
   round, join voters to cliques. A clique has one distribution of its number of
   votes for each kind, so what its voters share counts once; cliques are
   independent given the kind. The voters' accuracies are their rates of votes on
   either class. Labels only calibrate:
   they are where the iteration starts, and their share of toxic rows is the mean
   of the posteriors; a row's own label has no say in its posterior.
3. A logistic regression on the density of the mined patterns is trained on the
   posterior labels. Its weights, a dictionary of at most MINED patterns, score
   every text in one pass without a shuffle.

The sample is bounded by FIT_TOXIC and FIT_CLEAN rows; of each, the driver gets
the numbers of the patterns it matches and how often, 12 bytes a pattern, and at
most MINED patterns. Scoring covers all rows and uses nothing but the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Labelled rows to learn from, at most.
FIT_TOXIC, FIT_CLEAN = 4000, 8000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
STEMS = (4, 5, 6, 7)
MINED = 3000
MIN_SUPPORT = 3
PATTERN_VOTERS = 120
#: How many times likelier in toxic rows a pattern must be to become a voter.
VOTER_LIFT = 10.0
#: Voters whose votes are correlated at least so much, given the kind of row, are of one clique.
CORRELATED = 0.5
#: Kinds of toxic and of clean rows, such as languages or manners, in which a voter fires more or less often.
TOXIC_KINDS, CLEAN_KINDS = 12, 1
#: Rows that each kind borrows from the whole.
SMOOTHING = 2.0
#: A clique's votes are told apart up to so many.
MOST_VOTES = 3
#: Words for which about one hit is expected in a toxic text.
SPREAD = 60.0
MOST_HITS = 3.0
ROUNDS = 30
CACHED_WORDS = 200_000

# fixed values: words that insult, by language
LEXICONS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile cretin jerk bastard bitch asshole whore slut vermin filth retard",
    "de": "idiot trottel dummkopf arschloch schlampe abschaum versager wichser hurensohn vollidiot drecksau spinner ekelhaft widerlich missgeburt",
    "fr": "idiot imbécile crétin connard connasse salaud salope ordure abruti débile minable dégueulasse pute racaille raté",
    "es": "idiota imbécil estúpido cretino cabrón puta basura escoria asqueroso inútil gilipollas payaso perdedor maricón subnormal",
}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def patterns_of(word: str) -> tuple[str, ...]:
    """The patterns that a word matches: its letters as a whole (=), and its stems (^)."""
    core = "".join(filter(str.isalpha, word))
    if not core:
        return ()
    return ("=" + core, *("^" + core[:n] for n in STEMS if len(core) > n))


def _hits(text: str, wanted: dict[str, int], known: dict[str, tuple[int, ...]]) -> tuple[dict[int, int], int]:
    """How often each wanted pattern occurs in text, and the number of words."""
    words = text.lower().split()
    hits: dict[int, int] = {}
    if len(known) > CACHED_WORDS:
        known.clear()
    for word, n in Counter(words).items():
        at = known.get(word)
        if at is None:
            at = known[word] = tuple(wanted[p] for p in patterns_of(word) if p in wanted)
        for p in at:
            hits[p] = hits.get(p, 0) + n
    return hits, len(words)


def density(hits: int, words: int) -> float:
    return min(MOST_HITS, hits / (1 + words / SPREAD))


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.remembered("toxicity")
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = {p for w in set((text or "").lower().split()) for p in patterns_of(w)}
            (toxic if label else clean).update(found)
    names = sorted(toxic)
    for at in range(0, len(names), 10_000):
        part = names[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[p] for p in part], pa.int64()), pa.array([clean[p] for p in part], pa.int64())], ["pattern", "toxic", "clean"])
    rest = [p for p in clean if p not in toxic]
    for at in range(0, len(rest), 10_000):
        part = rest[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([0] * len(part), pa.int64()), pa.array([clean[p] for p in part], pa.int64())], ["pattern", "toxic", "clean"])


def _shapes(text: str, words: int) -> list[int]:
    """1 where a shape pattern votes toxic: many exclamations, mostly capitals."""
    letters = sum(map(str.isalpha, text)) or 1
    return [int(text.count("!") > 0.2 * words), int(sum(map(str.isupper, text)) > 0.5 * letters)]


def _describe(wanted: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembered("toxicity")
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            at, n, size, shape = [], [], [], []
            for text in (x or "" for x in batch.column(0).to_pylist()):
                hits, words = _hits(text, wanted, known)
                at.append(list(hits))
                n.append(list(hits.values()))
                size.append(words)
                shape.append(_shapes(text, words))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, lists), pa.array(n, lists), pa.array(size, pa.int32()), pa.array(shape, lists)], ["label", "at", "n", "words", "shapes"])

    return run


def _cliques(shared: np.ndarray) -> np.ndarray:
    """The smallest voter that each voter is joined with by correlations of CORRELATED or more."""
    of = np.arange(len(shared))
    joined = shared >= CORRELATED
    while True:
        least = np.minimum(of, np.where(joined, of[None, :], len(of)).min(1, initial=len(of)))
        if (least == of).all():
            return of
        of = least


def _kinds(votes: np.ndarray, most: int) -> np.ndarray:
    """Rows x kinds of 0 and 1: rows grouped by their votes, by k-means from far-apart rows."""
    centres = votes.mean(0, keepdims=True)
    for _ in range(most - 1):
        far = ((votes[:, None] - centres[None]) ** 2).sum(2).min(1)
        if not len(far) or far.max() < 1e-9:
            break
        centres = np.concatenate([centres, votes[[far.argmax()]]])
    for _ in range(10):
        of = ((votes[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        member = (of[:, None] == np.arange(len(centres))).astype(float)
        centres = (member.T @ votes + 1e-3 * centres) / (member.sum(0)[:, None] + 1e-3)
    return member


def label_model(votes: np.ndarray, prior: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row, the voters' rates of votes (on toxic, on clean rows), and their cliques.

    votes: rows x voters of 1 (toxic) and 0 (abstains); prior: the share of toxic rows, which the posteriors keep to;
    start: the rows' recorded classes, where the iteration begins.
    """
    votes = votes.astype(np.float64)
    rows = len(votes)

    def calibrated(odds: np.ndarray) -> np.ndarray:
        low, high = -60.0, 60.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if (1 / (1 + np.exp(-np.clip(odds + middle, -50, 50)))).mean() < prior else (low, middle)
        return 1 / (1 + np.exp(-np.clip(odds + low, -50, 50)))

    # kinds of toxic rows, then kinds of clean rows
    kinds = [_kinds(votes[start == y], most) for y, most in ((1, TOXIC_KINDS), (0, CLEAN_KINDS))]
    n_toxic = kinds[0].shape[1]
    share = np.zeros((rows, n_toxic + kinds[1].shape[1]))
    share[np.ix_(start == 1, range(n_toxic))] = kinds[0]
    share[np.ix_(start == 0, range(n_toxic, share.shape[1]))] = kinds[1]
    post, of = start.astype(np.float64), np.arange(votes.shape[1])
    for _ in range(ROUNDS):
        size = share.sum(0) + 1e-9
        # what voters still share given the kind
        left = votes - share @ (share.T @ votes / size[:, None])
        scale = np.sqrt((left**2).sum(0)) + 1e-9
        of = _cliques(left.T @ left / np.outer(scale, scale))
        log_p = np.tile(np.log(size / rows), (rows, 1))
        for clique in np.unique(of):
            n = np.minimum(votes[:, of == clique].sum(1), MOST_VOTES).astype(int)
            told = np.stack([np.bincount(n, w, MOST_VOTES + 1) for w in share.T])
            overall = told.sum(0) / rows
            p = (told + SMOOTHING * (overall + 1e-6)) / (size[:, None] + SMOOTHING)
            log_p += np.log(p)[:, n].T
        top = log_p.max(1, keepdims=True)
        of_kind = np.exp(log_p - top) + 1e-300
        toxic, clean = of_kind[:, :n_toxic], of_kind[:, n_toxic:]
        new = calibrated(np.log(toxic.sum(1)) - np.log(clean.sum(1)))
        share = np.concatenate([new[:, None] * toxic / toxic.sum(1, keepdims=True), (1 - new)[:, None] * clean / clean.sum(1, keepdims=True)], axis=1)
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < 1e-6:
            break
    of_class = np.stack([post, 1 - post])
    return post, of_class @ votes / (of_class.sum(1, keepdims=True) + 1e-9), of


def _logistic(row: np.ndarray, at: np.ndarray, x: np.ndarray, target: np.ndarray, sample_weight: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Logistic regression on sparse rows by Adam, with a little ridge."""
    w, bias = np.zeros(size), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    total = sample_weight.sum()
    for step in range(1, 401):
        z = bias + np.bincount(row, x * w[at], len(target))
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * sample_weight / total
        g = np.append(np.bincount(at, x * miss[row], size) + 2e-5 * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return float(bias), w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[float, dict[str, float]]:
    """(bias, a weight for each pattern), learned from the labelled rows of docs that are not held out."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    known = known.filter(~held_out(F.col("id")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return math.log(0.1 / 0.9), {}
    order = F.xxhash64("id")
    chosen = known.filter("label = 1").orderBy(order, "id").limit(FIT_TOXIC).unionByName(known.filter("label = 0").orderBy(order, "id").limit(FIT_CLEAN))
    picked = chosen.collect()  # FIT_TOXIC + FIT_CLEAN rows at most
    bounded = spark.createDataFrame([tuple(r) for r in picked], "id long, label int")
    sample = docs.join(F.broadcast(bounded), F.col(id_col).cast("long") == bounded["id"]).select(F.col(text_col).alias("text"), "label")
    sample, path = common.materialize(sample)

    stated = {"=" + w: lang for lang, words in LEXICONS.items() for w in words.split()}
    mined = sample.mapInArrow(_mine, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    n1, n0 = (sum(r["label"] == y for r in picked) for y in (1, 0))
    t, c = (F.col("t") + 0.05) / (n1 + 1), (F.col("c") + 0.05) / (n0 + 1)
    strength = F.log(t / c) * (F.col("t") / max(n1, 1) - F.col("c") / max(n0, 1))
    best = mined.filter((F.col("t") >= MIN_SUPPORT) & (t > 2 * c)).select("pattern", "t", "c", strength.alias("strength"))
    top = best.orderBy(F.desc("strength"), "pattern").limit(MINED).collect()
    names = list(dict.fromkeys([r["pattern"] for r in top] + sorted(stated)))
    wanted = {p: i for i, p in enumerate(names)}

    rows = sample.mapInArrow(_describe(wanted), "label int, at array<int>, n array<int>, words int, shapes array<int>").collect()
    common.discard(spark, path)
    rows.sort(key=lambda r: (r["label"], r["words"], r["at"], r["n"]))
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([a for r in rows for a in r["at"]], np.int64)
    x = np.array([density(n, r["words"]) for r in rows for n in r["n"]], np.float64)
    gold = np.array([r["label"] for r in rows])

    lifted = [r["pattern"] for r in top if (r["t"] + 0.05) / (n1 + 1) > VOTER_LIFT * (r["c"] + 0.05) / (n0 + 1)]
    voters = [wanted[p] for p in lifted[:PATTERN_VOTERS]]
    votes = np.zeros((len(rows), len(voters) + len(LEXICONS) + 2), np.int8)
    hit = np.zeros((len(rows), len(names)), bool)
    hit[row, at] = x >= 0.1
    votes[:, : len(voters)] = hit[:, voters]
    for k, lang in enumerate(LEXICONS):
        votes[:, len(voters) + k] = hit[:, [wanted[p] for p, own in stated.items() if own == lang]].any(1)
    votes[:, -2:] = np.array([r["shapes"] for r in rows]).reshape(-1, 2)
    prior = min(max(counts.get(1, 0) / sum(counts.values()), 0.01), 0.99)
    post, _, _ = label_model(votes, gold.mean() if 0 < gold.mean() < 1 else prior, gold)
    # the sample holds more toxic rows than the corpus: weigh rows back
    balance = np.where(gold == 1, prior / max(n1, 1), (1 - prior) / max(n0, 1)) * len(rows)
    bias, w = _logistic(row, at, x, post, balance, len(names))
    return round(bias, 9), {p: round(float(v), 9) for p, v in zip(names, w) if abs(v) > 1e-6}


def _score(bias: float, weights: dict[str, float]):
    names = list(weights)
    wanted, values = {p: i for i, p in enumerate(names)}, [weights[p] for p in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembered("toxicity")
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch.column(0).to_pylist():
                hits, words = _hits(text or "", wanted, known)
                z = bias + sum(values[p] * density(n, words) for p, n in sorted(hits.items()))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: tuple[float, dict[str, float]], carry: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns carry of docs and each text's score from 0 to 1; a null or empty text scores the bias alone."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    schema = ", ".join([f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry))] + ["score double"])
    return rows.mapInArrow(_score(*model), schema).toDF(*carry, score_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: (doc_id, held_out, score, predicted).

    Null ids are never held out and never labelled; null, empty and very long
    texts are scored like any other; repeated rows stay; without usable labels
    every score is the prior; an empty table gives an empty result; other
    columns are ignored. Labels that contradict each other count as toxic.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(rows, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic; all columns stay."""
    model = fit(docs, labels, id_col, text_col)
    mark = common.fresh(docs, "score")
    return score(docs, model, docs.columns, text_col, mark).filter(F.col(mark) < THRESHOLD).select(*docs.columns)
