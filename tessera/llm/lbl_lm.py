"""Scores texts with a log-bilinear language model and a smoothed unigram base.

Every training word is counted. The VOCABULARY commonest words have vectors of
their own; all other words share RARE entries by their first two bytes, and the
end of a text is an entry, which also stands before a text's first word. The
entries fall into classes: runs of the vocabulary in byte order, so that words
of one stem share a class, the rare entries, and the end.

The model predicts an entry from the CONTEXT entries before it. Each place has a
matrix; the sum of the matrices times the entries' vectors meets an output
vector and a bias for each entry, and likewise for each class. Both are trained
in numpy by noise-contrastive estimation: minibatches of tokens against noise
words and noise classes sampled from their unigram distributions.
P(class | context), normalised over classes, times P(entry | class, context),
normalised over the class, is the model's probability; both are batched matrix
products. Within a rare entry a word has its add-one share.

Distribution. All training tokens train the model. Texts are dealt to trainers
of about TRAINER_TOKENS tokens; the first one breaks the symmetry, then every
trainer starts from its parameters, and the mean of what they end with, weighted
by tokens, is the model (parallel SGD with one averaging). Words that are common
enough (at most COMMON of them) reach the workers as a dictionary; a text's other
words, a small share of its tokens, meet their counts in an equi-join. A text is
split once; afterwards a table of entries and rare words stands for it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

FOLDS, HELD_OUT = 7, 2
VOCABULARY, RARE = 8192, 111
WORD_CLASSES = 94
CONTEXT = 3
#: Words whose counts reach every worker, at most.
COMMON = 150_000
DIMENSIONS = 16
#: Sampled words and classes that each token of a minibatch is told from.
NOISE, CLASS_NOISE = 64, 32
BATCH = 4096
TRAINER_TOKENS = 1 << 22
#: Passes, least steps and step size of the first trainer, then of all trainers.
OPENING, CLOSING = (1, 200, 0.1), (1, 1, 0.03)
#: Tokens that are scored at once.
SLICE = 1 << 16
SEED = 42


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(_split(text))
        if len(counts) > 200_000:
            yield rows()
    yield rows()


def rare_entry(word: bytes) -> int:
    """The number of a rare word's entry among the rare ones."""
    return zlib.crc32(word[:2]) % RARE


def _wide(rows: np.ndarray, last: np.ndarray | float = 1) -> np.ndarray:
    """rows with one more column, so that a product with others of that kind adds their biases."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.float32)
    out[:, :-1] = rows
    out[:, -1] = last
    return out


def _row_sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of at, and for each of them the sum of the rows at it."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], np.add.reduceat(rows.take(order, axis=0), first)


class Model:
    """Parameters over entries: words 0 to n_words - 1 in byte order, RARE rare ones, and the end."""

    NAMES = ("vectors", "places", "targets", "bias", "class_targets", "class_bias")

    def __init__(self, counts: np.ndarray):
        """counts: how often each entry occurs in the training texts."""
        self.size = len(counts)
        self.end = self.size - 1
        n_words = self.size - RARE - 1
        groups = min(WORD_CLASSES, n_words)
        self.starts = np.array([*(i * n_words // groups for i in range(groups)), n_words, self.end])
        self.ends = np.append(self.starts[1:], self.size)
        self.classes = len(self.starts)
        self.class_of = np.repeat(np.arange(self.classes), self.ends - self.starts)
        self.share = (counts + 0.5) / (counts + 0.5).sum()
        self.class_share = np.bincount(self.class_of, self.share, self.classes)
        rng = np.random.default_rng(SEED)
        self.params = {
            "vectors": rng.normal(0, 0.1, (self.size, DIMENSIONS)),
            "places": np.stack([np.eye(DIMENSIONS) / 2**i for i in range(CONTEXT)]),
            "targets": np.zeros((self.size, DIMENSIONS)),
            "bias": np.log(self.share),
            "class_targets": np.zeros((self.classes, DIMENSIONS)),
            "class_bias": np.log(self.class_share),
        }
        self.params = {name: p.astype(np.float32) for name, p in self.params.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            p = self.params[n]
            self.params[n] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size

    def lay_out(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All entries, with CONTEXT ends before each text, and the places of the texts' own."""
        before = np.full(CONTEXT, self.end, np.int16)
        if not texts:
            return before, np.zeros(0, np.int32)
        entries = np.concatenate([x for t in texts for x in (before, t)])
        own = np.ones(len(entries), bool)
        first = np.cumsum([0, *(len(t) + CONTEXT for t in texts[:-1])])
        own[(first[:, None] + np.arange(CONTEXT)).ravel()] = False
        return entries, np.flatnonzero(own).astype(np.int32)

    def hidden(self, entries: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The entries before each place of at, their vectors, and what the matrices make of them."""
        context = [entries[at - i - 1].astype(np.int64) for i in range(CONTEXT)]
        vectors = [self.params["vectors"].take(c, axis=0) for c in context]
        return context, vectors, sum(v @ m for v, m in zip(vectors, self.params["places"]))

    def train(self, texts: list[np.ndarray], passes: int, steps: int, rate: float, seed: int | list[int]) -> None:
        """Noise-contrastive estimation over minibatches of the texts' tokens, with AdaGrad steps: so many of both at least."""
        entries, at = self.lay_out(texts)
        rng, params = np.random.default_rng(seed), self.params
        squares = {n: np.full_like(p, 1e-6) for n, p in params.items()}
        # output vectors, biases, size, noise distribution, noise words for each token
        heads = [("targets", "bias", self.size, self.share, NOISE), ("class_targets", "class_bias", self.classes, self.class_share, CLASS_NOISE)]
        heads = [(v, b, n, np.cumsum(share), np.log(k * share).astype(np.float32), k) for v, b, n, share, k in heads]
        for _ in range(max(passes, -(-steps // max(1, -(-len(at) // BATCH))))):
            rng.shuffle(at)
            for start in range(0, len(at), BATCH):
                places = at[start : start + BATCH]
                now = entries[places].astype(np.int64)
                context, vectors, hidden = self.hidden(entries, places)
                back, wide = np.zeros_like(hidden), _wide(hidden)
                sums = wide.sum(0)

                def step(name: str, where: np.ndarray | slice, grad: np.ndarray) -> None:
                    g = (grad / len(places)).astype(np.float32)
                    held = squares[name][where] + g * g
                    squares[name][where] = held
                    np.sqrt(held, out=held)
                    g *= np.float32(rate)
                    g /= held
                    params[name][where] -= g

                steps_due = []
                for (vec, bias, size, up_to, shift, k), true in zip(heads, (now, self.class_of[now])):
                    noise = np.minimum(np.searchsorted(up_to, rng.random(k)), size - 1)
                    of_true, of_noise = params[vec].take(true, axis=0), params[vec][noise]
                    # the logistic function of x is (1 + tanh(x / 2)) / 2
                    miss = np.einsum("ij,ij->i", hidden, of_true) + (params[bias] - shift).take(true)
                    miss *= np.float32(0.5)
                    miss = (np.tanh(miss, out=miss) - 1) / 2
                    curve = wide @ (_wide(of_noise, params[bias][noise] - shift[noise]).T * np.float32(0.5))
                    np.tanh(curve, out=curve)
                    # only entries that occur have a gradient; the last column is the bias
                    rows = np.concatenate([wide * miss[:, None], (curve.T @ wide + sums) / 2])
                    where, grad = _row_sums(np.concatenate([true, noise]), rows)
                    steps_due += [(vec, where, grad[:, :-1]), (bias, where, grad[:, -1])]
                    of_true *= miss[:, None]
                    back += of_true
                    back += (curve @ of_noise + of_noise.sum(0)) / 2
                steps_due.append(("places", slice(None), np.stack([v.T @ back for v in vectors])))
                steps_due.append(("vectors", *_row_sums(np.concatenate(context), np.concatenate([back @ m.T for m in params["places"]]))))
                for due in steps_due:
                    step(*due)

    def log_probabilities(self, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P(entry | the entries before it) at each place of at."""
        out = np.empty(len(at))
        words, classes = (np.ascontiguousarray(_wide(self.params[v], self.params[b]).T) for v, b in (("targets", "bias"), ("class_targets", "class_bias")))
        longest = [max(np.linalg.norm(self.params[v], axis=1).max(), 0) for v in ("targets", "class_targets")]
        widest = [np.abs(self.params[b]).max() for b in ("bias", "class_bias")]
        for start in range(0, len(at), SLICE):
            places = at[start : start + SLICE]
            now = entries[places].astype(np.int64)
            _, _, hidden = self.hidden(entries, places)
            of_class = self.class_of[now]
            norm = math.sqrt(np.einsum("ij,ij->i", hidden, hidden).max())
            safe = [norm * v + b < 50 for v, b in zip(longest, widest)]
            # tokens class by class, so that each class is one product
            order = np.argsort(of_class.astype(np.int16), kind="stable")
            wide, now, of_class = _wide(hidden.take(order, axis=0)), now[order], of_class[order]
            found = np.concatenate([_chosen(wide[i : i + BATCH] @ classes, of_class[i : i + BATCH], safe[1]) for i in range(0, len(wide), BATCH)])
            cuts = np.searchsorted(of_class, np.arange(self.classes + 1))
            for c, (first, last) in enumerate(zip(self.starts, self.ends)):
                rows = slice(cuts[c], cuts[c + 1])
                if cuts[c] < cuts[c + 1] and last - first > 1:
                    found[rows] += _chosen(wide[rows] @ words[:, first:last], now[rows] - first, safe[0])
            out[start + order] = found
        return out / math.log(10)


def _chosen(z: np.ndarray, at: np.ndarray, safe: bool = False) -> np.ndarray:
    """The log-softmax of each row of z at the place given; z is overwritten. safe: all of z is known to be small."""
    own = z[np.arange(len(z)), at].astype(float)
    if not safe and (z.max() > 60 or z.min() < -80):  # beyond what float32 exponentials add up safely: a shift for each row
        most = z.max(1)
        z -= most[:, None]
        return own - most - np.log(np.exp(z, out=z).sum(1))
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


#: Parameters travel in rows of so many numbers.
WIDTH = 32


def _train_batches(model, turn: int, passes: int, steps: int, rate: float):
    """One trainer: the model (a broadcast) trained on the task's texts, as rows of parameters times tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copy import deepcopy

        own, tokens, waiting, held = deepcopy(model.value), 0, [], 0

        def learn() -> None:
            nonlocal held
            own.train(waiting, passes, steps, rate, [SEED, turn, tokens])  # noise that repeats would be learnt
            waiting.clear()
            held = 0

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                text = np.frombuffer(raw, "<i2")
                waiting.append(text)
                held, tokens = held + len(text), tokens + len(text)
            if held > 2 * TRAINER_TOKENS:
                learn()
        if waiting:
            learn()
        if tokens:
            flat = own.flat().astype(float) * tokens
            rows = np.append(flat, np.zeros(-len(flat) % WIDTH)).reshape(-1, WIDTH)
            columns = [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), tokens), pa.int64()), *(pa.array(c) for c in rows.T)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "n", *(f"x{k}" for k in range(WIDTH))])

    return run


def fit(encoded: DataFrame, counts: np.ndarray, tokens: int) -> Model:
    """The model after both rounds, over encoded(row, classes) of all training texts."""
    spark, model = encoded.sparkSession, Model(counts)
    trainers = max(1, -(-tokens // TRAINER_TOKENS))
    schema = ", ".join(["i int", "n long", *(f"x{k} double" for k in range(WIDTH))])
    one = encoded.filter(F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(trainers)) == 0).repartition(1)
    every = encoded.repartition(trainers, F.xxhash64("row"))
    for turn, (texts, how) in enumerate(((one, OPENING), (every, CLOSING))):
        known = spark.sparkContext.broadcast(model)
        trained = texts.sortWithinPartitions("row").select("classes").mapInArrow(_train_batches(known, turn, *how), schema)
        rows = trained.groupBy("i").agg(*[(F.sum(f"x{k}") / F.sum("n")).alias(f"x{k}") for k in range(WIDTH)]).orderBy("i").collect()  # one model
        if rows:
            model.load(np.array([r[1:] for r in rows], float).ravel())
    return model


def _encode(known):
    """A text's entries, what its common words add up to, and its rare words. known: a broadcast of words and counts, the vocabulary first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        words, counts, top = known.value
        index = {w: i for i, w in enumerate(words)}
        # beyond the vocabulary, a common word adds its own log10(c + 1); the last place stands for a rare word
        logs = np.append(np.log10(np.array(counts, float) + 1), 0.0)
        logs[:top] = 0
        classes = np.array([i if i < top else top + rare_entry(w) for i, w in enumerate(words)] + [-1], np.int16)
        by_start: dict[bytes, int] = {}
        lists = pa.list_(pa.binary())
        for batch in batches:
            sizes, numbers, common_logs, common_n, rare, times = [], [], [], [], [], []
            for text in batch.column(0).to_pylist():
                tokens = _split(text)
                at = np.fromiter(map(index.get, tokens, repeat(-1)), np.int64, len(tokens))
                own = classes[at]
                unknown = np.flatnonzero(at < 0).tolist()
                strange = [tokens[i] for i in unknown]
                for i, w in zip(unknown, strange):
                    start = w[:2]
                    if start not in by_start:
                        by_start[start] = top + rare_entry(w)
                    own[i] = by_start[start]
                sizes.append(len(tokens) + 1)
                numbers.append(np.append(own, np.int16(top + RARE)).astype("<i2").tobytes())
                common_logs.append(float(logs[at].sum()))
                common_n.append(len(tokens) - len(unknown))
                held = Counter(strange)
                rare.append(list(held))
                times.append(list(held.values()))
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], rows, pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary()), pa.array(common_logs, pa.float64()), pa.array(common_n, pa.int64()), pa.array(rare, lists), pa.array(times, pa.list_(pa.int32()))],
                [*batch.schema.names[1:], "row", "n_tokens", "classes", "common_logs", "common_n", "rare", "times"],
            )

    return run


_ENCODED = "doc_id long, row long, n_tokens long, classes binary, common_logs double, common_n long, rare array<binary>, times array<int>"


def _score_batches(model, own_logs: np.ndarray, rare_shares: np.ndarray):
    """Sums over a text's entries: model log-probabilities, log10(c + 1) of words with an entry, shares of rare entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            texts = [np.frombuffer(raw, "<i2") for raw in batch.column(0).to_pylist()]
            entries, at = own.lay_out(texts)
            log_p, now = own.log_probabilities(entries, at), entries[at]
            firsts = np.cumsum([0, *(len(t) for t in texts[:-1])])
            sums = [np.add.reduceat(x, firsts) if len(texts) else x for x in (log_p, own_logs[now], rare_shares[now])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(s) for s in sums)], [*batch.schema.names[1:], "model", "own_logs", "shares"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    A null or empty text is one end token. Null ids are never held out; repeated
    rows stay and count as often as they occur; very long texts are scored
    whole; words of equal count enter the vocabulary in byte order; with no
    training text every base score is 0 and the model is uniform over entries'
    classes; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    learned = rows.filter(~held_out(F.col("doc_id")))
    counted = learned.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts, _ = common.materialize(counted)
    n_texts = learned.select(F.count("*")).first()[0]
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = words + n_texts, distinct + (n_texts > 0)

    # the common words: the commonest steps of a logarithmic scale that together hold COMMON words at most
    step = F.floor(F.log2("n") * 8).cast("int")
    held, floor = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        if held + r["n"] > COMMON:
            break
        held, floor = held + r["n"], r["step"]
    common_rows = [] if floor is None else counts.filter(step >= floor).collect()
    common_rows = sorted(((bytes(r["word"]), r["n"]) for r in common_rows), key=lambda r: (-r[1], r[0]))
    top = min(VOCABULARY, len(common_rows))
    common_rows = sorted(common_rows[:top]) + common_rows[top:]
    known = spark.sparkContext.broadcast(([w for w, _ in common_rows], [c for _, c in common_rows], top))
    encoded, _ = common.materialize(rows.mapInArrow(_encode(known), _ENCODED).withColumn("held_out", held_out(F.col("doc_id"))))

    # rare entries: words and distinct words that are not in the vocabulary
    start = F.crc32(F.substring("word", 1, 2)) % RARE
    own = F.broadcast(spark.createDataFrame([(bytearray(w),) for w, _ in common_rows[:top]], "word binary"))
    entry_counts, own_logs, shares = np.zeros(top + RARE + 1), np.zeros(top + RARE + 1), np.zeros(top + RARE + 1)
    for r in counts.join(own, "word", "left_anti").groupBy(start.alias("entry")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        entry_counts[top + r["entry"]] = r["n"]
        shares[top + r["entry"]] = math.log10(r["n"] + r["v"] + 1)
    entry_counts[:top] = [c for _, c in common_rows[:top]]
    entry_counts[-1] = n_texts
    own_logs[:top] = np.log10(entry_counts[:top] + 1)
    own_logs[-1] = math.log10(n_texts + 1)

    model = spark.sparkContext.broadcast(fit(encoded.filter("not held_out").select("row", "classes"), entry_counts, n))
    looked = encoded.select("classes", "row", "doc_id", "held_out", "n_tokens", "common_logs", "common_n").mapInArrow(
        _score_batches(model, own_logs, shares), "row long, doc_id long, held_out boolean, n_tokens long, common_logs double, common_n long, model double, own_logs double, shares double"
    )
    strange = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    met = strange.join(counts if floor is None else counts.filter(step < floor), "word", "left")
    of_row = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_n"),
    )
    joined = looked.join(of_row, "row", "left")
    within = F.col("common_logs") + F.coalesce("rare_logs", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common_n") + F.coalesce("rare_n", F.lit(0)) + int(n_texts > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("own_logs") + within - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("model") + within - F.col("shares")).alias("score"),
    )
