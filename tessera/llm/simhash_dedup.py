"""Near-duplicate documents by SimHash, with pivot distance tables.

A fingerprint is 64 bits; two documents link when theirs differ in at most
three bits, and documents joined by a chain of links form one class.

Candidates. A fingerprint is cut into five blocks. Three differing bits spoil
three blocks at most, so linked fingerprints agree on some two blocks: the ten
pairs of blocks are equi-join keys and no link is missed.

Pivot tables. Each candidate carries its Hamming distances to PIVOTS reference
fingerprints. By the triangle inequality a linked pair's distances differ by at
most three in every coordinate; pairs above are discarded, survivors are
verified on the bits themselves.

Only distinct fingerprints are joined, so a group of exact copies is one node.
A key with more than HOT_KEY fingerprints is one bounded task, which sweeps along
the first pivot coordinate and returns a spanning forest of its links instead of
the links themselves. Beyond CHUNK fingerprints, the pivot table cuts the key
into cells: coordinates of the first GRID pivots in steps of MAX_BITS + 1. Linked
fingerprints stand in the same or in adjoining cells, so pairs of other cells are
never formed; a cell above CHUNK is cut by hash, and each pair of parts is a task.

All that is op1's rule. keep_one(), the pipeline's stage, asks more: it links
texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY
or more. The method is the same, cut to that distance. A set's SimHash has
NEAR_WORDS words; pairs at exactly 0.8 differ in 15 % of its bits (19 % between
sets of four and five shingles). Agreement on blocks is no longer certain, so
there are many: each of TABLES tables takes a fingerprint to a cell by CELL_BITS
bits, and in a cell FINE further blocks of FINE_BITS bits each are the keys.
Pairs that agree on one are discarded by the first word, by the distances to
PIVOTS references, and by all words (NEAR_BITS); a unit of cells returns a
spanning forest of what is left. A cell that holds far more than others is cut
into chunk pairs. The components are candidate groups, so each text is read once
for all of its keys; all pairs of a group within NEAR_BITS are verified by exact
Jaccard similarities. A group of more than CELL texts is cut into chunk pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

MAX_BITS = 3
SHINGLE = 3
BLOCKS = (13, 13, 13, 13, 12)
PIVOTS = 16
#: Pivots whose coordinates are the cells of a very hot key.
GRID = 3
#: Keys with more distinct fingerprints go the chunked way.
HOT_KEY = 256
CHUNK = 2048
SEED = 42

#: keep_one(): words of a shingle, the least similarity, words of a SimHash, its largest distance in
#: the first word and in all of a pair that is verified.
NEAR_SHINGLE = 5
SIMILARITY = (4, 5)
NEAR_WORDS = 4
NEAR_BITS = (24, 72)
#: keep_one()'s keys: tables, bits of a table's cells, blocks in a cell and their bits.
TABLES, CELL_BITS = 24, 5
FINE, FINE_BITS = 10, 7
#: Fingerprints of one unit of cells, about; a cell with more than NEAR_CHUNK and four times its share, or more than NEAR_MOST, is cut.
UNIT, NEAR_CHUNK, NEAR_MOST = 4096, 8192, 1 << 20
#: Keys with more fingerprints are met block by block.
SHORT_RUN = 64
#: Texts of one verifying task, or of each of its two sides.
CELL = 512


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Reference fingerprints, drawn by a fixed rule.
REFERENCES = tuple(_signed(xxhash.xxh64_intdigest(f"pivot-{i}".encode(), SEED)) for i in range(PIVOTS))


def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles, as an unsigned integer; 0 when there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = np.array([digest(b" ".join(words), SEED)], "<u8")
    else:
        hashes = np.fromiter((digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])), "<u8", len(words) - 2)
    total = np.zeros(64, np.int64)
    all_bits = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(all_bits), 1 << 16):
        total += np.unpackbits(all_bits[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text comes first and goes; its fingerprint comes last."""
    for batch in batches:
        prints = np.fromiter((fingerprint(x) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        names = [*batch.schema.names[1:], "fp"]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64))], names)


def with_fingerprint(docs: DataFrame, carry: list[str], text_col: str = "text", fp_col: str = "fp") -> DataFrame:
    """The columns carry of docs and, as a signed long, the fingerprint of each row's text."""
    common.bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    schema = ", ".join([f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry))] + ["fp long"])
    return rows.mapInArrow(_fingerprint_batches, schema).toDF(*carry, fp_col)


def _keys(fp: Column) -> Column:
    """The ten block pairs of a fingerprint, each with its number in the upper bits."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in zip(starts, BLOCKS)]
    pairs = combinations(range(len(BLOCKS)), 2)
    keyed = [F.lit(n << 26).cast("long") + F.shiftleft(block[a], 13) + block[b] for n, (a, b) in enumerate(pairs)]
    return F.array(*keyed)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _with_pivots(df: DataFrame) -> DataFrame:
    """The pivot table: a byte column for each reference fingerprint."""
    return df.select("*", *[_distance(F.col("fp"), F.lit(p)).cast("byte").alias(f"p{i}") for i, p in enumerate(REFERENCES)])


def _forest(fps: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps (across the two sides, if given)."""
    tables = np.stack([np.bitwise_count(fps ^ np.int64(p).view(np.uint64)) for p in np.array(REFERENCES, np.int64)]).astype(np.int16)
    order = np.argsort(tables[0], kind="stable")
    fps, tables = fps[order], tables[:, order]
    side = side[order] if side is not None else None
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ends = np.searchsorted(tables[0], tables[0] + MAX_BITS, side="right")
    links = []
    for i in range(len(fps)):
        js = np.arange(i + 1, ends[i])
        if side is not None:
            js = js[side[js] != side[i]]
        for t in tables[1:]:
            if not len(js):
                break
            js = js[np.abs(t[js] - t[i]) <= MAX_BITS]
        for j in js[np.bitwise_count(fps[js] ^ fps[i]) <= MAX_BITS]:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(fps[i].view(np.int64)), int(fps[j].view(np.int64))))
    return links


def _hot_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    fps = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)
    one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    links = _forest(fps, None if one else (pdf["chunk"] == pdf["i"]).to_numpy())
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _cells(large: DataFrame) -> DataFrame:
    """(task, side, fp) for large(key, fp): every part of a cell with itself and every part of the same or an adjoining cell, once."""
    step = MAX_BITS + 1
    at = [f"c{i}" for i in range(GRID)]
    placed = large.select("key", "fp", *[F.floor(_distance(F.col("fp"), F.lit(REFERENCES[i])) / step).cast("int").alias(c) for i, c in enumerate(at)])
    sizes = placed.groupBy("key", *at).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    sizes, _ = common.materialize(sizes.drop("n"))
    # offsets that come first in order, and none: each pair of cells is met from one side only
    offsets = [o for o in product((-1, 0, 1), repeat=GRID) if o >= (0,) * GRID]
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = sizes.select("key", *at, F.explode(F.array(*[F.array(*map(F.lit, o)) for o in offsets])).alias("o"), part.alias("a"))
    other = sizes.select("key", *[F.col(c).alias(f"d{i}") for i, c in enumerate(at)], part.alias("b"))
    moved = [F.col(c) + F.col("o")[i] for i, c in enumerate(at)]
    met = one.select("key", *at, *[m.alias(f"d{i}") for i, m in enumerate(moved)], "a").join(other, ["key", *[f"d{i}" for i in range(GRID)]])
    same = F.lit(True)
    for i, c in enumerate(at):
        same &= F.col(c) == F.col(f"d{i}")
    met = met.filter(~same | (F.col("a") <= F.col("b"))).withColumn("task", F.concat_ws(",", "key", *at, "a", *[f"d{i}" for i in range(GRID)], "b"))
    met = met.withColumn("single", same & (F.col("a") == F.col("b")))
    left = met.select("task", F.when(F.col("single"), 2).otherwise(0).alias("side"), "key", *at, F.col("a").alias("part"))
    right = met.filter("not single").select("task", F.lit(1).alias("side"), "key", *[F.col(f"d{i}").alias(c) for i, c in enumerate(at)], F.col("b").alias("part"))
    parted = placed.join(sizes, ["key", *at]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    return left.unionByName(right).join(parted.drop("parts"), ["key", *at, "part"]).select("task", "side", "fp")


def _hot_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    fps, side = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64), pdf["side"].to_numpy()
    found = _forest(fps, None if side[0] == 2 else side)
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints of nodes(fp) that join what the links at MAX_BITS join."""
    before = common.made()
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes, _ = common.materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = sizes.withColumn("rows", F.col("n"))
    candidates, _ = common.materialize(common.join_hot(keyed, shared.withColumnRenamed("n", "held"), "key", nodes.count() * len(list(combinations(BLOCKS, 2))), "rows"))
    few = _with_pivots(candidates.filter(F.col("held") <= HOT_KEY).select("key", "fp"))
    a, b = few.alias("a"), few.alias("b")
    near = F.col("a.fp") < F.col("b.fp")
    for i in range(PIVOTS):
        near &= F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= MAX_BITS
    near &= _distance(F.col("a.fp"), F.col("b.fp")) <= MAX_BITS
    plain = a.join(b, (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    hot = candidates.filter((F.col("held") > HOT_KEY) & (F.col("held") <= CHUNK)).select(F.col("key").cast("string").alias("task"), F.lit(2).alias("side"), "fp")
    large = _cells(candidates.filter(F.col("held") > CHUNK).select("key", "fp"))
    dense = hot.unionByName(large).groupBy("task").applyInPandas(_hot_cell, "u long, v long")
    found, found_path = common.materialize(plain.unionByName(dense).distinct())
    common.release(nodes.sparkSession, before, found_path)
    found.tessera_path = found_path
    return found


def components(edges: DataFrame, max_rounds: int = 200) -> tuple[DataFrame, str]:
    """(node, root) for every node of edges(u, v): the smallest node of its connected component.

    Alternates large-star and small-star steps until the edges no longer change;
    each step is an aggregate with map-side combine and an equi-join, in which
    hubs are joined apart. Each round is a table in the shared folder, so a lost
    executor costs one round.
    """
    spark = edges.sparkSession
    current, path = common.materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"))
    total, seen = current.count(), None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = common.join_hot(both.filter("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        large, large_path = common.materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.join_hot(large, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        step, step_path = common.materialize(small.filter("u <> v").distinct())
        total, print_ = step.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        common.discard(spark, path, large_path)
        current, path = step, step_path
        if (total, print_) == seen:
            break
        seen = (total, print_)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), path


def _classes(prints: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(fp, component_id, n) for prints(id, fp): the smallest id of each fingerprint's class, by links() or the edges given, and the rows with it."""
    nodes, _ = common.materialize(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    edges = links(nodes.select("fp")) if edges is None else edges
    members, members_path = components(edges)
    common.discard(prints.sparkSession, edges.tessera_path)
    joined, _ = common.materialize(nodes.join(members.withColumnRenamed("node", "fp"), "fp").select("fp", "rep", "root"))
    common.discard(prints.sparkSession, members_path)
    named = joined.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("n"))
    of_class = common.join_hot(joined.select("fp", "root"), named, "root", joined.count()).select("fp", "first")
    return nodes.join(of_class, "fp", "left").select("fp", F.coalesce("first", "rep").alias("component_id"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): a row per row of docs with its fingerprint and the smallest id of its class.

    Null and empty texts have fingerprint 0 and link like any other; null ids
    keep their row and name a class only if all ids of the class are null;
    repeated rows stay repeated; an empty table gives an empty result; other
    columns of docs, whatever their names, are ignored.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints, _ = common.materialize(with_fingerprint(ids, ["id"]))
    classes, _ = common.materialize(_classes(prints))
    return common.join_hot(prints, classes, "fp", prints.count()).select("id", "fp", "component_id")


#: Bits that each table reads: its cell's, then those of each block.
_PLACES = [np.random.default_rng([SEED, t]).permutation(64 * NEAR_WORDS)[: CELL_BITS + FINE * FINE_BITS].tolist() for t in range(TABLES)]
#: Reference fingerprints of the stage's pivot tables.
_NEAR_REFERENCES = np.array([[xxhash.xxh64_intdigest(f"pivot-{i}-{w}".encode(), SEED) for w in range(NEAR_WORDS)] for i in range(PIVOTS)], np.uint64)
_FACTORS = [np.uint64(xxhash.xxh64_intdigest(f"times-{w}".encode(), SEED) | 1) for w in range(2 * NEAR_WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles; of all its words when they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < NEAR_SHINGLE:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    hashes = (digest(b"%b %b %b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], words[3:], words[4:]))
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - 4))


def _set_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, NEAR_WORDS words long; the words after the first are of the hashes mixed anew."""
    total = np.zeros(64 * NEAR_WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = hashes[at : at + (1 << 13)]
        mixed = np.empty((len(part), NEAR_WORDS), "<u8")
        mixed[:, 0] = part
        for w in range(1, NEAR_WORDS):
            x = part * _FACTORS[2 * w]
            x = (x ^ (x >> np.uint64(32))) * _FACTORS[2 * w + 1]
            mixed[:, w] = x ^ (x >> np.uint64(29))
        # bytes of 0 and 1, eight to a word: sums of 255 rows at most do not carry
        lanes = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        for start in range(0, len(lanes), 255):
            total += lanes[start : start + 255].sum(0).view(np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def _block(prints: np.ndarray, places: list[int]) -> np.ndarray:
    """The bits at places of each fingerprint (a row of words), as a number."""
    out = np.zeros(len(prints), np.int64)
    for p in places:
        out = out << 1 | (prints[:, p >> 6] >> np.uint64(p & 63) & np.uint64(1)).astype(np.int64)
    return out


def _cells_of(prints: np.ndarray) -> np.ndarray:
    """A row for each fingerprint: its cell in each table, numbered through."""
    return np.stack([(t << CELL_BITS) + _block(prints, places[:CELL_BITS]) for t, places in enumerate(_PLACES)], axis=1)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text comes first and goes; a row number, a key of its shingle set, its size, its fingerprint and its cells come last."""
    from pyspark import TaskContext

    common.remembered("simhash")
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        prints, sizes, keys = np.zeros((batch.num_rows, NEAR_WORDS), np.uint64), [], []
        for i, text in enumerate(batch.column(0).to_pylist()):
            hashes = shingles(text)
            keys.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)) if len(hashes) else 0)
            sizes.append(len(hashes))
            prints[i] = _set_print(hashes)
        rows = pa.array(range(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        cells = pa.FixedSizeListArray.from_arrays(pa.array(_cells_of(prints).ravel(), pa.int32()), TABLES).cast(pa.list_(pa.int32()))
        words = pa.FixedSizeListArray.from_arrays(pa.array(prints.view(np.int64).ravel()), NEAR_WORDS).cast(pa.list_(pa.int64()))
        names = [*batch.schema.names[1:], "row", "key", "size", "words", "cells"]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows, pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), words, cells], names)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is SIMILARITY or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def _near_pairs(prints: np.ndarray, pivots: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) are close enough: by the pivot tables, then by the words, then by size."""
    keep = np.flatnonzero((np.abs(pivots[a] - pivots[b]) <= NEAR_BITS[1]).all(1))
    keep = keep[np.bitwise_count(prints[a[keep]] ^ prints[b[keep]]).sum(1, dtype=np.int64) <= NEAR_BITS[1]]
    x, y = sizes[a[keep]], sizes[b[keep]]
    return keep[SIMILARITY[1] * np.minimum(x, y) >= SIMILARITY[0] * np.maximum(x, y)]


def _pivot_table(prints: np.ndarray) -> np.ndarray:
    """The distances of each fingerprint to the references."""
    return np.stack([np.bitwise_count(prints ^ r).sum(1, dtype=np.int16) for r in _NEAR_REFERENCES], axis=1)


def near_candidates(prints: np.ndarray, sizes: np.ndarray, cells: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs that share a key within a cell (across the two sides, if given)."""
    pivots, parent, found = _pivot_table(prints), np.arange(len(prints)), []
    first = np.ascontiguousarray(prints[:, 0])

    def roots(rows: np.ndarray) -> np.ndarray:
        at = parent[rows]
        while (up := parent[at]).tobytes() != at.tobytes():
            at = up
        parent[rows] = at
        return at

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(a: np.ndarray, b: np.ndarray) -> None:
        if side is not None:
            cross = side[a] != side[b]
            a, b = a[cross], b[cross]
        if not len(a):
            return
        keep = _near_pairs(prints, pivots, sizes, a, b)
        for x, y in zip(a[keep].tolist(), b[keep].tolist()):
            u, v = root(x), root(y)
            if u != v:
                parent[max(u, v)] = min(u, v)
                found.append((x, y))

    for at in range(FINE):
        keys = np.empty(len(prints), np.int64)
        for t in np.unique(cells >> CELL_BITS).tolist():
            own = np.flatnonzero(cells >> CELL_BITS == t)
            places = _PLACES[t][CELL_BITS + at * FINE_BITS : CELL_BITS + (at + 1) * FINE_BITS]
            keys[own] = (cells[own] << FINE_BITS) + _block(prints[own], places)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order], prepend=-1, append=-1))
        lengths = np.diff(cuts)
        # short runs all at once: each place with the one so many places on
        short = order[np.repeat(lengths <= SHORT_RUN, lengths)]
        key, x = keys[short], first[short]
        for s in range(1, int(lengths[lengths <= SHORT_RUN].max(initial=1))):
            hits = np.flatnonzero((key[s:] == key[:-s]) & (np.bitwise_count(x[s:] ^ x[:-s]) <= NEAR_BITS[0]))
            join(short[hits], short[hits + s])
        for c in np.flatnonzero(lengths > SHORT_RUN):
            rest, step = order[cuts[c] : cuts[c + 1]], 1
            while len(rest):  # rows of the largest tree are met by all others
                tree = roots(rest)
                values, counts = np.unique(tree, return_counts=True)
                waiting = np.flatnonzero(tree != values[counts.argmax()])[:step]
                if not len(waiting):
                    break
                i, j = np.nonzero(np.bitwise_count(first[rest[waiting], None] ^ first[rest]) <= NEAR_BITS[0])
                apart = tree[waiting[i]] != tree[j]
                join(rest[waiting[i[apart]]], rest[j[apart]])
                rest, step = np.delete(rest, waiting), min(2 * step, 128)
    return found


def _near_unit(pdf: pd.DataFrame) -> pd.DataFrame:
    common.remembered("simhash")
    keys, sizes, cells = (pdf[c].to_numpy("int64") for c in ("key", "size", "cell"))
    prints = np.stack([pdf[f"w{i}"].to_numpy("int64") for i in range(NEAR_WORDS)], axis=1).view(np.uint64)
    one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    found = np.array(near_candidates(prints, sizes, cells, None if one else (pdf["chunk"] == pdf["i"]).to_numpy()), np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": keys[found[:, 0]], "v": keys[found[:, 1]]})


def _near_forest(sets: list[np.ndarray], groups: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the verified links within groups of sets (across the two sides, if given)."""
    sizes, label, found = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    prints = np.stack([_set_print(x) for x in sets])
    pivots = _pivot_table(prints)
    for i in range(len(sets) - 1):
        near = (groups[i + 1 :] == groups[i]) & (label[i + 1 :] != label[i])
        if side is not None:
            near &= side[i + 1 :] != side[i]
        js = np.flatnonzero(near) + i + 1
        for j in js[_near_pairs(prints, pivots, sizes, np.full(len(js), i), js)]:
            if label[j] != label[i] and similar(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                found.append((int(i), int(j)))
    return found


def _near_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    common.remembered("simhash")
    keys, groups, sets = pdf["key"].to_numpy("int64"), pdf["root"].to_numpy("int64"), [shingles(t) for t in pdf["text"]]
    one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    found = _near_forest(sets, groups, None if one else (pdf["chunk"] == pdf["i"]).to_numpy())
    return pd.DataFrame([(keys[a], keys[b]) for a, b in found], columns=["u", "v"], dtype="int64")


def _candidate_edges(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that join what the near pairs of nodes(key, size, words, cells) join."""
    per_cell = nodes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()  # one row for each of TABLES * 2^CELL_BITS cells
    total, cells = sum(r["n"] for r in per_cell), TABLES << CELL_BITS
    most = max(NEAR_CHUNK, min(NEAR_MOST, 4 * total // cells))
    parts = [(r["cell"], -(-r["n"] // most)) for r in per_cell if r["n"] > most]
    parts = F.broadcast(nodes.sparkSession.createDataFrame(parts, "cell int, parts long"))
    # cells that end in the same bits share a unit
    units = min(CELL_BITS, max(0, (total // TABLES // UNIT).bit_length()))
    same = F.lit((-1 << CELL_BITS) | ((1 << units) - 1)).cast("int")
    words = [F.col("words")[i].alias(f"w{i}") for i in range(NEAR_WORDS)]
    met = nodes.filter("size > 0").select("key", "size", *words, F.explode("cells").alias("cell")).join(parts, "cell", "left")
    met = met.withColumn("unit", F.when(F.col("parts").isNull(), F.col("cell").bitwiseAND(same)).otherwise(F.col("cell") + cells))
    met = met.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("parts")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("key", "size", *[f"w{i}" for i in range(NEAR_WORDS)], "cell", "unit", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return met.groupBy("unit", "i", "j").applyInPandas(_near_unit, "u long, v long").distinct()


def near_links(sketches: DataFrame) -> DataFrame:
    """(u, v): verified links between set keys of sketches(row, key, size, words, cells, text) that join what all such links join."""
    spark, before = sketches.sparkSession, common.made()
    # one row for each key: rows are found by number, so copies of a text never gather
    one, _ = common.materialize(sketches.groupBy("key").agg(F.min("row").alias("row")).select("row"))
    nodes, _ = common.materialize(sketches.select("row", "key", "size", "words", "cells").join(one, "row", "left_semi"))
    stars, _ = common.materialize(_candidate_edges(nodes))
    groups, _ = components(stars)
    groups = groups.select(F.col("node").alias("key"), "root")

    # small groups share a cell; every chunk of a large one meets every other chunk once, and itself
    sizes, _ = common.materialize(groups.groupBy("root").agg(F.count("*").alias("n")))
    few, total = sizes.agg(F.sum(F.when(F.col("n") <= CELL, F.col("n"))), F.sum("n")).first()
    large = F.col("held") > CELL
    cell = F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(max(1, 4 * (few or 0) // CELL)).cast("long")))
    chunks = F.when(large, F.ceil(F.col("held") / CELL).cast("long")).otherwise(F.lit(1).cast("long"))
    sized = common.join_hot(groups, sizes.withColumn("held", F.col("n")), "root", total or 0)
    placed = sized.select("key", "root", large.alias("large"), cell.alias("cell"), chunks.alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    wanted, _ = common.materialize(placed.join(nodes.select("key", "row"), "key"))
    _, texts = common.sift(sketches.select("row", "text"), wanted, "row")
    texts = texts.join(wanted, "row")
    texts = texts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    texts = texts.select("key", "root", "text", "large", "cell", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    found, found_path = common.materialize(texts.groupBy("large", "cell", "i", "j").applyInPandas(_near_cell, "u long, v long").distinct())
    common.release(spark, before, found_path)
    found.tessera_path = found_path
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near-duplicates: the one whose id names the class.

    Here two texts link when the Jaccard similarity of their sets of five-word
    shingles is 0.8 or more. Of rows that share that id and the set, the first
    that is read stays. Texts without a word, null ones included, are one class;
    null ids are treated as in near_duplicates(); very long texts are compared
    whole; an empty table gives an empty result; extra columns, whatever their
    names, pass through.
    """
    common.bound_batches(docs.sparkSession)
    added = ["row", "key", "size", "words", "cells"]
    row, key, *_ = names = [common.fresh(docs, x) for x in added]
    rows = docs.select(F.col(text_col).cast("string").alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = ", ".join([f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(docs.columns))] + ["row long, key long, size long, words array<long>, cells array<int>"])
    printed, _ = common.materialize(rows.mapInArrow(_sketch_batches, schema).toDF(*docs.columns, *names))
    sketches = printed.select(*[F.col(n).alias(x) for n, x in zip(names, added)], F.col(text_col).cast("string").alias("text"))
    prints = printed.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(key).alias("fp"))
    classes, _ = common.materialize(_classes(prints.select("id", "fp"), near_links(sketches)).select(F.col("fp").alias("class_key"), F.col("component_id").alias("class_id")))
    named = (prints["fp"] == classes["class_key"]) & prints["id"].eqNullSafe(classes["class_id"])
    first, _ = common.materialize(prints.join(classes, named, "left_semi").groupBy("id", "fp").agg(F.min("row").alias(row)).select(row))
    # texts travel only where a row may be one of those that go
    gone = prints.select(F.col("row").alias(row)).join(first, row, "left_anti")
    stay, others = common.sift(printed, gone, row)
    return stay.unionByName(others.join(first, row, "left_semi")).select(*docs.columns)


def hex_print(fp: Column) -> Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
