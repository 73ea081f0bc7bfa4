import re

import numpy as np
import pytest
from fixtures import DOCS, documents, frame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import simhash_dedup as s


def slow_print(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    """prints: {node: fingerprint}; {node: smallest node reachable}."""
    nodes, label = sorted(prints), {n: n for n in prints}
    near = {n: [m for m in nodes if (prints[n] ^ prints[m]).bit_count() <= 3] for n in nodes}
    for n in nodes:
        todo, seen = [n], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        label[n] = min(seen)
    return label


def test_against_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None]
    prints = {r[0]: slow_print(r[1]) for r in rows}
    label = slow_components(prints)
    got = s.near_duplicates(frame(spark, rows).withColumn("fp", F.lit("clash"))).select("id", s.hex_print(F.col("fp")), "component_id").collect()
    assert len(got) == len(rows)
    assert all((r[1], r[2]) == (f"{prints[r[0]]:016x}", label[r[0]]) for r in got)


@pytest.mark.parametrize("hot", [2, 256])
def test_links_keep_components_in_dense_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(s, "HOT_KEY", hot)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = set(map(int, rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    label = slow_components({signed(x): x & (1 << 64) - 1 for x in prints})
    edges = s.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"))
    got = {r["node"]: r["root"] for r in s.components(edges)[0].collect()}
    assert all(got.get(n, n) == root for n, root in label.items())


def test_chunks_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT_KEY", 4)
    monkeypatch.setattr(s, "CHUNK", 16)
    base = 0x123456789ABCDEF
    prints = [base ^ (1 << b) for b in range(40)] + [base ^ (1 << b) ^ (1 << (b + 1)) for b in range(40)]
    got = s.components(s.links(spark.createDataFrame([(x,) for x in prints], "fp long")))[0].collect()
    assert {r["root"] for r in got} == {min(prints)} and len(got) == len(set(prints))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r["root"] for r in s.components(edges)[0].collect()} == {0}


def test_keep_one(spark):
    rows = documents()
    kept = s.keep_one(frame(spark, rows)).collect()
    ids = [r["doc_id"] for r in kept]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert 7 in ids and 60 not in ids and 62 not in ids and 63 in ids and 64 not in ids and 66 in ids and None in ids


def test_empty(spark):
    assert s.near_duplicates(frame(spark, [], DOCS)).collect() == []
    assert s.keep_one(frame(spark, [], DOCS)).collect() == []
