import numpy as np
import pytest
from fixtures import frame
from test_near_copies import planted, slow_classes

from tessera.llm import simhash_dedup as s


def pairs_of_sets(both, left, right, n, seed=1):
    """n pairs of sets that share `both` shingles and hold so many of their own."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        h = rng.integers(0, 1 << 64, both + left + right, dtype=np.uint64)
        yield np.sort(h[: both + left]), np.sort(np.delete(h, slice(both, both + left)))


@pytest.mark.parametrize("sizes", [(4, 0, 1), (8, 0, 2), (9, 1, 1), (20, 0, 5), (320, 40, 40), (320, 0, 80)])
def test_simhash_keys_and_pivots_find_pairs_at_the_limit(sizes):
    pairs = list(pairs_of_sets(*sizes, 1500))
    a, b = (np.stack([s._set_print(p[k]) for p in pairs]) for k in (0, 1))
    cells_a, cells_b = s._cells_of(a), s._cells_of(b)
    n = np.array([[len(p[0]), len(p[1])] for p in pairs])
    found = set()
    for t in range(s.TABLES):
        at = np.concatenate([cells_a[:, t], cells_b[:, t]])
        found |= {tuple(sorted(x)) for x in s.near_candidates(np.concatenate([a, b]), n.T.ravel(), at)}
    missed = [i for i in range(len(pairs)) if (i, i + len(pairs)) not in found]
    assert len(missed) <= 3, len(missed)


def test_print_of_a_long_set():
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    words = s._set_print(hashes)
    ones = [sum(int(h) >> b & 1 for h in hashes) for b in range(0, 64, 9)]
    assert [int(words[0]) >> b & 1 for b in range(0, 64, 9)] == [int(2 * x > len(hashes)) for x in ones]


def test_pivot_tables_discard_and_never_a_near_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, s.NEAR_WORDS, dtype=np.uint64)
    near, far = base.copy(), base.copy()
    for b in rng.choice(256, s.NEAR_BITS[1], replace=False):
        near[b >> 6] ^= np.uint64(1 << int(b & 63))
    far[1:] = s._NEAR_REFERENCES[0][1:]  # next to a pivot, with the same first word
    prints = np.stack([base, near, far])
    pivots, sizes = s._pivot_table(prints), np.array([9, 9, 9])
    assert s._near_pairs(prints, pivots, sizes, np.array([0, 0]), np.array([1, 2])).tolist() == [0]
    assert np.abs(pivots[0] - pivots[2]).max() > s.NEAR_BITS[1] // 2
    pivots[1, 0] = pivots[0, 0] + s.NEAR_BITS[1] + 1
    assert not len(s._near_pairs(prints, pivots, sizes, np.array([0]), np.array([1])))


def test_dense_run_stays_one_tree():
    rng = np.random.default_rng(6)
    prints = np.repeat(rng.integers(0, 1 << 64, (2, s.NEAR_WORDS), dtype=np.uint64), 300, axis=0)
    prints[:, 3] ^= rng.integers(0, 1 << 16, 600, dtype=np.uint64)
    found = s.near_candidates(prints, np.full(600, 50), s._cells_of(prints)[:, 0])
    assert len(found) == 598 and all((a < 300) == (b < 300) for a, b in found)


def test_cells_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(s, "NEAR_CHUNK", 2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"]), "en", "s", 1) for i in range(40)] + [(100 + r[0], *r[1:]) for r in planted(originals=8)]
    assert {r["doc_id"] for r in s.keep_one(frame(spark, rows)).collect()} == slow_classes(rows)
