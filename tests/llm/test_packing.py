import random
import zlib

import numpy as np
import public_tokenizers
from fixtures import DOCS, documents, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing as p

PATH = public_tokenizers.path(p.TOKENIZER)
ODD = [
    "Hello <|endoftext|> World", "<|ENDOFTEXT|> x", "a0b 10.5, x", "0 0 0", "don't. é. ́.. ΑΣ. ΣΑΣ", "İstanbul!! x\xa0y, z .", "it's 's 'S", "²³. ①, x·y. ǅ.",
    "\x1c\x1d a\x1eb", "फ़. हिन्दी, กำ!", "...", "a.,b ,.; x__", "e\u0301. E\u0301, n\u0303", "\u200b.\u200d,", "", " \t\n", "日本語。テスト", "ﬁ. Ⅳ, ½!",
]


def test_ids_equal_whole_text_ids():
    own, whole = p.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aAbé0 .,!'*\n😀ß\u0301-") for _ in range(60)) for _ in range(3000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(p, "CACHED_WORDS", 50)
    own, whole = p.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for i in range(30):
        text = " ".join(f"word{chr(97 + (i * j) % 26)}x{chr(97 + j % 26)}." for j in range(40))
        assert own.encode([text])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_and_places(spark):
    rows, whole = documents(200), Tokenizer.from_file(PATH)
    got = p.pack(frame(spark, rows).withColumn("length", F.lit(0)).withColumn("offset", F.lit(0))).collect()
    expected = []
    for i, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        expected += [(i, n, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) * 1.1 + 2


def test_best_fit_with_bounded_bins():
    packer, rng, held = p.Packer(100, 8), random.Random(2), {}
    for _ in range(5000):
        n = rng.randint(1, 100)
        number, offset = packer.put(n)
        assert held.get(number, 0) == offset
        held[number] = offset + n
        assert held[number] <= 100 and packer._open <= 8
    assert sum(held.values()) / (100 * len(held)) > 0.9


def test_online_placement_is_near_the_ideal():
    rng = random.Random(3)
    lengths = [min(4096, int(rng.lognormvariate(6.5, 1.2)) + 1) for _ in range(5000)]
    packer = p.Packer()
    places = [packer.put(n) for n in lengths]
    again = p.Packer()
    assert [again.put(n) for n in lengths[:2000]] == places[:2000]  # what comes later changes nothing
    assert packer._next <= 1.02 * sum(lengths) / 4096 + 8


def test_copies_spread_over_packers(spark, monkeypatch):
    monkeypatch.setattr(p, "PACKER_TOKENS", 4096)
    got = p.pack(frame(spark, [(1, "one and the same " * 40, "en", "s", 1)] * 400), PATH).collect()
    assert len(got) == 400 and len({r["sequence_id"] >> 32 for r in got}) > 5

def test_empty(spark):
    assert p.pack(frame(spark, [], DOCS)).collect() == []
