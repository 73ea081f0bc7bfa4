import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import keys, normalize, similarity


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("S.A.S.", "sas"), ("A & B+C's", "a and b and cs"), ("M.G. Road", "mg road"), ("Csk ÁDVISORS", "csk advisors"), ("", ""), (None, ""), ("ﬁne ½ Œuvre", "fine 1 2 uvre"), ("Atelier L.L.C. and S.A.S", "atelier llc and sas"), ("été", "ete")],
)
def test_clean(spark, text, expected):
    assert one(spark, normalize.clean, text) == expected


def test_clean_agrees_with_unicode_tables(spark):
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randint(0x20, 0x24F), rng.randint(0x300, 0x36F), rng.randint(0x1E00, 0x1EFF), rng.randint(0xFB00, 0xFB06), rng.randint(0xFF10, 0xFF5A)])) for _ in range(30)) for _ in range(300)]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize.clean("t").alias("x")).collect()]
    for text, cleaned in zip(texts, got):
        s = re.sub(r"\b(?:[A-Za-z]\.){2,}[A-Za-z]?\.?", lambda m: m[0].replace(".", ""), text)
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        s = s.lower().replace("&", " and ").replace("+", " and ").replace("'", "")
        assert cleaned == re.sub("[^a-z0-9]+", " ", s).strip(), text


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("y0ga", ["yoga"]), ("21st 5equoia 3d 007", ["21st", "sequoia", "3d", "7"]), ("", []), (None, []), ("प्राइवेट लिमिटेड", ["private", "limited"]),
        ("श्री राम", ["shri", "rama"]), ("000", ["0"]), ("कंपनी", ["ka", "pani"]),
    ],
)
def test_name_tokens(spark, name, expected):
    assert one(spark, normalize.name_tokens, name) == expected


def test_address_tokens(spark):
    assert one(spark, normalize.address_tokens, "012 1604b") == ["12", "1604", "b"]


@pytest.mark.parametrize(("token", "expected"), [("private", "prvt"), ("praaivett", "prvt"), ("limited", "lmt"), ("limittedd", "lmt"), ("llc", "lk"), ("a1", ""), ("io", ""), ("works", "vrks")])
def test_skeleton(spark, token, expected):
    assert one(spark, normalize.skeleton, token) == expected


def test_keys(spark):
    def column(n, a):
        toks = normalize.name_tokens(n)
        return F.array_sort(keys.record_keys(toks, keys.skeletons(toks), normalize.address_tokens(a)))

    expected = "n:acme n:steel n:works n:llc k:km k:lk k:stl k:vrks p:km_lk p:km_stl p:km_vrks p:lk_stl p:lk_vrks p:stl_vrks c:acme c:acmesteel c:acmesteelworks a:12 a:b a:main a:st b:12_b b:b_main b:main_st"
    assert one(spark, column, "Acme Steel Works LLC", "12b Main St") == sorted(expected.split())
    assert one(spark, column, "", None) == []


@pytest.mark.parametrize(
    ("measure", "a", "b", "expected"),
    [
        (similarity.ratio, "abc", "abd", 0.8333), (similarity.ratio, "", "", 1.0), (similarity.ratio, "a", "", 0.0),
        (similarity.jaro_winkler, "martha", "marhta", 0.9611), (similarity.jaro_winkler, "abcd", "axyz", 0.55),
        (similarity.jaro_winkler, "abcdef", "bcadef", 0.9167), (similarity.jaro_winkler, "a", "b", 0.0),
        (similarity.token_set, "acme corp", "acme corp llc", 1.0), (similarity.token_set, "foo bar", "baz qux", 0.7143),
        (similarity.token_sort, "b a", "a b", 1.0), (similarity.partial, "acme", "the acme co", 1.0), (similarity.partial, "", "", 0.0),
        (similarity.no_space, "a b", "ab", 1.0),
    ],
)
def test_similarities(spark, measure, a, b, expected):
    assert round(one(spark, measure, a, b), 4) == expected
