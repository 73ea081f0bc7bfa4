import hashlib
import math
import random
import re

import pytest
from fixtures import DOCS, documents, frame
from pyspark.sql import functions as F

from tessera.llm import pii_sanitize as p

# the stated patterns, as they stand
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, x in STATED.items() for m in re.finditer(x, text) if holds(k, m[0]))


def test_spans_against_stated_patterns():
    rng = random.Random(5)
    parts = ["1", "4", "25", "255", "0", ".", ".", "@", "a", "-", " ", "+", "(", "4111111111111111", "x.", "\n", "%", "9", "00", "é", "😀"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 24)))
        assert p.written(p.base_spans(text)) == slow_spans(text), text


def test_long_runs_are_linear():
    assert p.base_spans("1" * 200_000) == [] and p.base_spans("a." * 100_000 + "@") == []
    assert len(p.base_spans("x@y." * 50_000)) >= 1


def test_report(spark):
    rows = documents() + [(900, "mail a.b@c.de 😀 and 10.0.0.1, +1 (555) 123-4567; 4111 1111 1111 1111", "en", "s", 1)]
    got = {r["doc_id"]: r for r in p.report(frame(spark, rows).withColumn("row", F.lit(1)).withColumn("base", F.lit(2))).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, text, *_ in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(slow_spans(text or "").encode()).hexdigest()
    r = got[900]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) and r["spans"] == slow_spans(rows[-1][1])


@pytest.fixture()
def disclosed(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 9)) + "q" for _ in range(n))
    rows = [(i, f"{filler(20)} Xavierson the boss x.son@corp.example {filler(20)}", "en", "s", 1) for i in range(6)]
    rows += [(10 + i, f"{filler(30)} the boss {filler(9)}", "en", "s", 1) for i in range(200)]
    rows += [(300 + i, "copy of Zedname zed@corp.example always equal", "en", "s", 1) for i in range(50)]
    return rows


def test_disclosing_terms(spark, disclosed):
    got = {r["doc_id"]: r["spans"] for r in p.report(frame(spark, disclosed)).collect()}
    for i, text, *_ in disclosed:
        terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].split(",") if s) if k == "term"]
        assert terms == (["Xavierson"] if i < 6 else []), (i, terms)


def test_sanitised_texts(spark, disclosed):
    rows = {r["doc_id"]: r for r in p.sanitise(frame(spark, disclosed + [(999, None, "en", "s", 5)])).collect()}
    assert "[TERM] the boss [EMAIL]" in rows[0]["text"] and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[10]["text"] == dict((r[0], r[1]) for r in disclosed)[10] and rows[999]["text"] is None


def told(spark, rows):
    """{id: the words of its term spans}"""
    texts = {r[0]: r[1] for r in rows}
    spans = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x.startswith("term:")] for r in p.report(frame(spark, rows)).collect()}
    return {i: [texts[i][int(a) : int(b)] for _, a, b in found] for i, found in spans.items()}


def prose(rng, n):
    return " ".join("w" + str(rng.randint(0, 60)) for _ in range(n))


def test_terms_far_away_and_repeated(spark):
    rng = random.Random(6)
    rows = [(i, f"Quillfeather, {prose(rng, 90)} x.son@corp.example {prose(rng, 60)} Quillfeather", "en", "s", 1) for i in range(2)]
    rows += [(10 + i, prose(rng, 120), "en", "s", 1) for i in range(2500)]
    got = told(spark, rows)
    assert {i: t for i, t in got.items() if t} == {0: ["Quillfeather,", "Quillfeather"], 1: ["Quillfeather,", "Quillfeather"]}


@pytest.mark.parametrize("copies", [1, 1000])
def test_copies_are_no_evidence(spark, copies):
    rng = random.Random(7)
    different = [f"{prose(rng, 20)} Quillfeather x.son@corp.example {prose(rng, 20)}" for _ in range(3)]
    rows = [(i * 1000 + c, t, "en", "s", 1) for i, t in enumerate(different) for c in range(copies)]
    rows += [(10_000 + i, prose(rng, 60), "en", "s", 1) for i in range(400)]
    got = told(spark, rows)
    assert all(t == (["Quillfeather"] if i < 10_000 else []) for i, t in got.items())


def brute_terms(rows):
    """{id: term spans} by the definition, over distinct texts in plain sets."""
    texts = {t or "" for _, t, *_ in rows}
    words = lambda t: [(m[0], m.start(), m.end()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", t)]
    term = lambda w: re.sub(r"^\W+|\W+$", "", w.lower())
    base = {t: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in slow_spans(t).split(",") if s)] for t in texts}
    outside = {t: [(term(w), a, b) for w, a, b in words(t) if all(b <= x or a >= y for _, x, y in base[t]) and any(c.isalpha() for c in term(w))] for t in texts}
    entities = {t: {k + ":" + "".join(c for c in t[a:b].lower() if c.isalnum() or c in "@.") for k, a, b in base[t]} for t in texts}
    n = {}
    for t in texts:
        for w in {term(w) for w, _, _ in words(t)}:
            n[w] = n.get(w, 0) + 1
    told = set()
    for e in set().union(*entities.values()):
        holding = [t for t in texts if e in entities[t]]
        share = len(holding) / len(texts)
        for w in {w for t in holding for w, _, _ in outside[t]}:
            both = sum(w in {x for x, _, _ in outside[t]} for t in holding)
            given = (both - 1 + p.PRIOR * share) / (n[w] - 1 + p.PRIOR)
            if both > 1 and share < 1 and math.log2(given / share) >= p.DISCLOSURE * -math.log2(share):
                told.add(w)
    return {i: [(a, b) for w, a, b in outside[t or ""] if w in told] for i, t, *_ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_term_spans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    people = [(f"Name{k}er", f"n{k}@corp.example", f"+1 555 010 00{k:02}") for k in range(12)]
    rows = []
    for i in range(1500):
        text = prose(rng, rng.randint(5, 40)).split()
        if rng.random() < 0.06:
            name, mail, phone = rng.choice(people)
            for extra in rng.sample([name, name + ",", mail, phone, "10.1.2.3", f"town{rng.randint(0, 3)}"], 4):
                text.insert(rng.randint(0, len(text)), extra)
        elif rng.random() < 0.01:
            text.insert(0, rng.choice(people)[0])
        rows.append((i, " ".join(text), "en", "s", 1))
    rows += [(2000 + i, rng.choice(rows)[1], "en", "s", 1) for i in range(200)] + [(3000, None, None, None, None), (3001, "", "en", "s", 0), (None, "no id", "en", "s", 1)]
    expected = brute_terms(rows)
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("term:")] for r in p.report(frame(spark, rows)).collect()}
    assert got == expected and sum(map(len, expected.values())) > 20


def test_terms_are_sanitised_away_from_their_entity(spark, disclosed):
    more = [*disclosed, (700, "Xavierson lives here", "en", "s", 1), (700, "Xavierson lives here", "en", "s", 1)]
    rows = [r for r in p.sanitise(frame(spark, more).withColumn("row", F.lit("kept"))).collect() if r["doc_id"] == 700]
    assert [(r["text"], r["n_chars"], r["row"]) for r in rows] == [("[TERM] lives here", 17, "kept")] * 2


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.2.3", "1.2.3." + "0" * 5000 + "7", "9" * 5000 + ".1.1.1", "4" + " 1" * 5000, "+1" + " (5)" * 5000 + "5", "a@" + "1" * 5000 + ".com", "@" * 5000])
def test_long_digit_runs(text):
    if not text.startswith("9" * 5000):
        assert [s for s in p.written(p.base_spans(text)).split(",") if s and s.startswith("ip")] == (["ip:0:5006"] if text[0] == "0" else ["ip:0:5007"] if text.startswith("1.2") else [])
    else:
        assert p.base_spans(text) == []


def test_empty(spark):
    assert p.report(frame(spark, [], DOCS)).collect() == [] and p.sanitise(frame(spark, [], DOCS)).collect() == []
