"""Small tables with the awkward rows that every operator must take."""

import random

LONG = "word " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(["ba", "ce", "di", "fo", "gu"], k=rng.randint(1, 4))) for _ in range(200)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(5, 300))).capitalize() + "."
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
    base = rows[7][1].split()
    rows += [(n, " ".join(base), "en", "src0", 1), (n + 1, " ".join([*base[:-1], "changed"]), "en", "src1", 1), (n + 2, rows[7][1], None, None, None)]
    rows += [(n + 3, None, None, None, None), (n + 4, "", "en", "src2", 0), (n + 5, LONG, "en", "src3", len(LONG)), (None, "no id here at all", "en", "src4", 17)]
    rows += [(n + 6, "twice the same row", "de", "src1", 18)] * 2 + [(n + 7, " \t\n ", "de", "src1", 4), (n + 8, "Ünïcode 😀 text <|endoftext|> Don't 3.5x", "fr", "src1", 10)]
    return rows


def frame(spark, rows=None, schema: str = DOCS, slices: int = 3):
    rows = documents() if rows is None else rows
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, schema).repartition(slices)
