"""Personal data: patterns, and terms that disclose the entities the patterns find.

Patterns find e-mail and IP addresses, card and phone numbers. What they find
are protected entities. A term near an entity discloses it when knowing the term
all but gives the entity away. In information terms, over the corpus,

    PMI(term, entity) = log2 p(entity | term) / p(entity)
    IC(entity)        = -log2 p(entity)

and the term is disclosing when PMI >= DISCLOSURE * IC. All counts are of
distinct texts: those with the term, with the entity, with both, and all. So
copies of a text, however many, are neither evidence for nor against. The text
at hand can't vouch for itself, and few texts say little, hence p(entity | term)
is the held-out estimate, smoothed by PRIOR texts of the corpus' own share:

    (both - 1 + PRIOR * p(entity)) / (with term - 1 + PRIOR)

A term met with an entity in one text only gets p(entity) at most, which tells
nothing. Disclosing terms are generalised, like the entities themselves, to a
marker of their kind, wherever they stand, in any text; everything else stays.

One pass over the texts finds spans and, of texts with an entity, the terms. How
many texts hold a term is counted over all texts in a second pass, which passes
on only terms that may disclose (a bitmap of BITS bits says which may be, an
equi-join decides). Texts that may be copies (another bitmap) are counted apart,
once each. The last pass finds spans again and the places of disclosing terms,
by bitmap and equi-join likewise.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DISCLOSURE = 0.9
#: Texts that the smoothing adds.
PRIOR = 1
BITS = 1 << 22
SEED = 42
SALTS = 16

Span = tuple[str, int, int]

# Linear forms of the stated patterns: a match can only begin where a run of its
# characters begins, so the search starts there and nowhere else.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_EDGE = re.compile(r"^\W+|\W+$")
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = end = m.end()
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, kind by kind, then by start."""
    spans: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def term(word: str) -> str:
    """A word as terms compare: lower case, without punctuation around it."""
    return _EDGE.sub("", word.lower())


def _hash(s: str) -> int:
    x = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), SEED)
    return x - (1 << 64) if x >> 63 else x


def written(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, TERM))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))


def _entities(text: str, spans: list[Span]) -> list[int]:
    """The distinct entities of the spans."""
    values = ((kind, "".join(ch for ch in text[a:b].lower() if ch.isalnum() or ch in "@.")) for kind, a, b in spans)
    return sorted({_hash(f"{kind}:{value}") for kind, value in values})


def _term_hash(word: str) -> int | None:
    """The hash of a word's term; none where it has no letter."""
    t = term(word)
    return _hash(t) if any(map(str.isalpha, t)) else None


def _words(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """Every word outside the spans, with its place."""
    taken, at = sorted((a, b) for _, a, b in spans), 0
    ends = list(accumulate((b for _, b in taken), max))
    for m in _WORD.finditer(text):
        x, y = m.span()
        while at < len(taken) and ends[at] <= x:
            at += 1
        if not (at < len(taken) and taken[at][0] < y):
            yield m[0], x, y


_FOUND_SCHEMA = "row long, print long, entities array<long>, terms array<long>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text a print, its entities and, if it has one, its distinct terms outside the spans."""
    from pyspark import TaskContext

    common.remembered("pii")
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        prints, entities, terms = [], [], []
        for text in (t or "" for t in batch.column(0).to_pylist()):
            spans = base_spans(text)
            prints.append(_hash(text))
            entities.append(_entities(text, spans))
            own = {w for w, _, _ in _words(text, spans)} if spans else ()
            terms.append(sorted({h for h in map(_term_hash, own) if h is not None}))
        rows = pa.array(range(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([rows, pa.array(prints, pa.int64()), pa.array(entities, lists), pa.array(terms, lists)], ["row", "print", "entities", "terms"])


_PLACES = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_MARKED_SCHEMA = "row long, base string, places array<struct<term:long,start:long,end:long>>"


def _mark(bitmap: bytes | None):
    """Base spans of each text, and the places of words outside them whose terms are in the bitmap (None: of none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.remembered("pii")
        row, known = TaskContext.get().partitionId() << 40, {}
        for batch in batches:
            base, places = [], []
            for text in (t or "" for t in batch.column(0).to_pylist()):
                spans = base_spans(text)
                base.append(written(spans))
                told = _known_terms(text, bitmap, known) if bitmap else {}
                places.append(_places(text, spans, told) if told else [])
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows, pa.array(base, pa.string()), pa.array(places, _PLACES)], [*batch.schema.names[1:], "row", "base", "places"])

    return run


def _places(text: str, spans: list[Span], told: dict[bytes, int]) -> list[dict]:
    """Where the told words stand outside the spans."""
    wanted = {w.decode("utf-8", "surrogatepass"): h for w, h in told.items()}
    hits = [m for m in _WORD.finditer(text) if m[0] in wanted]
    return [{"term": wanted[m[0]], "start": m.start(), "end": m.end()} for m in hits if all(b <= m.start() or a >= m.end() for _, a, b in spans)]


#: Words whose terms a worker remembers.
CACHED_WORDS = 200_000


def _known_terms(text: str, bitmap: bytes, known: dict[bytes, int | None]) -> dict[bytes, int]:
    """The text's words whose terms are in the bitmap, with the hashes of these."""
    if len(known) > CACHED_WORDS:
        known.clear()
    words = set(text.encode("utf-8", "surrogatepass").split())
    for word in words.difference(known):
        t = _term_hash(word.decode("utf-8", "surrogatepass"))
        known[word] = t if t is not None and _in(bitmap, t) else None
    return {w: t for w in words if (t := known[w]) is not None}


def _in(bitmap: bytes, h: int) -> bool:
    place = h % BITS
    return bool(bitmap[place >> 3] >> (place & 7) & 1)


def _count_terms(bitmap: bytes, copied: bytes | None):
    """How many texts hold a term of the bitmap; those that may be copies are left out, if a bitmap of them is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembered("pii")
        known: dict[bytes, int | None] = {}
        counts: Counter = Counter()

        def rows(at_least: int) -> Iterator[pa.RecordBatch]:
            if len(counts) >= at_least:
                names = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([counts[t] for t in names], pa.int64())], ["term", "n"])
                counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if copied and _in(copied, _hash(text or "")):
                    continue
                counts.update(set(_known_terms(text or "", bitmap, known).values()))
            yield from rows(50_000)
        yield from rows(1)

    return run


def _copied_texts(copied: bytes):
    """The texts, with their prints, that may be copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [(h, t) for t in batch.column(0).to_pylist() if t and _in(copied, h := _hash(t))]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in some], pa.int64()), pa.array([t for _, t in some], pa.string())], ["print", "t"])

    return run


def _bitmap(hashes: DataFrame) -> bytes:
    """Which of BITS places the longs of the one column take: at most BITS / 32 longs reach the driver."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(BITS).cast("long"))
    words = hashes.select(place.alias("p")).select(F.shiftright("p", 5).alias("w"), F.expr("shiftleft(1L, cast(p % 32 as int))").alias("b"))
    bits = bytearray(BITS // 8)
    for w, b in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bits[4 * w : 4 * w + 4] = b.to_bytes(4, "little")
    return bytes(bits)


def disclosing(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, entity) pairs whose term discloses the entity.

    found has row, print, entities and terms of every text; texts is the whole corpus in one column.
    """
    spark = found.sparkSession
    prints = found.groupBy("print").agg(F.count("*").alias("n"))
    total = max(1, prints.count())
    once = found.filter(F.size("entities") > 0).groupBy("print").agg(F.min("row").alias("row"))
    once = found.join(once.select("row"), "row", "left_semi")
    of_entity = once.select("row", F.explode("entities").alias("entity"))
    # in one text only, an entity is disclosed by no term; likewise a term met with entities in one text only
    with_entity = of_entity.groupBy("entity").agg(F.count("*").alias("of_entity")).filter("of_entity > 1")
    with_entity, _ = common.materialize(with_entity)
    most = with_entity.agg(F.max("of_entity")).first()[0]
    if most is None:
        return spark.createDataFrame([], "term long, entity long")
    places, _ = common.materialize(of_entity.join(with_entity, "entity").select("row", "entity", "of_entity"))

    def reveals(n: str) -> Column:
        """PMI >= DISCLOSURE * IC, for a term in n texts."""
        share = F.col("of_entity") / F.lit(total)
        given = (F.col("together") - 1 + PRIOR * share) / (F.col(n) - 1 + PRIOR)
        information = -F.log2(share)
        return (information > 0) & (F.log2(given) + information >= DISCLOSURE * information)

    # texts with an entity that hold a term are no more than all texts that do: what they hold too often is out at once
    known = once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("k")).filter("k > 1")
    known, _ = common.materialize(known)
    most_often = math.ceil(PRIOR + most * (total / most) ** (1 - DISCLOSURE))  # both <= of_entity
    held = once.join(places.select("row").distinct(), "row", "left_semi").select("row", F.explode("terms").alias("term"))
    everywhere = F.col("k") > max(most_often, common.HOT_SHARE * (known.agg(F.sum("k")).first()[0] or 0))
    held = held.join(F.broadcast(known.filter(everywhere).select("term")), "term", "left_anti")  # 1 / HOT_SHARE terms at most
    held = held.join(known.filter(F.col("k") <= most_often), "term")
    pairs = held.join(places, "row").groupBy("term", "entity", "of_entity", "k").agg(F.count("*").alias("together")).filter("together > 1")
    pairs, _ = common.materialize(pairs.filter(reveals("k")))
    if pairs.isEmpty():
        return spark.createDataFrame([], "term long, entity long")
    bitmap, copied = _bitmap(pairs.select("term").distinct()), _bitmap(prints.filter("n > 1").select("print"))
    common.bound_batches(spark)
    singly = texts.mapInArrow(_count_terms(bitmap, copied), "term long, n long")
    copies = texts.mapInArrow(_copied_texts(copied), "print long, t string").groupBy("print").agg(F.first("t").alias("t")).select("t")
    holding = singly.unionByName(copies.mapInArrow(_count_terms(bitmap, None), "term long, n long")).groupBy("term").agg(F.sum("n").alias("n"))
    return pairs.join(holding, "term").filter(reveals("n")).select("term", "entity")


def find(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns carry of docs as c0, c1 ..., base spans as text and the array of all method spans.

    A null text is an empty one. The result reads a table in the shared folder.
    """
    common.bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    spark, before = docs.sparkSession, common.made()
    found, _ = common.materialize(docs.select(text.alias("t")).mapInArrow(_find, _FOUND_SCHEMA))
    reveal, reveal_path = common.materialize(disclosing(found, docs.select(text.alias("t"))).select("term").distinct())
    bitmap = None if reveal.isEmpty() else _bitmap(reveal)
    common.release(spark, before, reveal_path)
    rows = docs.select(text.alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    schema = ", ".join([f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry))] + [_MARKED_SCHEMA])
    marked, _ = common.materialize(rows.mapInArrow(_mark(bitmap), schema))
    if bitmap is None:
        common.discard(spark, reveal_path)
        return marked.drop("row", "places").withColumn("terms", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    # a term may stand in any number of texts: the few places that the bitmap lets through meet the terms, salted by row
    placed = marked.select("row", F.explode("places").alias("w")).select("row", "w.*").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    salted = reveal.withColumn("salt", F.explode(F.lit(list(range(SALTS)))))
    spans = placed.join(salted, ["term", "salt"]).select("row", "start", "end")
    terms = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("terms"))
    return marked.drop("places").join(terms, "row", "left").drop("row")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: counts of base spans, their digest, and all spans as text.

    Null and empty texts have no spans; null ids and repeated rows keep their
    rows; very long texts are searched whole; an empty table gives an empty
    result; other columns are ignored. Offsets are code points, end exclusive.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = find(ids, ["doc_id"]).withColumnRenamed("c0", "doc_id")
    listed = F.filter(F.split("base", ","), lambda s: s != "")
    counts = [F.coalesce(F.regexp_count("base", F.lit(rf"(^|,){k}:")), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    extra = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda t: F.concat_ws(":", F.lit(TERM), t["start"].cast("string"), t["end"].cast("string")))
    spans = F.array_join(F.concat(listed, extra), ",")
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def _redacted(text: str, base: str, terms: list) -> str:
    spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in base.split(",") if s)] + [(t["start"], t["end"], TERM) for t in terms or ()]
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redact(text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, base, terms = batch.columns
            texts = [None if t is None else _redacted(t, b, s) for t, b, s in zip(columns[text_at].to_pylist(), base.to_pylist(), terms.to_pylist())]
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])

    return run


def sanitise(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with every span of the text replaced by a marker of its kind; chars_col, if it is a long, counts the new text.

    Of spans that overlap, the one that starts first is replaced, and what the
    others hold beyond it goes with it. A null text stays null with a null
    count; empty texts stay; very long texts are rewritten whole; null ids and
    repeated rows keep their rows; an empty table gives an empty result; other
    columns, whatever their names, pass through.
    """
    carry = docs.columns
    found = find(docs, carry, text_col)
    rows = found.select(*[f"c{i}" for i in range(len(carry))], "base", "terms")
    schema = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    at = carry.index(chars_col) if chars_col in carry and rows.schema[f"c{carry.index(chars_col)}"].dataType.simpleString() == "bigint" else None
    return rows.mapInArrow(_redact(carry.index(text_col), at), schema).toDF(*carry)
