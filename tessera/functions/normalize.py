"""Text normalisation as column expressions: cleaning, tokens, skeletons, numbers.

Everything here stays inside the JVM. Null and empty strings normalise to an
empty string or an empty array.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocab

ACRONYM = r"(?U)\b(?:[A-Za-z]\.){2,}[A-Za-z]?\.?"
INDIC_WORD = r"(?U)[\wऀ-ൿ]+"
NON_LATIN = r"[^\x00-\x7FÀ-ɏ]"
ORDINAL = "^[0-9]+(st|nd|rd|th)$"
BOUNDARY = "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])"
LAST_LATIN = "\u024F"
OPEN, CLOSE, INHERENT = "\u0001", "\u0002", "\u0003"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def replace_matches(s: Column, pattern: str, body) -> Column:
    """s with body(match) in place of each match of pattern: marks matches, then rewrites the marked pieces."""
    pieces = F.split(F.regexp_replace(s, pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    one = lambda x: F.when(x.contains(CLOSE), F.concat(body(F.substring_index(x, CLOSE, 1)), F.substring_index(x, CLOSE, -1))).otherwise(x)
    return F.when(s.rlike(pattern), F.array_join(F.transform(pieces, one), "")).otherwise(s)


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII in it: (from, to) one by one, and the rest."""
    one, other, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(ch):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii():
            one.append(ch)
            other.append(plain)
        elif any(c.isascii() and c.isalnum() for c in plain):
            several[ch] = plain
    return "".join(one), "".join(other), several


def fold(s: Column) -> Column:
    """s without diacritics: compatibility characters decomposed, combining marks dropped."""
    one, other, several = _foldings()
    latin = {c: plain for c, plain in several.items() if c <= LAST_LATIN}
    few = [(c, plain) for c, plain in zip(one, other) if c <= LAST_LATIN]
    light = F.translate(_spelled(s, latin), "".join(c for c, _ in few), "".join(plain for _, plain in few))
    full = F.regexp_replace(F.translate(_spelled(s, several), one, other), _combining(), "")
    # Latin letters alone need neither the long tables nor the class of marks
    return F.when(s.rlike(rf"[^\x00-{LAST_LATIN}]"), full).otherwise(light)


def _spelled(s: Column, several: dict[str, str]) -> Column:
    """s with each character that stands for several ones spelled out."""
    table = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    char = lambda c: F.coalesce(F.try_element_at(table, c), c)
    return F.when(s.rlike("[" + "".join(several) + "]"), F.array_join(F.transform(F.split(s, ""), char), "")).otherwise(s)


@cache
def _combining() -> str:
    """A character class of all marks with a combining class."""
    marks = {c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))}
    starts, ends = sorted(c for c in marks if c - 1 not in marks), sorted(c for c in marks if c + 1 not in marks)
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends)) + "]"


def fold_latin(s: Column) -> Column:
    """Canonical folding of the studio dialect: only the marks U+0300 to U+036F go."""
    one, other = zip(*[(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := [x for x in unicodedata.normalize("NFD", chr(c)) if not 0x300 <= ord(x) <= 0x36F]) == 1 and d[0] != chr(c)])
    return F.regexp_replace(F.translate(s, "".join(one), "".join(other)), r"[̀-ͯ]", "")


def clean(c: Column | str, dialect: str = "batch") -> Column:
    """Dotted acronyms joined, diacritics dropped, lower case, & and + as words, the rest of punctuation as spaces."""
    s = replace_matches(text_of(c), ACRONYM, lambda m: F.replace(m, F.lit("."), F.lit("")))
    # only what is not ASCII is folded, run by run
    s = replace_matches(s, r"[^\x00-\x7F]+", fold) if dialect == "batch" else F.when(s.rlike(r"[^\x00-\x7F]"), fold_latin(s)).otherwise(s)
    s = F.lower(s)
    for old, new in (("&", " and "), ("+", " and "), ("'", "")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def strip_zeros(t: Column) -> Column:
    """Leading zeros of an all-digit token go; a run of zeros is one."""
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(t)


def repair_digits(t: Column) -> Column:
    """Digits typed for letters, in tokens with two letters or more that are no ordinals."""
    letters = F.length(F.regexp_replace(t, "[^a-z]", ""))
    mixed = ~t.rlike("^[a-z]+$") & (letters >= 2) & ~t.rlike(ORDINAL)
    return F.when(mixed, F.translate(t, *vocab.DIGIT_AS_LETTER)).otherwise(t)


def replace_indic_words(s: Column, words: dict[str, str] | None = None) -> Column:
    """Known words of Indian scripts in Latin."""
    known = F.create_map(*[F.lit(x) for kv in (words or vocab.INDIC_WORDS).items() for x in kv])
    return replace_matches(s, INDIC_WORD, lambda w: F.coalesce(F.try_element_at(known, w), w))


def transliterate(s: Column) -> Column:
    """Devanagari letter by letter; a consonant that no vowel sign follows carries an a."""
    consonants, vowels = ("".join(map(chr, t)) for t in (vocab.DEVANAGARI_CONSONANTS, vocab.DEVANAGARI_VOWELS))
    out = F.regexp_replace(s, f"([{consonants}])(?![{vowels}])", f"$1{INHERENT}")
    table = {chr(c): latin for t in (vocab.DEVANAGARI_CONSONANTS, vocab.DEVANAGARI_VOWELS) for c, latin in t.items()} | {INHERENT: "a"}
    single = {c: latin for c, latin in table.items() if len(latin) == 1}
    for c, latin in table.items():
        if len(latin) != 1:
            out = F.replace(out, F.lit(c), F.lit(latin))
    return F.when(s.rlike(f"[{consonants}{vowels}]"), F.translate(out, "".join(single), "".join(single.values()))).otherwise(s)


def name_tokens(c: Column | str, dialect: str = "batch") -> Column:
    """Tokens of a name: Indian scripts in Latin, cleaned, digits repaired, zeros stripped."""
    s = text_of(c)
    if dialect == "batch":
        known = replace_indic_words(s)
        foreign = F.when(known.rlike(NON_LATIN), transliterate(known)).otherwise(known)
    else:
        foreign = replace_indic_words(s, {w: vocab.INDIC_WORDS[w] for w in vocab.STUDIO_INDIC_WORDS})
    latin = F.when(s.rlike(NON_LATIN), foreign).otherwise(s)
    return F.transform(tokens(clean(latin, dialect)), lambda t: strip_zeros(repair_digits(t)))


def address_tokens(c: Column | str, dialect: str = "batch") -> Column:
    """Tokens of an address: cleaned, split between letters and digits, zeros stripped."""
    return F.transform(tokens(F.regexp_replace(clean(c, dialect), BOUNDARY, " ")), strip_zeros)


def skeleton(t: Column) -> Column:
    """Consonant skeleton of an alphabetic token; empty below two letters."""
    s = F.translate(F.replace(t, F.lit("ph"), F.lit("f")), *vocab.SOUND_ALIKE)
    s = F.regexp_replace(F.regexp_replace(s, "[aeiouyh]", ""), r"(.)\1+", "$1")
    return F.when(t.rlike("^[a-z]+$") & (F.length(s) >= 2), s).otherwise("")


def skeleton_text(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.nullif(skeleton(t), F.lit("")), t)), " ")


def core_tokens(toks: Column, country: Column) -> Column:
    """Tokens without the country's frequent words (US for other countries), unless none is left."""
    lists = F.create_map(*[x for k, w in vocab.FREQUENT_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])
    stop = F.coalesce(F.try_element_at(lists, country), F.array(*map(F.lit, vocab.FREQUENT_WORDS["US"])))
    rest = F.filter(toks, lambda t: ~F.array_contains(stop, t))
    return F.when(F.size(rest) == 0, toks).otherwise(rest)


def numbers(toks: Column, dialect: str = "batch") -> Column:
    """The first four numeric tokens; the studio dialect drops repeats first."""
    found = F.filter(toks, lambda t: t.rlike("^[0-9]+$"))
    return F.slice(found if dialect == "batch" else F.array_distinct(found), 1, 4)
