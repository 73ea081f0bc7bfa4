"""Packs token runs into sequences of fixed length by bounded-space online best-fit.

A packer keeps at most OPEN_BINS unfinished sequences in a bitset keyed by free
space: bit f is set when some open sequence has exactly f free tokens, so the
tightest sequence that takes a piece is the lowest set bit at or above its
length. When a new sequence is needed and all bins are open, the fullest closes.

Pieces are dealt by a hash of their row, so that copies spread, to packers of
about PACKER_TOKENS tokens each. A packer is one task; it places each piece as
it comes, in a fixed order, and holds only lengths. It closes its last bins as
they are, so the space lost to splitting is a few sequences in
PACKER_TOKENS / 4096.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 512
#: Tokens of one packer: 16,384 sequences.
PACKER_TOKENS = 1 << 26
#: Words whose ids a worker remembers.
CACHED_WORDS = 300_000
#: Words encoded in one text, as a longer one costs the tokenizer more for each word, and such texts in one call, as their encodings are large.
TOGETHER, TEXTS = 200, 32


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins across ASCII white space, remembering words.

    A word is lowered in ASCII, as the tokenizer would, and loses its trailing
    ASCII punctuation, which is a run of tokens of its own behind a letter or a
    digit; what is left is encoded once, many words in one call, parted by a
    digit that none of them holds. Texts with the opening of an added token are
    encoded word by word as they stand.
    """

    PARTING = "0"  # as _learn() writes it
    TRAIL = b".,!?;:|%*$&#\"()<>[]{}=/+-_"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._ids: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._plain: dict[bytes, bytes] = {}
        (self._parting,) = self._tokenizer.encode(self.PARTING, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split: list[list[bytes]] = []
        odd: set[int] = set()
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "replace")
            if b"<|" in raw:
                odd.add(i)
                split.append(raw.split())
            else:
                split.append(raw.lower().split())
        self._learn(set().union(*(w for i, w in enumerate(split) if i not in odd)))
        self._learn_plain(set().union(*(split[i] for i in odd)))
        held = ((self._plain if i in odd else self._ids, w) for i, w in enumerate(split))
        return [b"".join(itemgetter(*w)(ids)) if len(w) > 1 else b"".join(map(ids.__getitem__, w)) for ids, w in held]

    def _learn(self, wanted: set[bytes]) -> None:
        """Makes sure that _ids has every wanted word; two generations of CACHED_WORDS words are kept."""
        if len(self._ids) > CACHED_WORDS:
            self._older, self._ids = self._ids, {}
        ids, older = self._ids, self._older
        missing = wanted.difference(ids)
        if older:
            again = missing.intersection(older)
            ids.update(zip(again, map(older.__getitem__, again)))
            missing -= again
        trail, last = self.TRAIL, frozenset(self.TRAIL)
        pointed = [w for w in missing if w[-1] in last]
        new, ended = list(missing.difference(pointed)), []
        for word in pointed:
            core = word.rstrip(trail)
            if not core or not (core[-1:].isalnum() or self._ends_in_letter(core)):
                new.append(word)
                continue
            end = word[len(core) :]
            ended.append((word, core, end))
            for part in (core, end):
                if part not in ids:
                    if part in older:
                        ids[part] = older[part]
                    else:
                        new.append(part)
        new = list(set(new))
        together = [c for c in new if b"0" not in c]
        apart = [c for c in new if b"0" in c]
        if together:
            texts = [b" 0 ".join(together[i : i + TOGETHER]).decode() for i in range(0, len(together), TOGETHER)]
            flat: list[int] = []
            for at in range(0, len(texts), TEXTS):
                for e in self._tokenizer.encode_batch_fast(texts[at : at + TEXTS], add_special_tokens=False):
                    flat += e.ids
                    flat.append(self._parting)
            found = np.array(flat, "<u4")
            ends = np.flatnonzero(found == self._parting) * 4
            if len(ends) == len(together):
                raw = found.tobytes()
                ids.update(zip(together, [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], ends.tolist())]))
            else:
                apart += together
        if apart:
            encoded = self._tokenizer.encode_batch([c.decode() for c in apart], add_special_tokens=False)
            ids.update((core, np.array(e.ids, "<u4").tobytes()) for core, e in zip(apart, encoded))
        ids.update((word, ids[core] + ids[end]) for word, core, end in ended)

    @staticmethod
    def _ends_in_letter(core: bytes) -> bool:
        last = core.decode()[-1]
        return last.isalpha() or last.isdigit()

    def _learn_plain(self, wanted: set[bytes]) -> None:
        if len(self._plain) > CACHED_WORDS:
            self._plain.clear()
        missing = [w for w in wanted if w not in self._plain]
        for word, e in zip(missing, self._tokenizer.encode_batch([w.decode() for w in missing], add_special_tokens=False)):
            self._plain[word] = np.array(e.ids, "<u4").tobytes()


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's own tokenizer, which keeps what it knows from task to task of this operator."""
    held = common.remembered("packing")
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def _piece_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        tokenizer, end = word_tokenizer(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(texts)):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, SEQUENCE)):
                    part = ids[4 * start : 4 * (start + SEQUENCE)]
                    for column, value in zip(rows, (doc_id, piece, start, len(part) // 4, zlib.crc32(part), row)):
                        column.append(value)
                row += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): each row's ids and one end id, cut only beyond SEQUENCE tokens."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_piece_batches(tokenizer_path), "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


class Packer:
    """Bounded-space online best-fit over lengths from 1 to capacity."""

    def __init__(self, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self._free = 0  # bit f: some open bin has f free
        self._bins: dict[int, list[int]] = {}
        self._open = self._next = 0

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fitting = self._free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self._open >= self.open_bins:
                self._take((self._free & -self._free).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self._next
            self._next += 1
        if left := space - length:
            self._bins.setdefault(left, []).append(number)
            self._free |= 1 << left
            self._open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        held = self._bins[space]
        number = held.pop()
        self._open -= 1
        if not held:
            del self._bins[space]
            self._free ^= 1 << space
        return number


def _pack_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    packer, base = Packer(), TaskContext.get().partitionId() << 32
    for pdf in batches:
        placed = [packer.put(n) for n in pdf["length"].tolist()]
        yield pdf.drop(columns="row").assign(sequence_id=np.array([base + s for s, _ in placed], "int64"), offset=np.array([o for _, o in placed], "int64"))


def pack(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of docs with its sequence and its place there.

    A null or empty text is one piece that holds the end id alone; a very long
    text is cut into as many pieces as it takes. Null ids and repeated rows are
    packed like any other row; pieces of equal length keep the order they come
    in; an empty table gives an empty result; other columns are ignored.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    cut, _ = common.materialize(pieces(docs, tokenizer_path, id_col, text_col))
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    dealt = F.xxhash64("row", "start")
    packers = cut.repartition(max(1, -(-tokens // PACKER_TOKENS)), dealt)
    ordered = packers.sortWithinPartitions(dealt, "row", "start")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ordered.mapInPandas(_pack_batches, schema)
