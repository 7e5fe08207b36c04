"""Best-fit packing with exact-complement hashing.

``cut`` tokenizes each text and cuts it into pieces of at most ``CAPACITY`` tokens. ``plan`` works on the histogram of
piece lengths, which has at most ``CAPACITY`` rows whatever the number of pieces: the longest length left opens a
sequence, and its gap is filled by a length, a pair or a triple that fits exactly, looked up in tables of sums and
used as often as the counts allow; without one, the longest length that fits goes in and the smaller gap is looked up
again. ``place`` gives every piece the next free slot of its length.

Defined cases: a null or empty text is one piece that holds the closing id only; rows are pieces of their own however
often they repeat; an empty table gives an empty table; other columns of the input are ignored. The pieces of rows
with equal ids are told apart by their order alone, as are ties in length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.bpe import load_tokenizer
from ferryline.llm.positions import numbered
from ferryline.llm.words import texts_of
from ferryline.session import materialise

CAPACITY = 2048
_KEPT_WORDS = 300_000
_BATCH = 4096
_ROWS = 512

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# Marks behind a letter and before white space are tokens of their own, so they are cut off before words are looked up.
_MARKS = re.compile(rb"(?<=[A-Za-z])[.,;:!?#&*$%|<>]+(?=[ \t-\r]|$)")
_PROBE = "The Größe, été!! AND it's the straße. x42 日本 Élan <|endoftext|> naïve... <&& e\u0301"


class _WordIds(dict):
    """Ids of words, worked out on first sight and many at a time.

    A tokenizer that lower-cases and parts letters from marks needs to see far fewer words: texts are lower-cased and
    marks cut off first, and a word of lower-case letters goes straight to the merges. Whether the tokenizer is of that
    kind is tried out on a probe; texts where it could matter (special tokens, combining marks) are left as they are.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        # The characters that stand for bytes in byte-level vocabularies.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.characters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.plain = True
        want = np.array(self.tokenizer.encode(_PROBE, add_special_tokens=False).ids, "<u4").tobytes()
        parts = [self.words(part) for part in (_PROBE.encode(), *map(str.encode, _PROBE.split()))]
        self.learn(set().union(*parts))
        joined = b"".join(map(self.__getitem__, parts[0])), b"".join(self[w] for part in parts[1:] for w in part)
        if joined != (want, want):
            self.plain = False
            self.clear()

    def words(self, text: bytes) -> list[bytes]:
        if self.plain and not (b"<|" in text or b"\xcc" in text or b"\xcd" in text):
            text = _MARKS.sub(rb" \g<0>", text.lower())
        return text.split()

    def _is_plain(self, word: bytes) -> bool:
        text = word.decode()
        return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def learn(self, words: set[bytes]) -> None:
        others, merge = [], self.tokenizer.model.tokenize
        for word in words.difference(self):
            if self.plain and (word.isalpha() and word.islower() or not word.isascii() and self._is_plain(word)):
                units = word.decode("latin1")
                units = units if word.isascii() else units.translate(self.characters)
                self[word] = array("I", [unit.id for unit in merge(units)]).tobytes()
            else:
                others.append(word)
        for at in range(0, len(others), _BATCH):
            some = others[at : at + _BATCH]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.update((word, array("I", e.ids).tobytes()) for word, e in zip(some, encoded, strict=True))


def cut(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every row: its ids and the closing id, in stretches of ``capacity``."""
    closing = np.array([end_id], "<u4").tobytes()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordIds(tokenizer_path)
        for batch in (part.slice(at, _ROWS) for part in batches for at in range(0, part.num_rows, _ROWS)):
            rows: list[tuple] = []
            texts = [known.words(body) for body in texts_of(batch)]
            known.learn(set().union(*texts))
            for name, words in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = b"".join(map(known.__getitem__, words)) + closing
                size = len(ids) // 4
                for piece, start in enumerate(range(0, size, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((name, piece, start, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            if len(known) > _KEPT_WORDS:
                known.clear()
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(doc_id, text).mapInArrow(emit, PIECES_SCHEMA)


@dataclass(frozen=True)
class Slots:
    """Pieces of ``length`` with ranks from ``first`` on: ``each`` to a sequence, ``count`` sequences from ``base``."""

    length: int
    first: int
    each: int
    count: int
    base: int
    offset: int


class _Sums:
    """Which available lengths, pairs and triples add up to a gap. Counts only fall, so what is gone stays gone."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.pairs: dict[int, int | None] = {}

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        large = self.pairs.get(gap, 0)
        if large is None:
            return None
        if large == 0 or self.counts[large] <= 0 or self.counts[gap - large] <= 0:
            sizes = np.arange(gap - 1, (gap - 1) // 2, -1)
            found = sizes[(self.counts[sizes] > 0) & (self.counts[gap - sizes] > 0)] if gap > 1 else sizes[:0]
            large = self.pairs[gap] = int(found[0]) if len(found) else None
        return None if large is None else (large, gap - large)

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for large in np.flatnonzero(self.counts[:gap])[::-1]:
            if 3 * large < gap:
                return None
            rest = self.pair(gap - int(large)) if gap - large > 1 else None
            if rest and rest[0] <= large:
                return (int(large), *rest)
        return None

    def exact(self, gap: int, held: Counter) -> tuple[int, ...] | None:
        """A filling of the gap that is there at least once besides what is ``held``."""
        for find in (self.single, self.pair, self.triple):
            if (found := find(gap)) and all(self.counts[v] >= n for v, n in (held + Counter(found)).items()):
                return found
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Slots for all pieces of a histogram of lengths (each from 1 to ``capacity``)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    sums, used, slots, base = _Sums(counts), np.zeros(capacity + 1, np.int64), [], 0
    for longest in range(capacity, 0, -1):
        while counts[longest] > 0:
            held, gap = Counter([longest]), capacity - longest
            while gap:
                if found := sums.exact(gap, held):
                    held.update(found)
                    break
                # No exact filling: the longest piece that fits, and another look at the gap that is left.
                fitting = [int(v) for v in np.flatnonzero(counts[: gap + 1])[::-1] if counts[v] > held[int(v)]][:1]
                if not fitting:
                    break
                held[fitting[0]] += 1
                gap -= fitting[0]
            n = min(int(counts[v]) // m for v, m in held.items())
            offset = 0
            for v, m in sorted(held.items(), reverse=True):
                slots.append(Slots(v, int(used[v]), m, n, base, offset))
                used[v] += n * m
                counts[v] -= n * m
                offset += v * m
            base += n
    return slots


def place(pieces: DataFrame, slots: list[Slots], total: int) -> DataFrame:
    """``pieces`` with sequence_id and offset. The plan travels with the tasks: its size depends on the capacity alone."""
    by_length: dict[int, np.ndarray] = {}
    for length in {s.length for s in slots}:
        own = [(s.first, s.each, s.base, s.offset) for s in slots if s.length == length]
        by_length[length] = np.array(sorted(own), np.int64)
    sent = pieces.sparkSession.sparkContext.broadcast(by_length)

    @F.pandas_udf("sequence_id long, offset long")
    def slot_of(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for value in np.unique(lengths):
            at = np.flatnonzero(lengths == value)
            first, each, base, begin = sent.value[int(value)].T
            k = np.searchsorted(first, ranks[at], side="right") - 1
            beyond = ranks[at] - first[k]
            sequence[at] = base[k] + beyond // each[k]
            offset[at] = begin[k] + beyond % each[k] * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = numbered(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], total, "rank")
    return ranked.withColumn("_slot", slot_of("length", "rank")).select(*pieces.columns, "_slot.sequence_id", "_slot.offset")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every row with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(cut(docs, tokenizer_path, end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(pieces, plan(histogram, capacity), sum(histogram.values()))
