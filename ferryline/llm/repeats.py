"""Removal of repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts earlier.

Texts are read as bytes, in blocks of documents. Each string of ``LENGTH`` bytes has an anchor, its ``GRAM`` bytes with
the least hash (the first of equals), so equal strings have equal anchors. The strings of an anchor are neighbours:
its context is the stretch they cover together, on average a third longer than one string.

1. Contexts of all blocks meet by anchor. A context that occurs earlier as a whole is removed as a whole. What is
   left to settle are anchors with several different contexts.
2. The different contexts of those anchors meet by anchor, with their bytes. A Burrows-Wheeler transform of them is
   extended backwards, breadth first: from the borders between intervals whose common prefix is ``l`` come, by one more
   symbol in front, those for ``l + 1``. The expansion stops below ``LENGTH``; rows with no border between them share at
   least that much, and of those all but the earliest are removed.
3. Answers go back to the blocks, which cut the covered bytes out.

An anchor with very many different contexts (a line that a third of all documents hold, in ever other surroundings)
is not gathered: the strings of its contexts are compared one by one by 128-bit fingerprints, dealt out by
fingerprint. Equal contexts or strings of a block are sent once.

"Earlier" is a smaller document id, or the same document and an earlier start. Defined cases: null and empty texts,
and those shorter than ``LENGTH``, lose nothing; ids that are null come after all others, and rows that share an id in
the order of blocks and rows; an empty table gives an empty table. The input has to give the same rows in the same
order each time it is read (a table). All its columns are kept; ``n_bytes``, ``removed`` and ``kept`` replace their likes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.llm.words import block_name, join_arrays, split_arrays, spread, texts_of, unzipped, zipped
from ferryline.session import materialise

LENGTH = 100
GRAM = 40
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20
LEAST_BUCKETS = 256
BUCKET_BYTES = 2 << 20
# An anchor with more different contexts than this, in a block or in all, is settled string by string.
HOT_IN_BLOCK, HOT = 48, 2048

UNIQUE, REPEATED, OPEN, SINGLY = 0, 1, 2, 3
LATE = np.iinfo(np.int64).max

_SPOT = np.uint64((1 << 21) - 1)
_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ENTRIES_SCHEMA = "bucket int, block long, kind int, data binary"
ANSWERS_SCHEMA = "block long, bucket int, kind int, found binary"
TEXTS_SCHEMA = "block long, rows binary, texts binary, anchors binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP[15]
    return x ^ (x >> np.uint64(29))


def _grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``GRAM`` bytes (40 = 32 + 8) and of the 64 bytes that start at each place."""
    h, eight, width = _BYTE[text], None, 1
    while width < 32:
        h = h[:-width] * _STEP[width.bit_length()] + h[width:]
        width *= 2
        eight = h if width == 8 else eight
    grams = _mixed(h[: len(text) - GRAM + 1] * _STEP[7] + eight[32 : len(text) - GRAM + 33])
    return grams, _mixed(h[: len(text) - 63] * _STEP[8] + h[32 : len(text) - 31])


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Anchors:
    """For each anchor: its hash, the hash of its context, the first and the last start of its strings."""

    gram: np.ndarray
    context: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _anchors_of(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Anchors:
    """Anchors of a text whose documents begin at ``starts``; strings start before ``ends`` (``LENGTH - 1`` from the end)."""
    grams, wide = _grams(text)
    spots = np.arange(len(grams), dtype=np.uint64)
    least = _window_min((grams & ~_SPOT) | spots, LENGTH - GRAM + 1)
    valid = spread(starts, ends - starts)
    at = (least[valid] & _SPOT).astype(np.int64)
    fresh = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)))
    first, last = valid[fresh], valid[np.append(fresh[1:], len(valid)) - 1]
    parts = (wide[first], wide[first + 36], wide[last + 36], (last - first).astype(np.uint64), (at[fresh] - first).astype(np.uint64))
    context = np.zeros(len(fresh), np.uint64)
    for k, part in enumerate(parts):
        context += part * _STEP[9 + k]
    return Anchors(grams[at[fresh]], _mixed(context), first, last)


def find_anchors(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Anchors:
    """Anchors of all documents of a block, worked through in chunks; places are those in the block."""
    found, at = [], 0
    pieces: list[tuple[int, int]] = []
    for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        if length >= LENGTH:
            pieces += [(start + k, min(start + length, start + k + CHUNK + LENGTH - 1)) for k in range(0, length - LENGTH + 1, CHUNK)]
    count = len(pieces)
    while at < count:
        to = at + 1
        while to < count and pieces[to][1] - pieces[at][0] <= CHUNK:
            to += 1
        low, high = pieces[at][0], pieces[to - 1][1]
        begin = np.array([p[0] for p in pieces[at:to]]) - low
        end = np.array([p[1] for p in pieces[at:to]]) - low - LENGTH + 1
        own = _anchors_of(text[low:high], begin, end)
        found.append((own.gram, own.context, own.first + low, own.last + low))
        at = to
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Anchors(*(np.concatenate(c) for c in zip(none, *found, strict=True)))


@dataclass
class _Block:
    """A block's documents in the order of the table, and its anchors put down as entries to compare."""

    name: int
    order_key: np.ndarray  # ids, with the latest for null
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    anchors: Anchors
    entry: np.ndarray  # of each anchor
    leader: np.ndarray  # of each entry: its earliest anchor
    hot: np.ndarray  # of each entry

    @staticmethod
    def make(name: int, ids: list, texts: list[bytes]) -> _Block:
        key = np.array([LATE if i is None else i for i in ids], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(texts), np.uint8)
        anchors = find_anchors(text, starts, lengths)
        earliest = _earliest_first(key, starts, anchors.first)
        order = earliest[np.lexsort((anchors.context[earliest], anchors.gram[earliest]))]
        gram, context = anchors.gram[order], anchors.context[order]
        new_gram = np.append(True, gram[1:] != gram[:-1]) if len(order) else np.zeros(0, bool)
        new = new_gram | np.append(True, context[1:] != context[:-1]) if len(order) else new_gram
        group = np.cumsum(new_gram) - 1
        crowded = np.bincount(group, new)[group] > HOT_IN_BLOCK if len(order) else new
        new = np.where(crowded, new_gram, new)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        return _Block(name, key, starts, lengths, text, anchors, entry, order[new], crowded[new])

    def document(self, places: np.ndarray) -> np.ndarray:
        """The document each place lies in."""
        return np.searchsorted(self.starts + self.lengths, places, side="right")

    def buckets(self, count: int) -> np.ndarray:
        return (self.anchors.gram[self.leader] % np.uint64(count)).astype(np.int32)


def _earliest_first(key: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places from the earliest to the latest, by document and start."""
    document = np.searchsorted(starts, places, side="right") - 1
    rank = np.empty(len(key), np.int64)
    rank[np.argsort(key, kind="stable")] = np.arange(len(key))
    return np.lexsort((places, rank[document]))


def _by_bucket(dealt: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, its entries in their order) for each bucket that has any."""
    order = np.argsort(dealt, kind="stable")
    ends = np.flatnonzero(np.append(dealt[order][1:] != dealt[order][:-1], True)) + 1 if len(order) else order
    return [(int(dealt[order[a]]), order[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=False)]


def _entry_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "block", "kind", "data"])


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], list[pa.RecordBatch]]]:
    """(name, ids, texts, rows) of each block; the columns are the id, the text and then all others."""
    part, number, size = TaskContext.get().partitionId(), 0, 0
    ids, texts, rows = [], [], []
    for batch in batches:
        begin, named = 0, batch.column(0).to_pylist()
        for k, text in enumerate(texts_of(batch)):
            ids.append(named[k])
            texts.append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                rows.append(batch.slice(begin, k + 1 - begin))
                yield block_name(zlib.crc32(b"".join(texts)), part, number), ids, texts, rows
                number, size, begin, ids, texts, rows = number + 1, 0, k + 1, [], [], []
        if begin < batch.num_rows:
            rows.append(batch.slice(begin))
    if ids:
        yield block_name(zlib.crc32(b"".join(texts)), part, number), ids, texts, rows


def _send_contexts(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts, _ in _read_blocks(batches):
            block = _Block.make(name, ids, texts)
            gram, context = block.anchors.gram[block.leader], block.anchors.context[block.leader]
            key = block.order_key[block.document(block.anchors.first[block.leader])]
            yield _entry_rows(
                [(bucket, name, 0, join_arrays([gram[own], context[own], key[own], block.hot[own]])) for bucket, own in _by_bucket(block.buckets(buckets))]
            )

    return emit


def _judge(table: pa.Table) -> pa.Table:
    """The state of each entry of a bucket."""
    table = table.sort_by("block")
    split = [split_arrays(d) for d in table["data"].to_pylist()]
    gram, context, key, hot = (np.concatenate(c) for c in zip(*split, strict=True))
    order = np.lexsort((np.arange(len(gram)), key, context, gram))
    new_gram = np.append(True, gram[order][1:] != gram[order][:-1])
    new = new_gram | np.append(True, context[order][1:] != context[order][:-1])
    group = np.cumsum(new_gram) - 1
    kinds = np.bincount(group, new)[group]
    crowded = (np.bincount(group, hot[order])[group] > 0) | (kinds > HOT)
    state = np.empty(len(gram), np.uint8)
    state[order] = np.where(crowded, SINGLY, np.where(~new, REPEATED, np.where(kinds > 1, OPEN, UNIQUE)))
    cuts = np.cumsum([len(s[0]) for s in split])[:-1]
    return _answer_rows(table, [join_arrays([part]) for part in np.split(state, cuts)])


def _answer_rows(table: pa.Table, found: list[bytes]) -> pa.Table:
    return pa.table([table["block"], table["bucket"], table["kind"], pa.array(found, pa.binary())], names=["block", "bucket", "kind", "found"])


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes, sorted by at least their first ``depth`` symbols (each below 512), by prefix doubling."""
    n, known = len(symbols), 7
    padded = np.append(symbols.astype(np.int64), np.zeros(known, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(known):
        key = (key << 9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    border = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(border, np.arange(n), 0)) + 1
    while known < depth:
        tied = np.flatnonzero(~border | np.append(~border[1:], False))
        if not len(tied):
            break
        own = order[tied]
        key = rank[own] * (n + 1) + rank[np.minimum(own + known, n)]
        place = np.argsort(key, kind="stable")
        own, key = own[place], key[place]
        order[tied] = own
        border[tied] = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(border, np.arange(n), 0)) + 1
        rank[order[tied]] = first[tied]
        known *= 2
    return order


def long_prefix_groups(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """A number for each row of the suffix order; rows with the same one share at least ``length`` symbols.

    The transform holds the symbol before each suffix. Row ``k`` of the order is the ``k``-th in the order of those
    symbols, extended from the row ``perm[k]``; it begins an interval for ``l + 1`` if a border of an interval for ``l``
    lies between that row and the one that row ``k - 1`` is extended from. Borders are found by increasing ``l``.
    """
    transform = symbols[order - 1].astype(np.int16)
    perm = np.argsort(transform, kind="stable")
    begins = np.append(True, transform[perm][1:] != transform[perm][:-1])
    border, frontier = begins.copy(), begins
    todo = np.flatnonzero(~begins)
    low, high = perm[todo - 1] + 1, perm[todo] + 1
    for _ in range(1, length):
        if not len(todo) or not frontier.any():
            break
        before = np.zeros(len(order) + 1, np.int32)
        np.cumsum(frontier, out=before[1:])
        hit = before[high] > before[low]
        frontier = np.zeros(len(order), bool)
        frontier[todo[hit]] = True
        border |= frontier
        todo, low, high = todo[~hit], low[~hit], high[~hit]
    return np.cumsum(border) - 1


def repeated_strings(contexts: np.ndarray, lengths: np.ndarray, earliness: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string of each context (in a row), whether it also occurs earlier.

    ``contexts`` are bytes in a row; ``earliness`` numbers the strings of all contexts from the earliest on.
    """
    total = int(lengths.sum()) + len(lengths)
    begins = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.ones(total + 1, np.int64)
    symbols[-1] = 0
    symbols[spread(begins, lengths)] = contexts.astype(np.int64) + 2
    order = suffix_order(symbols, length)
    group = long_prefix_groups(symbols, order, length)
    number = np.full(total + 1, LATE, np.int64)
    number[spread(begins, lengths - length + 1)] = earliness
    numbered = number[order]
    first = np.minimum.reduceat(numbered, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    later = np.zeros(total + 1, bool)
    later[order] = numbered > first[group]
    return later[spread(begins, lengths - length + 1)]


def _ordered(key: np.ndarray, row: np.ndarray, document: np.ndarray) -> np.ndarray:
    """The rank of each context's document."""
    order = np.lexsort((document, row, key))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1]) | (document[order][1:] != document[order][:-1]))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _settle(table: pa.Table) -> pa.Table:
    """For each string of the open contexts of a bucket, and for each single string, whether it occurs earlier."""
    table = table.sort_by("block")
    kinds, found = np.array(table["kind"].to_pylist()), [b""] * table.num_rows
    data = table["data"].to_pylist()
    if len(rows := np.flatnonzero(kinds == OPEN)):
        split = [split_arrays(data[r]) for r in rows]
        key, document, start, lengths, contexts = (np.concatenate(c) for c in zip(*split, strict=True))
        counts = [len(s[0]) for s in split]
        rank = _ordered(key, np.repeat(np.arange(len(rows)), counts), document)
        strings = lengths - LENGTH + 1
        at = spread(start, strings)
        owner = np.repeat(rank, strings)
        earliness = np.empty(len(at), np.int64)
        earliness[np.lexsort((at, owner))] = np.arange(len(at))
        later = repeated_strings(contexts, lengths, earliness)
        sizes = np.add.reduceat(strings, np.cumsum([0, *counts[:-1]]))
        for r, part in zip(rows, np.split(later, np.cumsum(sizes)[:-1]), strict=True):
            found[r] = join_arrays([part])
    if len(rows := np.flatnonzero(kinds == SINGLY)):
        split = [split_arrays(data[r]) for r in rows]
        one, two, key = (np.concatenate(c) for c in zip(*split, strict=True))
        order = np.lexsort((np.arange(len(one)), key, two, one))
        later = np.zeros(len(one), bool)
        later[order] = np.append(False, (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]))
        for r, part in zip(rows, np.split(later, np.cumsum([len(s[0]) for s in split])[:-1]), strict=True):
            found[r] = join_arrays([part])
    return _answer_rows(table, found)


def _send_texts(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts, rows in _read_blocks(batches):
            block = _Block.make(name, ids, texts)
            sink = pa.BufferOutputStream()
            others = [pa.RecordBatch.from_arrays(r.columns[2:], r.schema.names[2:]) for r in rows]
            with pa.ipc.new_stream(sink, others[0].schema) as stream:
                for batch in others:
                    stream.write_batch(batch)
            anchors = [block.anchors.first, (block.anchors.last - block.anchors.first).astype(np.uint8), block.entry.astype(np.uint32)]
            anchors += [block.leader.astype(np.uint32), block.buckets(buckets)]
            head = join_arrays([block.order_key, block.lengths])
            packed = len(head).to_bytes(8, "little") + head + zipped(sink.getvalue().to_pybytes())
            columns = [pa.array([name]), *(pa.array([v], pa.binary()) for v in (packed, zipped(block.text.tobytes()), join_arrays(_steps(anchors))))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "rows", "texts", "anchors"])

    return emit


def _steps(anchors: list[np.ndarray]) -> list[np.ndarray]:
    """First starts as steps from one to the next, which are small."""
    return [np.diff(anchors[0], prepend=0).astype(np.uint32), *anchors[1:]]


@dataclass
class _Met:
    """A block put together again, with the state of each entry."""

    key: np.ndarray
    lengths: np.ndarray
    others: pa.Table
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    entry: np.ndarray
    leader: np.ndarray
    dealt: np.ndarray
    state: np.ndarray

    @staticmethod
    def of(answers: pa.Table, texts: pa.Table) -> _Met:
        if texts.num_rows != 1:
            raise RuntimeError("answers for a block that is not there: the input gave other rows when read again")
        packed = texts["rows"][0].as_py()
        cut = 8 + int.from_bytes(packed[:8], "little")
        key, lengths = split_arrays(packed[8:cut])
        others = pa.ipc.open_stream(unzipped(packed[cut:])).read_all()
        steps, span, entry, leader, dealt = split_arrays(texts["anchors"][0].as_py())
        first = np.cumsum(steps.astype(np.int64))
        own = {b: split_arrays(f)[0] for b, k, f in zip(*(answers[c].to_pylist() for c in ("bucket", "kind", "found")), strict=True) if k == 0}
        state = np.zeros(len(leader), np.uint8)
        groups = _by_bucket(dealt)
        if [b for b, _ in groups] != sorted(own):
            raise RuntimeError("answers for other contexts: the input gave other rows when read again")
        for bucket, places in groups:
            state[places] = own[bucket]
        text = np.frombuffer(unzipped(texts["texts"][0].as_py()), np.uint8)
        return _Met(key, lengths, others, text, first, first + span, entry.astype(np.int64), leader.astype(np.int64), dealt, state)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.cumsum(self.lengths), places, side="right")

    def open_contexts(self) -> list[tuple[int, np.ndarray]]:
        """(bucket, the anchors whose contexts are sent there)."""
        entries = np.flatnonzero(self.state == OPEN)
        return [(b, self.leader[entries[own]]) for b, own in _by_bucket(self.dealt[entries])]

    def single_strings(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Starts of the strings compared singly, their fingerprints (two rows), whether each is the block's earliest
        of its kind, and (bucket, which of the earliest are sent there)."""
        anchors = np.flatnonzero(self.state[self.entry] == SINGLY)
        places = spread(self.first[anchors], self.last[anchors] - self.first[anchors] + 1)
        starts = np.cumsum(self.lengths) - self.lengths
        places = places[_earliest_first(self.key, starts, places)]
        prints = np.zeros((2, len(places)), np.uint64)
        for k in range(LENGTH):
            value = _BYTE[self.text[places + k]] if len(places) else prints[0]
            prints[0] = prints[0] * _STEP[1] + value
            prints[1] = (prints[1] ^ value) * _STEP[2]
        order = np.lexsort((np.arange(len(places)), prints[1], prints[0]))
        earliest = np.zeros(len(places), bool)
        sorted_prints = prints[:, order]
        earliest[order] = np.append(True, (sorted_prints[:, 1:] != sorted_prints[:, :-1]).any(axis=0)) if len(order) else earliest
        sent = np.flatnonzero(earliest)
        dealt = (_mixed(prints[0][sent]) % np.uint64(buckets)).astype(np.int32)
        return places, prints, earliest, [(b, sent[own]) for b, own in _by_bucket(dealt)]


def _send_open(buckets: int):
    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        met, name, rows = _Met.of(left, right), right["block"][0].as_py(), []
        starts = np.cumsum(met.lengths) - met.lengths
        for bucket, anchors in met.open_contexts():
            first, lengths = met.first[anchors], met.last[anchors] - met.first[anchors] + LENGTH
            document = met.document(first)
            own = [met.key[document], document, first - starts[document], lengths, met.text[spread(first, lengths)]]
            rows.append((bucket, name, OPEN, join_arrays(own)))
        places, prints, _, dealt = met.single_strings(buckets)
        for bucket, own in dealt:
            rows.append((bucket, name, SINGLY, join_arrays([prints[0][own], prints[1][own], met.key[met.document(places[own])]])))
        return pa.Table.from_batches([_entry_rows(rows)])

    return emit


def _whole_characters(covered: np.ndarray, text: np.ndarray) -> np.ndarray:
    """``covered`` without characters that are covered in part.

    Those have a byte where the cover changes; from there they are followed to both ends. No array is wider than the text.
    """
    inner = (text & 0xC0) == 0x80
    if not len(text) or inner[0]:
        return covered
    covered = covered.copy()
    split = np.flatnonzero((covered[1:] != covered[:-1]) & inner[1:]) + 1
    before, after = split, split
    while len(before):
        before = before - 1
        covered[before] = False
        before = before[inner[before]]
    while len(after):
        covered[after] = False
        after = after[after + 1 < len(text)] + 1
        after = after[inner[after]]
    return covered


def _cut(buckets: int, names: list[str], whole_characters: bool):
    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        met = _Met.of(left, right)
        found = {(k, b): split_arrays(f)[0] for b, k, f in zip(*(left[c].to_pylist() for c in ("bucket", "kind", "found")), strict=True) if k}
        change = np.zeros(len(met.text) + 1, np.int32)
        leads = np.zeros(len(met.entry), bool)
        leads[met.leader] = True
        state = met.state[met.entry]
        whole = (state != SINGLY) & (~leads | (state == REPEATED))
        np.add.at(change, met.first[whole], 1)
        np.add.at(change, met.last[whole] + LENGTH, -1)
        gone = []
        for bucket, anchors in met.open_contexts():
            gone.append(spread(met.first[anchors], met.last[anchors] - met.first[anchors] + 1)[found[OPEN, bucket]])
        places, _, earliest, dealt = met.single_strings(buckets)
        gone.append(places[~earliest])
        for bucket, own in dealt:
            gone.append(places[own][found[SINGLY, bucket]])
        removed = np.concatenate(gone)
        np.add.at(change, removed, 1)
        np.add.at(change, removed + LENGTH, -1)
        covered = np.cumsum(change, out=change)[:-1] > 0
        del change
        if whole_characters:
            covered = _whole_characters(covered, met.text)
        spans, kept, at = [], [], 0
        for length in met.lengths.tolist():
            own = covered[at : at + length]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(met.text[at : at + length][~own].tobytes())
            at += length
        ids = pa.array([None if k == LATE else int(k) for k in met.key], pa.int64())
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [ids, *met.others.columns, pa.array(met.lengths, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())]
        return pa.table(columns, names=names)

    return emit


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_bytes``, ``removed`` (array of start and end) and ``kept`` (binary).

    With ``whole_characters`` a character stays unless all of its bytes are covered, so that what is kept is UTF-8.
    """
    added = ["n_bytes", "removed", "kept"]
    others = [c for c in docs.columns if c not in (doc_id, text, *added)]
    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text, *others)
    size = rows.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).head()["n"] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))

    entries = rows.mapInArrow(_send_contexts(buckets), ENTRIES_SCHEMA)
    states = materialise(entries.groupBy("bucket").applyInArrow(_judge, ANSWERS_SCHEMA), "states")
    texts = rows.mapInArrow(_send_texts(buckets), TEXTS_SCHEMA)
    opened = states.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(_send_open(buckets), ENTRIES_SCHEMA)
    settled = materialise(opened.groupBy("bucket").applyInArrow(_settle, ANSWERS_SCHEMA), "settled")
    kept_fields = [rows.schema[c] for c in (doc_id, *others)]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    new_fields = [T.StructField("n_bytes", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.BinaryType())]
    schema = T.StructType([*kept_fields, *new_fields])
    answered = states.unionByName(settled).groupBy("block").cogroup(texts.groupBy("block"))
    return answered.applyInArrow(_cut(buckets, schema.names, whole_characters), schema)
