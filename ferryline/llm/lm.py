"""Scores of whole documents by a gated recurrent language model, and by word counts.

Tokens are lower-cased words and one end for each document. The model reads a document token by token and gives the
next one as class times member: a softmax over classes, then one over the members of the class. Members are the most
frequent words (``vocabulary_size``: the more, the more distinct words are learned from) and groups of all other words
by their look (first letter outside ASCII, last mark) and last two letters; the groups grow in number likewise. Classes
are about the square root of the members, of about equal weight. Every word learned from is thus foreseen from context,
by itself or by its group, and within a group by its count. Words learned from once have a group of their look to
themselves, and words never learned from belong to it. Counts, classes and groups are taken over all documents that are
learned from.

The network is trained in numpy with gradients cut after ``WINDOW`` steps and the state carried on from window to
window. Training runs in ``ROUNDS`` rounds over disjoint shares of the blocks, so that each document learned from is
read once: every task starts from the round's weights and works through its blocks, then the weights are averaged by
tokens. The starting weights give the word counts' distribution, so what is learned is what context adds.

Counts are summed by bucket of words (``words``); weights grow with the root of the distinct words. A document is scored from its first to
its last token, however long, with the state carried over all windows.

Defined cases: a null or empty text is the end alone; a row without an id is never learned from; repeated rows count
as often as they occur; where nothing is learned from, the base has one distinct token to come and the model knows
counts of zero; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.words import answers, bucket_count, bucket_words, join_arrays, meet, split_arrays, words_and_codes
from ferryline.session import materialise

LEAST_VOCABULARY = 2048
WORDS_PER_ROOT, ROOTS_PER_GROUP = 8, 16
HIDDEN = 16
WINDOW = 48
LEAST_LANES, MOST_LANES, WINDOWS = 8, 256, 400
# Scores do not depend on these.
SCORING_WINDOW, SCORING_LANES, SCORING_WINDOWS = 96, 512, 16
GROUP_TOKENS = 6_000_000
ROUNDS = 3
RATE = 0.005
LOOKS = 24
_HIGHEST = np.float32(60)
_CHUNKS = 8
# Chances of so many (state, choice) pairs are worked out at a time, so that they stay in a core's cache.
_AT_A_TIME = 1 << 17
# So many rows of weights are brought up to date at a time, likewise.
_ROWS = 1024
_KEEP, _KEEP_SQUARE = 0.9, 0.999

CODED_SCHEMA = (
    "block long, doc_ids array<long>, marks array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, "
    "other array<double>, codes binary"
)
SCORED_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def learned_from(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(False))


def look(word: bytes) -> int:
    """The look of a word outside the vocabulary, from 0 to ``LOOKS - 1``."""
    accent = 0
    if not word.isascii():
        at = next(i for i, b in enumerate(word) if b > 127)
        accent = 1 + (word[at + 1] if at + 1 < len(word) else 0) % 7
    end = 0 if word[-1:].isalnum() or word[-1] > 127 else 1 if word[-1:] in b".,;:" else 2
    return 3 * accent + end


def ending(word: bytes) -> int:
    """A checksum of the last two bytes before any marks."""
    return zlib.crc32(word.rstrip(b".,;:!?)\"'")[-2:])


def vocabulary_size(distinct: int) -> int:
    """How many words are members by themselves."""
    return max(LEAST_VOCABULARY, math.ceil(WORDS_PER_ROOT * math.sqrt(distinct)))


def groups_per_look(distinct: int) -> int:
    """One for words seen once or never, the others by ending."""
    return 1 + max(1, math.ceil(math.sqrt(distinct) / ROOTS_PER_GROUP))


def group_place(word: bytes, seen: int, groups: int) -> int:
    """Group ``g`` of look ``k`` has place ``LOOKS * g + k``."""
    return look(word) + (LOOKS * (1 + ending(word) % (groups - 1)) if seen > 1 and groups > 1 else 0)


@dataclass(frozen=True)
class Counts:
    """What the corpus says: totals, the vocabulary with its counts, and the totals of the groups of other words by place."""

    tokens: int
    distinct: int
    ends: int
    words: list[bytes]
    counts: list[int]
    look_tokens: list[int]
    look_distinct: list[int]


def _sum_bucket(rows: pa.Table) -> pa.Table:
    distinct, which, counts = bucket_words(rows)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, which, counts)
    seen = np.flatnonzero(totals)
    words = [distinct[i] for i in seen]
    arrays = [pa.array(words, pa.binary()), pa.array(totals[seen]), pa.array(map(look, words), pa.int32()), pa.array(map(ending, words), pa.int64())]
    return pa.table(arrays, names=["word", "n", "look", "ending"])


def _most_frequent(table: DataFrame) -> dict[bytes, int]:
    """The words of the vocabulary, from the most frequent on; of equally frequent ones the first."""
    sizes = sorted(((r["n"], r["v"]) for r in table.groupBy("n").agg(F.count("*").alias("v")).collect()), reverse=True)
    left, least = vocabulary_size(sum(v for _, v in sizes)), 0
    for least, v in sizes:
        if v >= left:
            break
        left -= v
    rows = table.filter(F.col("n") > least).collect() + table.filter(F.col("n") == least).orderBy("word").limit(left).collect()
    return {bytes(r["word"]): r["n"] for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))}


def count_words(words: DataFrame, documents: int) -> Counts:
    """Over all marked documents, of which there are ``documents``."""
    schema = "word binary, n long, look int, ending long"
    table = materialise(words.groupBy("bucket").applyInArrow(_sum_bucket, schema), "counts")
    kept, groups = _most_frequent(table), groups_per_look(table.count())
    tokens, distinct = [0] * (LOOKS * groups), [0] * (LOOKS * groups)
    place = F.col("look") + F.when(F.col("n") > 1, LOOKS * (1 + F.pmod("ending", F.lit(groups - 1)))).otherwise(0)
    for row in table.groupBy(place.alias("place")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[row["place"]], distinct[row["place"]] = row["n"], row["v"]
    total, types = sum(tokens) + documents, sum(distinct) + (documents > 0)
    for word, n in kept.items():
        own = group_place(word, n, groups)
        tokens[own] -= n
        distinct[own] -= 1
    return Counts(total, types, documents, list(kept), list(kept.values()), tokens, distinct)


@dataclass(frozen=True)
class Layout:
    """Codes of tokens: 0 is the end, then the vocabulary, then the groups of other words, then the start."""

    words: dict[bytes, int]
    group_code: np.ndarray  # of each place of a group, -1 where no word belongs to it
    log_group: np.ndarray  # of each group with a code, its weight
    class_of: np.ndarray  # of each code but the start
    begin: np.ndarray  # of each class, the first code; one more for the end of the last
    log_class: np.ndarray
    log_member: np.ndarray  # of each code but the start

    @staticmethod
    def of(counts: Counts) -> Layout:
        """Classes of about equal weight; square roots keep the classes of frequent words from being too large."""
        first = np.arange(len(counts.look_tokens)) < LOOKS  # the groups that words never seen belong to
        groups = np.array(counts.look_tokens, float) + 0.5 * (np.array(counts.look_distinct) + first)
        kept = np.flatnonzero((np.array(counts.look_distinct) > 0) | first)
        listed = 1 + len(counts.words)
        group_code = np.full(len(groups), -1, np.int64)
        group_code[kept] = listed + np.arange(len(kept))
        mass = np.concatenate([[counts.ends + 0.5], np.array(counts.counts, float) + 0.5, groups[kept]])
        weights, classes = np.sqrt(mass[1:]), math.ceil(math.sqrt(len(mass)))
        share = np.minimum(np.floor(np.cumsum(weights) / weights.sum() * classes), classes - 1).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, share[1:] != share[:-1]))
        begin = np.concatenate([[0], 1 + cuts, [len(mass)]])
        class_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        by_class = np.add.reduceat(mass, begin[:-1])
        words = {w: 1 + i for i, w in enumerate(counts.words)}
        return Layout(words, group_code, np.log(groups[kept]), class_of, begin, np.log(by_class / by_class.sum()), np.log(mass) - np.log(by_class[class_of]))

    def code(self, word: bytes, seen: int) -> int:
        return self.words.get(word) or int(self.group_code[group_place(word, seen, len(self.group_code) // LOOKS)])

    @property
    def listed(self) -> int:
        return 1 + len(self.words)

    @property
    def start(self) -> int:
        return self.listed + len(self.log_group)


def _code_bucket(layout: Layout):
    """Each word's code and count."""

    def code_bucket(rows: pa.Table) -> list[bytes]:
        distinct, which, seen = bucket_words(rows)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, which, seen)
        codes = np.array([layout.code(w, n) for w, n in zip(distinct, totals.tolist(), strict=True)], np.uint32)
        out, at = [], 0
        for n in rows["n_words"].to_pylist():
            own = which[at : at + n]
            out.append(join_arrays([codes[own], totals[own]]))
            at += n
        return out

    return code_bucket


def _code_block(layout: Layout, counts: Counts):
    """A block's documents as codes, with what the counts alone say of each."""
    whole = math.log10(counts.tokens + 0.5 * (counts.distinct + 1))

    def code_block(found: list[bytes], places: np.ndarray, block: dict) -> pa.Table:
        parts = [split_arrays(f) for f in found]
        codes, totals = np.zeros(len(places), np.uint32), np.zeros(len(places), np.int64)
        if parts:
            codes[places], totals[places] = (np.concatenate(c) for c in zip(*parts, strict=True))
        base = np.log10(totals + 0.5) - whole
        within = np.where(codes >= layout.listed, np.log(totals + 0.5) - layout.log_group[np.maximum(codes.astype(int) - layout.listed, 0)], 0.0)
        ends = np.cumsum(block["lengths"])
        end_base = math.log10(counts.ends + 0.5) - whole
        streams, rows = [], {"n_tokens": [], "n_known": [], "base": [], "other": []}
        for end, length in zip(ends, block["lengths"], strict=True):
            own = block["codes"][end - length : end]
            streams += [codes[own], np.zeros(1, np.uint32)]
            rows["n_tokens"].append(int(length) + 1)
            rows["n_known"].append(int((totals[own] > 0).sum()) + (counts.ends > 0))
            rows["base"].append(float(base[own].sum()) + end_base)
            rows["other"].append(float(within[own].sum()))
        columns = [
            pa.array([block["block"]]), pa.array([block["doc_ids"]], pa.list_(pa.int64())), pa.array([block["marks"]], pa.list_(pa.bool_())),
            pa.array([rows["n_tokens"]], pa.list_(pa.int64())), pa.array([rows["n_known"]], pa.list_(pa.int64())),
            pa.array([rows["base"]], pa.list_(pa.float64())), pa.array([rows["other"]], pa.list_(pa.float64())),
            pa.array([join_arrays([np.concatenate(streams)])], pa.binary()),
        ]
        return pa.table(columns, names=[f.split()[0] for f in CODED_SCHEMA.split(", ")])

    return code_block


def _softmax(
    states: np.ndarray, weights: np.ndarray, picked: np.ndarray, out: np.ndarray, slope: np.ndarray | None, grad: np.ndarray | None, count: int, clip: bool
) -> None:
    """Adds the log chance of the picked column of each row to ``out``.

    With ``slope`` also the gradients of the sum over ``count``: of the weights to ``slope``, of the states (without
    their constant) to ``grad``. ``clip`` where a score could be above ``_HIGHEST``.
    """
    step = max(64, _AT_A_TIME // weights.shape[1])
    if len(states) > step:
        for at in range(0, len(states), step):
            cut = slice(at, at + step)
            _softmax(states[cut], weights, picked[cut], out[cut], slope, None if grad is None else grad[cut], count, clip)
        return
    scores = states @ weights
    if clip:
        np.minimum(scores, _HIGHEST, out=scores)
    at = picked + _starts(len(states), weights.shape[1])
    flat = scores.ravel()
    out += flat.take(at)
    weight = np.exp(scores, out=scores)
    total = weight @ np.ones(weight.shape[1], np.float32)
    out -= np.log(total)
    if slope is not None:
        # Rows are scaled where they are narrow.
        flat[at] -= total
        scale = (np.float32(-1 / count) / total)[:, None]
        slope += (states * scale).T @ weight
        shown = weight @ weights[:-1].T
        shown *= scale
        grad += shown


def _starts(rows: int, width: int) -> np.ndarray:
    """Where each row of a grid begins in its flat form."""
    return np.arange(0, rows * width, width)


class Network:
    """The gated recurrent network. ``flat`` holds all weights in a row; the parts are views of it."""

    def __init__(self, layout: Layout, flat: np.ndarray | None = None) -> None:
        self.layout, h = layout, HIDDEN
        classes = len(layout.log_class)
        # The last row of class_w and the last column of word_w are biases: states carry a constant 1 at their end.
        shapes = {"into": (layout.start + 1, 3 * h), "back": (h, 3 * h), "class_w": (h + 1, classes), "word_w": (layout.start, h + 1)}
        sizes = {name: math.prod(shape) for name, shape in shapes.items()}
        fresh = flat is None
        self.flat = np.zeros(sum(sizes.values()), np.float32) if fresh else flat.astype(np.float32)
        self.parts, at = {}, 0
        for name, shape in shapes.items():
            self.parts[name] = self.flat[at : at + sizes[name]].reshape(shape)
            at += sizes[name]
        if fresh:
            random = np.random.default_rng(7)
            self.parts["into"][:] = random.normal(0, 0.3, shapes["into"])
            self.parts["back"][:] = random.normal(0, 0.25, shapes["back"])
            self.parts["class_w"][-1] = layout.log_class
            self.parts["word_w"][:, -1] = layout.log_member

    def run(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        """States after each step (steps, lanes, hidden and a constant 1), the last state, and what the way back needs."""
        # Lanes lie side by side, so that each gate of all lanes is one stretch of memory.
        h, back = HIDDEN, np.ascontiguousarray(self.parts["back"].T)
        into, (steps, lanes), begins = self.parts["into"], inputs.shape, fresh.any(axis=1).tolist()
        states, state = np.ones((steps, h + 1, lanes), np.float32), np.ascontiguousarray(state.T)
        # What the way back needs is kept for all steps; else each step uses the same memory.
        gates, pulls = (np.empty((steps if keep else 1, 3 * h, lanes), np.float32) for _ in range(2))
        before = np.empty((steps if keep else 0, h, lanes), np.float32)
        for t in range(steps):
            if begins[t]:
                state = np.where(fresh[t], np.float32(0), state)
            if keep:
                before[t] = state
            gate, pull = gates[t if keep else 0], pulls[t if keep else 0]
            gate[:] = into.take(inputs[t], axis=0).T
            np.matmul(back, state, out=pull)
            turn, new, after = gate[: 2 * h], gate[2 * h :], states[t, :h]
            turn += pull[: 2 * h]
            turn *= np.float32(0.5)
            np.tanh(turn, out=turn)
            turn += 1
            turn *= np.float32(0.5)
            np.multiply(turn[:h], pull[2 * h :], out=after)
            new += after
            np.tanh(new, out=new)
            np.subtract(state, new, out=after)
            after *= turn[h:]
            after += new
            state = after
        return states.transpose(0, 2, 1), state.T, (before, gates, pulls)

    def log_chance(self, states: np.ndarray, targets: np.ndarray, slope: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of the chance of each target (of its group for words outside the vocabulary).

        With ``slope``, the weights' gradients of the mean log chance are added to it; the states' gradient comes second.
        """
        layout, p = self.layout, self.parts
        owner = layout.class_of[targets].astype(np.uint16 if len(layout.log_class) < 1 << 16 else np.int64)
        order = np.argsort(owner, kind="stable")
        # Rows of a class stand together from here on.
        owner, own_states = owner[order].astype(np.int64), states[order]
        member, cuts = targets[order] - layout.begin[owner], np.searchsorted(owner, np.arange(len(layout.begin)))
        out, grad = np.zeros(len(targets), np.float32), None if slope is None else np.zeros((len(targets), HIDDEN), np.float32)
        # States lie between -1 and 1, which bounds the scores.
        clip = bool(max(np.abs(p["class_w"]).sum(axis=0).max(), np.abs(p["word_w"]).sum(axis=1).max()) > _HIGHEST - 1)
        _softmax(own_states, p["class_w"], owner, out, None if slope is None else slope["class_w"], grad, len(targets), clip)
        for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(layout.begin) > 1)).tolist():
            own, codes = slice(cuts[k], cuts[k + 1]), slice(layout.begin[k], layout.begin[k + 1])
            rows, shown = (None, None) if slope is None else (slope["word_w"][codes].T, grad[own])
            _softmax(own_states[own], p["word_w"][codes].T, member[own], out[own], rows, shown, len(targets), clip)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return out[place], None if grad is None else grad[place]

    def slopes(self, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, state: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean log chance of a window, cut at its first step; and the state to go on with."""
        h = HIDDEN
        grown = np.zeros_like(self.flat)
        slope = _views(self, grown)
        states, last, (before, gates, pulls) = self.run(inputs, fresh, state, keep=True)
        ahead = np.zeros(states.shape[:2] + (h,), np.float32)
        _, ahead[live] = self.log_chance(states[live], targets[live], slope)
        ahead = np.ascontiguousarray(ahead.transpose(0, 2, 1))
        # What of a step's gradient reaches its gates is the same whatever comes back from later steps, so it is worked
        # out for all steps together: the share of the drive into the new state, then those of the three pulls.
        reset, hold, new = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        share = (1 - hold) * (1 - new * new)
        back, drive = self.parts["back"], np.empty_like(gates)
        np.multiply(share, reset, out=drive[:, 2 * h :])
        np.multiply(drive[:, 2 * h :], pulls[:, 2 * h :], out=drive[:, :h])
        drive[:, :h] *= 1 - reset
        np.subtract(before, new, out=drive[:, h : 2 * h])
        drive[:, h : 2 * h] *= hold * (1 - hold)
        begins = fresh.any(axis=1).tolist()
        for t in range(len(inputs) - 1, -1, -1):
            pull = drive[t].reshape(3, h, -1)
            pull *= ahead[t]
            if t:
                earlier = back @ drive[t]
                earlier += ahead[t] * hold[t]
                if begins[t]:
                    earlier *= ~fresh[t]
                ahead[t - 1] += earlier
        slope["back"] += np.matmul(before, drive.transpose(0, 2, 1)).sum(axis=0)
        np.multiply(ahead, share, out=drive[:, 2 * h :])
        flat_inputs, rows = inputs.ravel(), drive.transpose(0, 2, 1).reshape(-1, 3 * h)
        order = np.argsort(flat_inputs.astype(np.uint16 if self.layout.start < 1 << 16 else np.int64), kind="stable")
        ordered = flat_inputs[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        slope["into"][ordered[first]] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
        return grown, last


def _views(network: Network, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, part in network.parts.items():
        out[name] = flat[at : at + part.size].reshape(part.shape)
        at += part.size
    return out


@dataclass
class Lanes:
    """Documents one after the other in lanes of similar length, the longest lane first.

    The lanes lie in flat arrays one behind the other, so that memory follows the tokens; only a window is a grid.
    """

    targets: np.ndarray  # of all lanes
    document: np.ndarray  # the document of each target
    begin: np.ndarray  # where each lane starts, and the end of the last
    start: int

    @staticmethod
    def of(streams: list[np.ndarray], start: int, most: int = MOST_LANES, windows: int = WINDOWS) -> Lanes:
        # Few lanes for few tokens, so that a small corpus still gives many windows to learn from.
        wanted = min(most, max(LEAST_LANES, sum(map(len, streams)) // (WINDOW * windows)))
        lanes: list[list[int]] = [[] for _ in range(min(wanted, len(streams)))]
        heap = [(0, k) for k in range(len(lanes))]
        for i in sorted(range(len(streams)), key=lambda i: -len(streams[i])):
            length, k = heapq.heappop(heap)
            lanes[k].append(i)
            heapq.heappush(heap, (length + len(streams[i]), k))
        lengths = [sum(len(streams[i]) for i in lane) for lane in lanes]
        order = sorted(range(len(lanes)), key=lambda k: -lengths[k])
        placed = [i for k in order for i in lanes[k]]
        document = np.repeat(np.array(placed, np.int32), [len(streams[i]) for i in placed])
        return Lanes(np.concatenate([streams[i] for i in placed]), document, np.cumsum([0] + [lengths[k] for k in order]), start)

    @property
    def width(self) -> int:
        return len(self.begin) - 1

    def windows(self, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Inputs, targets, first steps of documents, and documents (-1 beyond a lane's end) of each stretch of steps.

        Each is a grid of (steps, lanes) over the lanes that have any step in it.
        """
        lengths = np.diff(self.begin)
        for at in range(0, int(lengths[0]), window):
            lanes = int((lengths > at).sum())
            step = np.arange(at, min(at + window, int(lengths[0])))[:, None]
            live, where = step < lengths[:lanes], np.minimum(step, lengths[:lanes] - 1) + self.begin[:lanes]
            before = np.maximum(where - 1, 0)
            fresh = live & ((step == 0) | (self.document[where] != self.document[before]))
            inputs = np.where(live & ~fresh, self.targets[before].astype(np.int64), self.start)
            yield inputs, np.where(live, self.targets[where], 0).astype(np.int64), fresh, np.where(live, self.document[where], -1)


def _streams(row: dict) -> list[np.ndarray]:
    codes = split_arrays(row["codes"])[0]
    return np.split(codes, np.cumsum(row["n_tokens"])[:-1])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Blocks of about ``GROUP_TOKENS`` tokens, for lanes that are long compared with single documents."""
    group, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            group.append(row)
            size += sum(row["n_tokens"])
            if size >= GROUP_TOKENS:
                yield group
                group, size = [], 0
    if group:
        yield group


def _advance(part: np.ndarray, slope: np.ndarray, mean: np.ndarray, square: np.ndarray, step: float) -> None:
    """Moves the weights of ``part`` and brings their running means up to date, some rows at a time. ``slope`` is used up."""
    for at in range(0, len(part), _ROWS):
        cut = slice(at, at + _ROWS)
        own, new, spread = slope[cut], mean[cut], square[cut]
        new *= np.float32(_KEEP)
        new += own * np.float32(1 - _KEEP)
        own *= own
        own *= np.float32(1 - _KEEP_SQUARE)
        spread *= np.float32(_KEEP_SQUARE)
        spread += own
        np.sqrt(spread, out=own)
        own += np.float32(1e-8)
        np.divide(new, own, out=own)
        own *= np.float32(step)
        part[cut] += own


def _train(layout: Layout, flat: np.ndarray):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, tokens = Network(layout, flat), 0
        moments, number = (np.zeros_like(network.flat), np.zeros_like(network.flat)), 0
        mean, square = (_views(network, m) for m in moments)
        for group in _groups(batches):
            streams = [s for row in group for s, mark in zip(_streams(row), row["marks"], strict=True) if mark]
            if not streams:
                continue
            lanes = Lanes.of(streams, layout.start)
            state = np.zeros((lanes.width, HIDDEN), np.float32)
            for inputs, targets, fresh, document in lanes.windows():
                live = document >= 0
                grown, state = network.slopes(inputs, fresh, targets, state[: inputs.shape[1]], live)
                number += 1
                step = RATE * math.sqrt(1 - _KEEP_SQUARE**number) / (1 - _KEEP**number)
                slope, read = _views(network, grown), np.flatnonzero(np.bincount(inputs.ravel(), minlength=len(network.parts["into"])))
                for name, part in network.parts.items():
                    if name != "into":
                        _advance(part, slope[name], mean[name], square[name], step)
                        continue
                    # Rows of words that the window does not read stay as they are.
                    rows = [a.take(read, axis=0) for a in (part, slope[name], mean[name], square[name])]
                    _advance(*rows, step)
                    part[read], mean[name][read], square[name][read] = rows[0], rows[2], rows[3]
                tokens += int(live.sum())
        if tokens:
            chunk = np.array_split(network.flat, _CHUNKS)
            arrays = [pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array([tokens] * _CHUNKS, pa.int64()), pa.array([c.tobytes() for c in chunk], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "tokens", "weights"])

    return train


_WEIGHTS_SCHEMA = "chunk int, tokens long, weights binary"


def _average(own: pd.DataFrame) -> pd.DataFrame:
    total = own["tokens"].sum()
    mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * (n / total) for w, n in zip(own["weights"], own["tokens"], strict=True))
    return pd.DataFrame({"chunk": [own["chunk"].iloc[0]], "tokens": [total], "weights": [mean.astype(np.float32).tobytes()]})


def training_tasks(tokens: int, cores: int) -> int:
    """Tasks of a round over ``tokens``: one for each group of blocks, but no fewer than there are cores."""
    return max(1, cores, math.ceil(tokens / GROUP_TOKENS))


def fit(coded: DataFrame, layout: Layout, tokens: int) -> np.ndarray:
    """The trained weights; ``tokens`` are learned from. Averages are taken in two steps, so that no task meets the weights of all others.

    Tasks follow the tokens and not the files' splits: a window costs much the same for few lanes as for many, and small
    tasks have few.
    """
    flat = Network(layout).flat
    tasks = training_tasks(tokens // ROUNDS, coded.sparkSession.sparkContext.defaultParallelism)
    for number in range(ROUNDS):
        own = coded.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == number).select("marks", "n_tokens", "codes")
        trained = own.coalesce(tasks).mapInArrow(_train(layout, flat), _WEIGHTS_SCHEMA)
        part = F.pmod(F.xxhash64("weights"), F.lit(64))
        first = trained.withColumn("part", part).groupBy("chunk", "part").applyInPandas(lambda own: _average(own), _WEIGHTS_SCHEMA)
        rows = first.groupBy("chunk").applyInPandas(_average, _WEIGHTS_SCHEMA).collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])])
    return flat


def _score(layout: Layout, flat: np.ndarray, train_tokens: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(layout, flat)
        for group in _groups(batches):
            streams = [s for row in group for s in _streams(row)]
            total = np.zeros(len(streams))
            lanes = Lanes.of(streams, layout.start, SCORING_LANES, SCORING_WINDOWS)
            state = np.zeros((lanes.width, HIDDEN), np.float32)
            for inputs, targets, fresh, document in lanes.windows(SCORING_WINDOW):
                states, state, _ = network.run(inputs, fresh, state[: inputs.shape[1]], keep=False)
                live = document >= 0
                chance, _ = network.log_chance(states[live], targets[live])
                total += np.bincount(document[live], chance, len(total))
            flat_of = {c: [v for row in group for v in row[c]] for c in ("doc_ids", "marks", "n_tokens", "n_known", "base", "other")}
            scores = (total + np.array(flat_of["other"])) / math.log(10)
            arrays = [
                pa.array(flat_of["doc_ids"], pa.int64()), pa.array([not m for m in flat_of["marks"]]), pa.array(flat_of["n_tokens"], pa.int64()),
                pa.array(flat_of["n_known"], pa.int64()), pa.array([train_tokens] * len(streams), pa.int64()), pa.array(flat_of["base"], pa.float64()), pa.array(scores),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCORED_SCHEMA.split(", ")])

    return score


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), learned_from(F.col(doc_id)).alias("mark"))
    buckets = bucket_count(rows, "text")
    words, codes = words_and_codes(rows, buckets, lower=True)
    counts = count_words(words, rows.filter("mark").count())
    layout = Layout.of(counts)
    found = answers(words, _code_bucket(layout))
    coded = materialise(meet(found, codes, _code_block(layout, counts), CODED_SCHEMA), "coded")
    flat = fit(coded, layout, counts.tokens)
    return coded.mapInArrow(_score(layout, flat, counts.tokens), SCORED_SCHEMA)
