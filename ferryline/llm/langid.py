"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A run of letters, lower-cased and with
a space before it, may be cut into pieces in many ways; the forward algorithm adds the probabilities of all of them.
A text's score in a language is the sum of its runs' log probabilities, its language the one with the highest, and
``score`` the share of that language's likelihood (equal priors). Since a run's score depends on the run alone, each
task works it out once for each distinct word of a batch.

``fit`` learns from all labelled rows. Their distinct runs are counted by language and written in parts; expectation
maximisation starts from equal probabilities and runs ``ROUNDS`` rounds, in each of which every part works out how often
its runs hold each piece, and only these sums come to the driver. All rows are scored, on their whole texts.

Defined cases: a null text, and one without a letter, is ``und`` with score 0, as is every text where nothing was
learned; ties go to the language that comes first in alphabetical order; a row without an id or label is scored but
not learned from; repeated rows are scored alike; an empty table gives an empty table; other columns are kept aside.
Runs of more than ``STRETCH`` bytes are scored in stretches of that length.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.llm.words import texts_of
from ferryline.session import materialise

LONGEST_PIECE = 8
STRETCH = 32
ROUNDS = 4
MAX_LANGUAGES = 1_000
# A text is unlike its language where a character is, on average, less likely by this factor's logarithm than in a median text.
FLOOR_MARGIN = 1.5
FLOOR_WIDTHS = 6.0
_PRIOR = 0.02
# Bounds of what a task holds at a time: rows in hand, words it remembers the scores of.
_ROWS_IN_HAND = 1_024
_KEPT_WORDS = 200_000


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: a fifth by the checksum of the id, and those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def letter_runs(word: str) -> list[bytes]:
    lowered = word.lower()
    runs = [lowered] if lowered.isalpha() else "".join(c if c.isalpha() else " " for c in lowered).split()
    return [b" " + run.encode() for run in runs]


class Pieces:
    """The pieces of a vocabulary of up to ``LONGEST_PIECE`` bytes, found by their bytes packed into an integer."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.listed, self.size = pieces, len(pieces)
        self.keys: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        for length in range(1, LONGEST_PIECE + 1):
            own = sorted((int.from_bytes(p, "big"), i) for i, p in enumerate(pieces) if len(p) == length)
            self.keys.append(np.array([k for k, _ in own] + [(1 << 64) - 1], np.uint64))
            self.ids.append(np.array([i for _, i in own] + [self.size], np.int64))

    def find(self, length: int, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these bytes; ``size`` where there is none."""
        known = self.keys[length - 1]
        at = np.searchsorted(known, keys)
        return np.where(known[at] == keys, self.ids[length - 1][at], self.size)

    @staticmethod
    def load(path: str) -> Pieces:
        """From a file of base64 pieces and ranks. All single bytes are pieces, so every text can be cut."""
        with open(path, "rb") as lines:
            pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
        pieces = {p for p in pieces if len(p) <= LONGEST_PIECE and p == p.lower()} | {bytes([b]) for b in range(256)}
        return Pieces(sorted(pieces))


def _grid(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs from the longest to the shortest as rows of bytes; their lengths; the order taken."""
    lengths = np.array([len(r) for r in runs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    width = int(lengths.max(initial=0))
    cells = np.frombuffer(b"".join(runs[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(runs), width)
    return cells, lengths[order], order


def _pieces_ending(pieces: Pieces, cells: np.ndarray, alive: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, id for each of the first ``alive`` runs) of the pieces that end at byte ``end``."""
    key = np.zeros(alive, np.uint64)
    for length in range(1, min(LONGEST_PIECE, end) + 1):
        key = key | (cells[:alive, end - length].astype(np.uint64) << np.uint64(8 * (length - 1)))
        yield length, pieces.find(length, key)


def forward(pieces: Pieces, table: np.ndarray, runs: list[bytes]) -> np.ndarray:
    """Natural log of the summed probability of all segmentations: a row for each run, a column for each language.

    ``table`` has a row for each piece and a last row of zeros. Runs have at most ``STRETCH`` bytes, so that the sums
    stay within the range of a double.
    """
    if not runs:
        return np.zeros((0, table.shape[1]))
    cells, lengths, order = _grid(runs)
    ways = [np.ones((len(runs), table.shape[1]))]
    out = np.zeros((len(runs), table.shape[1]))
    for end in range(1, cells.shape[1] + 1):
        alive = int(np.searchsorted(-lengths, -end, side="right"))
        here = np.zeros((alive, table.shape[1]))
        for length, ids in _pieces_ending(pieces, cells, alive, end):
            hit = np.flatnonzero(ids < pieces.size)
            here[hit] += ways[-length][hit] * table[ids[hit]]
        ways.append(here)
        if len(ways) > LONGEST_PIECE:
            ways.pop(0)
        done = int(np.searchsorted(-lengths, -(end + 1), side="right"))
        out[order[done:alive]] = np.log(here[done:alive])
    return out


def _expected(pieces: Pieces, table: np.ndarray, runs: list[bytes], labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each piece occurs in counted runs of a language each, on average over all segmentations weighed by their
    probability, in the shape of ``table``.
    """
    cells, lengths, order = _grid(runs)
    label, weight, width = labels[order], counts[order], cells.shape[1]
    hits: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    ahead, back = np.zeros((width + 1, len(runs))), np.zeros((width + 1, len(runs)))
    ahead[0] = 1
    for end in range(1, width + 1):
        alive = int(np.searchsorted(-lengths, -end, side="right"))
        for length, found in _pieces_ending(pieces, cells, alive, end):
            hit = np.flatnonzero(found < pieces.size)
            cell = found[hit] * table.shape[1] + label[hit]
            chance = table.ravel()[cell]
            ahead[end, hit] += ahead[end - length, hit] * chance
            hits.append((end, length, hit, cell, chance))
    back[lengths, np.arange(len(runs))] = 1
    scale = weight / ahead[lengths, np.arange(len(runs))]
    shares = []
    for end, length, hit, _, chance in reversed(hits):
        share = chance * back[end, hit]
        shares.append(ahead[end - length, hit] * share * scale[hit])
        back[end - length, hit] += share
    cells_hit = np.concatenate([cell for *_, cell, _ in reversed(hits)])
    return np.bincount(cells_hit, np.concatenate(shares), table.size).reshape(table.shape)


@dataclass(frozen=True)
class Model:
    pieces: Pieces
    languages: list[str]
    table: np.ndarray


def fit(labelled: DataFrame, pieces: Pieces, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Piece probabilities of each language of ``labelled`` (rows without a label or text are passed over)."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.col(lang).alias("label"))
    rows = rows.filter("body is not null and label is not null")
    languages = sorted(r["label"] for r in rows.select("label").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model(pieces, [], np.zeros((pieces.size + 1, 0)))
    numbers = {label: k for k, label in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_hand(batches):
            counts: defaultdict[str, Counter] = defaultdict(Counter)
            for label, body in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                counts[label].update(body.split())
            stretches: Counter = Counter()
            for label, own in counts.items():
                for word, n in own.items():
                    for run in letter_runs(word.decode()):
                        for at in range(0, len(run), STRETCH):
                            stretches[numbers[label], run[at : at + STRETCH]] += n
            listed, run = zip(*stretches, strict=True) if stretches else ([], [])
            arrays = [pa.array(listed, pa.int32()), pa.array(run, pa.binary()), pa.array(stretches.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "run", "n"])

    runs = rows.select("label", "body").mapInArrow(count, "label int, run binary, n long")
    runs = materialise(runs.groupBy("label", "run").agg(F.sum("n").alias("n")), "runs")
    table = np.full((pieces.size, len(languages)), 1.0 / pieces.size)
    for _ in range(ROUNDS):
        expected = np.zeros_like(table)
        for r in _expected_pieces(runs, pieces, table).collect():
            expected[np.frombuffer(r["pieces"], np.int32), r["label"]] = np.frombuffer(r["expected"], np.float64)
        # A language without a run has no evidence of its own: every piece is as likely.
        table = (expected + _PRIOR) / (expected.sum(axis=0) + _PRIOR * pieces.size)
    return Model(pieces, languages, np.vstack([table, np.zeros(len(languages))]))


def _in_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, _ROWS_IN_HAND) for batch in batches for at in range(0, max(1, batch.num_rows), _ROWS_IN_HAND))


def _expected_pieces(runs: DataFrame, pieces: Pieces, table: np.ndarray) -> DataFrame:
    """For each language how often each piece occurs in its counted runs, as packed arrays of pieces and numbers."""
    sent = runs.sparkSession.sparkContext.broadcast((pieces.listed, table))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, chances = sent.value
        own, sums = Pieces(listed), np.zeros_like(chances)
        for batch in batches:
            if batch.num_rows:
                labels, counts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                sums += _expected(own, chances, batch.column(1).to_pylist(), labels, counts)
        at, label = np.nonzero(sums)
        arrays = [pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[at, label])]
        yield pa.RecordBatch.from_arrays(arrays, ["label", "piece", "n"])

    summed = runs.mapInArrow(expect, "label int, piece int, n double").groupBy("label", "piece").agg(F.sum("n").alias("n"))

    def pack(own: pa.Table) -> pa.Table:
        columns = [own["piece"].to_numpy().astype(np.int32).tobytes(), own["n"].to_numpy().astype(np.float64).tobytes()]
        return pa.table({"label": own["label"][:1], "pieces": pa.array(columns[:1]), "expected": pa.array(columns[1:])})

    return summed.groupBy("label").applyInArrow(pack, "label int, pieces binary, expected binary")


class _Scorer:
    """Scores of distinct words, kept from batch to batch."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.seen: defaultdict[bytes, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def extend(self) -> None:
        """Scores the words that are new."""
        fresh = list(self.seen)[len(self.letters) :]
        scores, letters = np.zeros((len(fresh), self.scores.shape[1])), np.zeros(len(fresh), np.int64)
        sizes = np.zeros(len(fresh), np.int64)
        parts: dict[bytes, int] = {}
        owner, part = [], []
        for k, word in enumerate(fresh):
            for run in letter_runs(word.decode()):
                letters[k] += 1
                sizes[k] += len(run.decode())
                for at in range(0, len(run), STRETCH):
                    owner.append(k)
                    part.append(parts.setdefault(run[at : at + STRETCH], len(parts)))
        listed = list(parts)
        found = [forward(self.model.pieces, self.model.table, listed[at : at + 50_000]) for at in range(0, len(listed), 50_000)]
        if found:
            np.add.at(scores, np.array(owner), np.concatenate(found)[np.array(part)])
        self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])
        self.sizes = np.concatenate([self.sizes, sizes])


def predict(
    docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score", rate: str | None = None
) -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score`` (in place of such columns); only ``text`` is looked at.

    With ``rate`` also the log likelihood of the text in its language by character of its runs; null where it has none.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.pieces.listed, model.languages, model.table))
    names_added = [pred, score] + ([rate] if rate else [])
    kept = docs.drop(*names_added)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, languages, chances = sent.value
        own = Model(Pieces(listed), languages, chances)
        scorer = _Scorer(own)
        for batch in _in_hand(batches):
            codes = []
            for body in texts_of(batch, batch.schema.get_field_index(text)):
                words = body.split()
                codes.append(np.fromiter(map(scorer.seen.__getitem__, words), np.int64, len(words)))
            scorer.extend()
            names, shares, rates = [], [], []
            for code in codes:
                if not own.languages or not scorer.letters[code].sum():
                    names.append("und")
                    shares.append(0.0)
                    rates.append(None)
                    continue
                total = scorer.scores[code].sum(axis=0)
                best = int(total.argmax())
                names.append(own.languages[best])
                shares.append(float(1 / np.exp(total - total[best]).sum()))
                rates.append(float(total[best] / scorer.sizes[code].sum()))
            if len(scorer.seen) > _KEPT_WORDS:
                scorer.clear()
            added = [pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added[: len(names_added)]], [*batch.schema.names, *names_added])

    types = [T.StringType(), T.DoubleType(), T.DoubleType()]
    fields = [T.StructField(name, kind) for name, kind in zip(names_added, types, strict=False)]
    return kept.mapInArrow(label, T.StructType([*kept.schema.fields, *fields]))


def rate_floors(told: DataFrame, pred: str = "pred", rate: str = "rate") -> dict[str, float]:
    """For each language the rate (see ``predict``) below which a text is unlike the texts of ``told`` that are told to be in it.

    The floor lies ``FLOOR_MARGIN`` below the median, or ``FLOOR_WIDTHS`` times the distance of the rate that one text in
    twenty falls short of where that is more.
    """
    rates = told.filter(F.col(rate).isNotNull()).groupBy(F.col(pred).alias("pred"))
    found = rates.agg(F.percentile_approx(rate, [0.05, 0.5], 1_000).alias("q")).collect()
    return {r["pred"]: r["q"][1] - max(FLOOR_MARGIN, FLOOR_WIDTHS * (r["q"][1] - r["q"][0])) for r in found}
