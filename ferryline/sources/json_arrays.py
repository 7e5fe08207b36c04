"""JSON array files of any layout and size, read in splits.

Spark's text reader cuts a file at commas, at any number of places at once: a split begins right behind a comma. What a
comma means depends on the text before it, so a first pass over files that may have several splits sums each split up:
whether it holds an odd number of quotes, and by how many brackets the depth changes, for a start inside and outside of a
string. These short rows, one for each split, compose from the first to the last and give every split the state it
begins in. The second pass then cuts elements at the commas of depth one; an element that lies across splits comes as
fragments, which are put together by file and place.

Within a split text is handled batch by batch with numpy; no task holds more than a batch and one element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferryline.errors import SpecError
from ferryline.session import MAX_BROADCAST_ROWS, materialise

_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = b'"\\,[]'
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"[{")] = 1
_DEPTH[list(b"]}")] = -1
_BLANK = b" \t\r\n"

SUMMARY_SCHEMA = "file long, block long, quotes long, outside long, inside long, bytes long, size long"
PARTS_SCHEMA = "file long, block long, kind int, value string"
WHOLE, START, MIDDLE, END = 0, 1, 2, 3


def pieces(files: DataFrame) -> DataFrame:
    """(file, block, size, text) of a text reader that cuts at commas; each piece with its comma, also the last one of a file."""
    return files.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.concat("value", F.lit(",")).cast("binary").alias("text"),
    )


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(file, block, size, text) for each stretch of rows of one split in a batch, in the order of the file."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, sizes = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
        column = batch.column(3)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        body = np.frombuffer(column.buffers()[2], np.uint8)
        for low, high in zip([0, *cuts], [*cuts, len(files)], strict=True):
            yield int(files[low]), int(blocks[low]), int(sizes[low]), body[offsets[low] : offsets[high]]


def _quotes(text: np.ndarray) -> np.ndarray:
    """Where strings begin and end: quotes that no backslash escapes. The byte before ``text`` is a comma, or there is none."""
    at = text == _QUOTE
    slashes = text == _BACKSLASH
    if slashes.any():
        place = np.arange(len(text))
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(slashes, -1, place))[:-1]])
        at &= (place - 1 - before) % 2 == 0
    return at


def _structure(text: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte lies outside of strings, and by how much it changes the depth."""
    outside = (np.cumsum(_quotes(text)) + in_string) % 2 == 0
    return outside, np.where(outside, _DEPTH[text], 0)


def summaries(parts: DataFrame) -> DataFrame:
    """One row for each split: quotes, change of depth when it begins outside and inside of a string, bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "quotes", "outside", "inside", "bytes", "size"]
        here: list[int] | None = None
        for file, block, size, text in _splits(batches):
            if here is None or here[:2] != [file, block]:
                if here is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in here], names)
                here = [file, block, 0, 0, 0, 0, size]
            outside, change = _structure(text, False)
            alike, other = int(change.sum()), int(np.where(outside, 0, _DEPTH[text]).sum())
            if here[2] % 2:
                alike, other = other, alike
            here[2] += int(_quotes(text).sum())
            here[3] += alike
            here[4] += other
            here[5] += len(text)
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in here], names)

    return parts.mapInArrow(emit, SUMMARY_SCHEMA)


@dataclass
class _State:
    """Where in its file a split's text stands, and the beginning of the element that is not finished."""

    problem: str
    in_string: bool = False
    depth: int = 0
    opened: bool = False
    # No comma has been seen since the array opened, so there may be no element at all.
    fresh: bool = False
    headless: bool = False
    closed: bool = False
    ended: bool = False
    pending: list[bytes] = field(default_factory=list)

    def fail(self, text: bytes = b"") -> None:
        raise ValueError(f"{self.problem}{': ' + text[:80].decode('utf-8', 'replace') if text else ''}")

    def take(self, text: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(kind, text) of the elements that end in ``text``."""
        outside, change = _structure(text, self.in_string)
        depth = self.depth + np.cumsum(change)
        body = text.tobytes()
        start = 0
        if not self.opened:
            first = len(body) - len(body.lstrip(_BLANK))
            if first == len(body) or body[first] != _OPEN:
                self.fail(body)
            self.opened = self.fresh = True
            start = first + 1
        if not self.closed:
            ends = np.flatnonzero((outside & (text == _COMMA) & (depth == 1)) | (depth == 0) & (change < 0))
            for end in ends[ends >= start].tolist():
                value = b"".join([*self.pending, body[start:end]])
                # The blanks of a fragment may lie within a string.
                value = value if self.headless else value.strip(_BLANK)
                closing = body[end] != _COMMA
                if closing and body[end] != _CLOSE:
                    self.fail(body[start : end + 1])
                if value or self.headless:
                    yield (END if self.headless else WHOLE), value
                elif not (closing and self.fresh):
                    self.fail(b"an element is missing")
                self.pending, self.headless, self.fresh, start = [], False, False, end + 1
                if closing:
                    self.closed = True
                    break
        if self.closed:
            rest = body[start:]
            if self.ended or rest.strip(_BLANK) not in (b"", b",") or (b"," in rest and rest[-1] != _COMMA):
                self.fail(rest)
            self.ended = b"," in rest
        else:
            self.pending.append(body[start:])
        self.in_string = self.in_string ^ bool(_quotes(text).sum() % 2)
        self.depth = int(depth[-1])

    def leave(self) -> Iterator[tuple[int, bytes]]:
        """What is left at the end of a split; the file goes on in another one."""
        rest = b"".join(self.pending)
        if not self.closed and (self.headless or rest.strip(_BLANK)):
            yield (MIDDLE if self.headless else START), rest


Starts = dict[tuple[int, int], tuple[bool, int]]


def _starts(table: DataFrame, problem: str) -> Starts:
    """For each split of files that have more than one: whether it begins inside a string, and its depth."""
    out: Starts = {}
    file, splits, quotes, depth, taken, size = None, {}, 0, 0, 0, 0

    def finish() -> None:
        if file is not None and (quotes % 2 or depth or taken == size):
            raise SpecError(problem)
        out.update(splits if len(splits) > 1 else {})

    for row in table.orderBy("file", "block").toLocalIterator():
        if row["file"] != file:
            finish()
            file, splits, quotes, depth, taken, size = row["file"], {}, 0, 0, 0, row["size"]
        splits[row["file"], row["block"]] = (bool(quotes % 2), depth)
        depth += row["inside"] if quotes % 2 else row["outside"]
        quotes += row["quotes"]
        taken += row["bytes"]
    finish()
    return out


def _cut(parts: DataFrame, starts: Starts, problem: str, wanted: Callable[[int], bool]) -> DataFrame:
    """(file, block, kind, value): elements, and fragments of elements that lie across splits, of the ``wanted`` files.

    Files are told apart here and not by a filter, as Spark's splits depend on the files that a filter leaves.
    """
    sent = parts.sparkSession.sparkContext.broadcast(starts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        here, state, seen, expected = None, _State(problem), 0, 0

        def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            columns = [[here[0]] * len(found), [here[1]] * len(found), [k for k, _ in found], [v for _, v in found]]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            arrays[3] = arrays[3].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, ["file", "block", "kind", "value"])

        def left() -> pa.RecordBatch:
            if here in known:
                return rows(list(state.leave()))
            # As many bytes as the file has, the added comma included, means that the file itself ends in a comma.
            if not state.closed or seen == expected:
                state.fail()
            return rows([])

        for file, block, size, text in _splits(batches):
            if not wanted(file):
                continue
            if here != (file, block):
                if here is not None:
                    yield left()
                if block and (file, block) not in known:
                    raise RuntimeError("Spark has split the files in another way than before; read them again")
                here, seen, expected = (file, block), 0, size
                in_string, depth = known.get(here, (False, 0))
                state = _State(problem, in_string, depth)
                if block:
                    if depth < 1:
                        state.fail()
                    state.opened, state.headless = True, in_string or depth > 1
            seen += len(text)
            if len(text):
                yield rows(list(state.take(text)))
        if here is not None:
            yield left()

    return parts.mapInArrow(emit, PARTS_SCHEMA)


def _joined(fragments: DataFrame) -> DataFrame:
    """Elements from their fragments: a start, what lies between, and an end."""
    order = [F.col("block"), F.when(F.col("kind") == END, 0).otherwise(1)]
    number = F.sum((F.col("kind") == START).cast("int")).over(Window.partitionBy("file").orderBy(*order))
    place = F.struct("block", (F.col("kind") != END).alias("late"), "value")
    grouped = fragments.withColumn("element", number).groupBy("file", "element").agg(F.array_sort(F.collect_list(place)).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["value"]), "")
    return grouped.select(F.btrim(whole, F.lit(_BLANK.decode())).alias("value"))


def elements(files: DataFrame, least_split: int, problem: str) -> DataFrame:
    """``value``: the text of each element of the array files of ``files``, a text reader that cuts at commas.

    Files of up to ``least_split`` bytes are never split. ``problem`` begins the message about a file that is not one array.
    The driver holds a short row for each split of a file that has several, as Spark's own planning does, and at most
    ``MAX_BROADCAST_ROWS`` of them go to the tasks at a time; the files of further ones are read in turns of their own.
    """
    size = F.col("_metadata.file_size")
    large, small = pieces(files.filter(size > least_split)), pieces(files.filter(size <= least_split))
    table = materialise(summaries(large), "splits")
    turns = max(1, -(-table.count() // MAX_BROADCAST_ROWS))
    found = [_cut(small, {}, problem, lambda file: True).select("value")]
    for turn in range(turns):
        starts = _starts(table.filter(F.pmod(F.col("file"), F.lit(turns)) == turn), problem)
        cut = _cut(large, starts, problem, lambda file, turn=turn: file % turns == turn)
        found.append(cut.filter(F.col("kind") == WHOLE).select("value"))
        torn = {file for (file, block), (in_string, depth) in starts.items() if block and (in_string or depth > 1)}
        if torn:
            found.append(_joined(_cut(large, starts, problem, torn.__contains__).filter(F.col("kind") != WHOLE)))
    return reduce(DataFrame.unionByName, found)
