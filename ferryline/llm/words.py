"""Words of texts, and tables of the distinct words of blocks of documents.

A word is a run of bytes other than space and 0x09 to 0x0D, which is how ``bytes.split()`` cuts. A block is a stretch
of rows of one input partition with at most ``BLOCK_BYTES`` of text (or a single longer text). Each block is laid
down in two parts: its distinct words, dealt into buckets by a checksum of the word, and one row with its documents
as sequences of places in the word list. Equal words of all blocks meet in a bucket, where what a word stands for
(ids, a count) is found once; the answers go back to the block in the order of its words, while texts never move.

A row holds all words of a block that lie in a bucket, packed together: there are never more rows than pairs of block
and word, and far fewer as long as blocks have many words of each bucket.

Where both parts come from scans of their own, the input has to give the same rows in the same order each time: a
table, not the outcome of a shuffle; ``words_and_codes`` reads it once. A block's name holds a checksum of its words, and ``meet`` refuses answers
that are not for the block's own words.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.session import materialise

BLOCK_BYTES = 8 << 20
LEAST_BUCKETS = 128
BUCKET_BYTES = 8 << 20

WORDS_SCHEMA = "bucket int, block long, n_words int, words binary, counts binary"
CODES_SCHEMA = "block long, n_words int, buckets binary, doc_ids array<long>, marks array<boolean>, lengths array<int>, codes binary"

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def texts_of(batch: pa.RecordBatch, column: int = 1) -> Iterator[bytes]:
    """The UTF-8 bytes of a column of texts; null is empty."""
    for text in batch.column(column).cast(pa.binary()):
        yield text.as_py() or b""


def zipped(data: bytes) -> bytes:
    """Compressed, with its length in front."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as four planes of bytes, compressed; of small numbers the high planes are flat."""
    return zipped(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(unzipped(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def join_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers one after the other: a short head, then the bytes of each array plane by plane, compressed."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        body = zipped(np.ascontiguousarray(planes).tobytes())
        parts += [a.dtype.str.encode().ljust(4), len(body).to_bytes(8, "little"), body]
    return b"".join(parts)


def split_arrays(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size = np.dtype(data[at : at + 4].strip().decode()), int.from_bytes(data[at + 4 : at + 12], "little")
        planes = np.frombuffer(unzipped(data[at + 12 : at + 12 + size]), np.uint8).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 12 + size
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i], starts[i] + 1, ...`` of ``lengths[i]`` each, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def bucket_count(docs: DataFrame, text: str) -> int:
    """Buckets for the words of ``docs``: one for each ``BUCKET_BYTES`` of text."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).head()["n"] or 0
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


def block_name(check: int, part: int, number: int) -> int:
    """A number of 64 bits from a checksum of 32, an input partition and a block's place in it."""
    if part >= 1 << 20 or number >= 1 << 12:
        raise ValueError("too many blocks for a block's name; read the table in fewer or more even splits")
    return ((check - (1 << 31)) << 32) | (part << 12) | number


class _Block:
    def __init__(self, lower: bool) -> None:
        self.lower, self.bytes = lower, 0
        self.seen: defaultdict[bytes, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.ids: list[int | None] = []
        self.marks: list[bool] = []
        self.codes: list[np.ndarray] = []

    def add(self, doc_id: int | None, mark: bool, text: bytes) -> None:
        words = (text.translate(ASCII_LOWER) if self.lower else text).split()
        self.ids.append(doc_id)
        self.marks.append(mark)
        self.codes.append(np.fromiter(map(self.seen.__getitem__, words), np.uint32, len(words)))
        self.bytes += len(text)

    def close(self, part: int, number: int) -> tuple[int, list[bytes], np.ndarray]:
        """Name, words from the most frequent on, and the codes of all documents in a row."""
        codes = np.concatenate(self.codes)
        order = np.argsort(-np.bincount(codes, minlength=len(self.seen)), kind="stable")
        listed = list(self.seen)
        words = [listed[i] for i in order]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return block_name(zlib.crc32(b" ".join(words)), part, number), words, rank[codes] if len(codes) else codes


def _blocks(batches: Iterator[pa.RecordBatch], lower: bool) -> Iterator[tuple[int, list[bytes], np.ndarray, _Block]]:
    part, number, block = TaskContext.get().partitionId(), 0, _Block(lower)
    for batch in batches:
        names, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for doc_id, mark, text in zip(names, marks, texts_of(batch), strict=True):
            block.add(doc_id, bool(mark), text)
            if block.bytes >= BLOCK_BYTES:
                yield *block.close(part, number), block
                number, block = number + 1, _Block(lower)
    if block.ids:
        yield *block.close(part, number), block


def _buckets(words: list[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(count)


def _word_rows(name: int, words: list[bytes], codes: np.ndarray, block: _Block, buckets: int) -> pa.RecordBatch:
    dealt = _buckets(words, buckets)
    order = np.argsort(dealt, kind="stable")
    marked = np.repeat(np.array(block.marks, bool), [len(c) for c in block.codes])
    counts = np.bincount(codes[marked], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
    ends = np.flatnonzero(np.diff(dealt[order], append=np.uint32(buckets))) + 1
    rows = [order[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(words) else []
    columns = [
        pa.array([int(dealt[r[0]]) for r in rows], pa.int32()),
        pa.array([name] * len(rows), pa.int64()),
        pa.array([len(r) for r in rows], pa.int32()),
        pa.array([zipped(b" ".join([words[i] for i in r])) for r in rows], pa.binary()),
        pa.array([pack(counts[r]) for r in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "n_words", "words", "counts"])


def _code_row(name: int, words: list[bytes], codes: np.ndarray, block: _Block, buckets: int) -> pa.RecordBatch:
    columns = [
        pa.array([name]),
        pa.array([len(words)], pa.int32()),
        pa.array([pack(_buckets(words, buckets))], pa.binary()),
        pa.array([block.ids], pa.list_(pa.int64())),
        pa.array([block.marks], pa.list_(pa.bool_())),
        pa.array([[len(c) for c in block.codes]], pa.list_(pa.int32())),
        pa.array([pack(codes)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "n_words", "buckets", "doc_ids", "marks", "lengths", "codes"])


def block_words(docs: DataFrame, buckets: int, lower: bool = False) -> DataFrame:
    """The distinct words of each block by bucket. ``docs`` has the columns id, text and mark.

    ``counts`` says how often each word occurs in the block's marked documents.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, codes, block in _blocks(batches, lower):
            yield _word_rows(name, words, codes, block, buckets)

    return docs.mapInArrow(emit, WORDS_SCHEMA)


def block_codes(docs: DataFrame, buckets: int, lower: bool = False) -> DataFrame:
    """One row for each block: its documents, their lengths in words, and all codes in a row, packed."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, codes, block in _blocks(batches, lower):
            yield _code_row(name, words, codes, block, buckets)

    return docs.mapInArrow(emit, CODES_SCHEMA)


def words_and_codes(docs: DataFrame, buckets: int, lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """``block_words`` and ``block_codes`` from one scan of the texts, laid down in one table."""
    types = {
        "bucket": pa.int32(), "block": pa.int64(), "n_words": pa.int32(), "words": pa.binary(), "counts": pa.binary(), "buckets": pa.binary(),
        "doc_ids": pa.list_(pa.int64()), "marks": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "codes": pa.binary(),
    }
    shared = ("block", "n_words")
    own = [f for f in CODES_SCHEMA.split(", ") if f.split()[0] not in shared]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, codes, block in _blocks(batches, lower):
            for part in (_word_rows(name, words, codes, block, buckets), _code_row(name, words, codes, block, buckets)):
                has = dict(zip(part.schema.names, part.columns, strict=True))
                yield pa.RecordBatch.from_arrays([has[c] if c in has else pa.nulls(part.num_rows, t) for c, t in types.items()], list(types))

    parts = materialise(docs.mapInArrow(emit, ", ".join([WORDS_SCHEMA, *own])), "parts")
    names = ([f.split()[0] for f in schema.split(", ")] for schema in (WORDS_SCHEMA, CODES_SCHEMA))
    return tuple(parts.filter(which).select(*c) for which, c in zip(("bucket is not null", "bucket is null"), names, strict=True))


def bucket_words(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a bucket; for the words of all its rows in a row, which they are and how often marked."""
    listed = [w for packed in rows["words"].to_pylist() for w in unzipped(packed).split(b" ")]
    coded = pa.array(listed, pa.binary()).dictionary_encode()
    counts = [unpack(packed) for packed in rows["counts"].to_pylist()]
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.concatenate(counts).astype(np.int64)


def answers(words: DataFrame, body: Callable[[pa.Table], list[bytes]]) -> DataFrame:
    """(block, bucket, n_words, found): ``body`` gives the answer to each row of a bucket."""

    def find(rows: pa.Table) -> pa.Table:
        found = pa.array(body(rows), pa.binary())
        return pa.table([rows["block"], rows["bucket"], rows["n_words"], found], names=["block", "bucket", "n_words", "found"])

    return words.groupBy("bucket").applyInArrow(find, "block long, bucket int, n_words int, found binary")


def in_word_order(found: pa.Table, block: dict) -> tuple[list[bytes], np.ndarray]:
    """The answers by bucket, and the places in the block's word list that they speak of, one after the other."""
    own = found.sort_by("bucket")
    dealt = unpack(block["buckets"])
    sizes = np.bincount(dealt) if len(dealt) else np.zeros(0, np.int64)
    if own["n_words"].to_pylist() != sizes[sizes > 0].tolist() or block["n_words"] != len(dealt):
        raise RuntimeError("a block's words and documents differ: its input gave other rows when read again")
    return own["found"].to_pylist(), np.argsort(dealt, kind="stable")


def meet(found: DataFrame, codes: DataFrame, body: Callable[[list[bytes], np.ndarray, dict], pa.Table], schema: str) -> DataFrame:
    """Brings answers together with their block's documents; ``body(answers, places, block)`` gives the output rows."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows != 1:
            raise RuntimeError("a block's words and documents differ: its input gave other rows when read again")
        block = right.to_pylist()[0]
        block["lengths"] = np.array(block["lengths"], np.int64)
        block["codes"] = unpack(block["codes"])
        return body(*in_word_order(left, block), block)

    return found.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(join, schema)
