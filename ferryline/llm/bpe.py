"""BPE encoding and decoding with a distinct-word table.

``encode``: Spark splits the texts into words by block (``words``), brings equal words of all blocks together, the
tokenizer sees each distinct word once, and ids go back to the blocks, where the documents are put together by
position. ``decode`` looks ids up in the id-to-piece table, which has as many rows as the vocabulary.

The tokenizers used have to treat white-space-separated words on their own, as those do that drop white space and
split before merging. Ids are binary columns of little-endian unsigned 32-bit integers.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows and null document ids
are encoded like any other; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.llm.words import answers, block_codes, block_words, bucket_count, bucket_words, meet, pack, spread, unpack

TOKENS_SCHEMA = "doc_id long, n_tokens long, ids binary"
_BATCH = 4096
_ROWS = 512
MAX_PIECES = 1 << 20


def load_tokenizer(path: str):
    """The tokenizer of a file; its settings for truncation and padding are dropped.

    Tasks already use all cores, so the library's own threads are turned off.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encode_bucket(path: str):
    loaded: list = []  # once for all buckets of a task

    def encode_bucket(rows: pa.Table) -> list[bytes]:
        distinct, which, _ = bucket_words(rows)
        if not loaded:
            loaded.append(load_tokenizer(path))
        tokenizer, ids = loaded[0], []
        for at in range(0, len(distinct), _BATCH):
            cut = [w.decode() for w in distinct[at : at + _BATCH]]
            ids += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(cut, add_special_tokens=False)]
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids)
        starts, out, at = np.cumsum(sizes) - sizes, [], 0
        for n in rows["n_words"].to_pylist():
            own = which[at : at + n]
            at += n
            packed = pack(sizes[own])
            out.append(len(packed).to_bytes(8, "little") + packed + pack(flat[spread(starts[own], sizes[own])]))
        return out

    return encode_bucket


def _assemble(found: list[bytes], places: np.ndarray, block: dict) -> pa.Table:
    cuts = [int.from_bytes(f[:8], "little") + 8 for f in found]
    none = [np.zeros(0, np.uint32)]
    by_answer = np.concatenate([unpack(f[8:cut]) for f, cut in zip(found, cuts, strict=True)] or none).astype(np.int64)
    flat = np.concatenate([unpack(f[cut:]) for f, cut in zip(found, cuts, strict=True)] or none).astype("<u4")
    sizes, starts = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    sizes[places], starts[places] = by_answer, np.cumsum(by_answer) - by_answer
    rows = []
    for end, length in zip(np.cumsum(block["lengths"]), block["lengths"], strict=True):
        own = block["codes"][end - length : end]
        rows.append(flat[spread(starts[own], sizes[own])].tobytes())
    n_tokens = pa.array([len(r) // 4 for r in rows], pa.int64())
    return pa.table({"doc_id": pa.array(block["doc_ids"], pa.int64()), "n_tokens": n_tokens, "ids": pa.array(rows, pa.binary())})


def encode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``docs``; with a ``vocabulary`` also ``decoded``, as from ``decode``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.lit(False).alias("mark"))
    buckets = bucket_count(rows, "text")
    found = answers(block_words(rows, buckets), _encode_bucket(tokenizer_path))
    codes = block_codes(rows, buckets)
    if vocabulary is None:
        return meet(found, codes, _assemble, TOKENS_SCHEMA)
    sent = docs.sparkSession.sparkContext.broadcast(_piece_table(vocabulary))

    def assemble_and_decode(answered: list[bytes], places: np.ndarray, block: dict) -> pa.Table:
        table = _assemble(answered, places, block)
        return table.append_column("decoded", _pieces_of(table["ids"], sent.value))

    return meet(found, codes, assemble_and_decode, f"{TOKENS_SCHEMA}, decoded string")


def pieces(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """(id, piece) of a vocabulary, added tokens included."""
    tokenizer = load_tokenizer(tokenizer_path)
    rows = [(i, tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return spark.createDataFrame(rows, "id int, piece string")


def _piece_table(vocabulary: DataFrame) -> list[str | None]:
    """The pieces by id; fetched once the vocabulary is found to have at most ``MAX_PIECES`` rows."""
    rows = vocabulary.limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces")
    table: list[str | None] = [None] * (max((r["id"] for r in rows), default=-1) + 1)
    for row in rows:
        table[row["id"]] = row["piece"]
    return table


def _pieces_of(column: pa.ChunkedArray | pa.Array, known: list[str | None]) -> pa.Array:
    texts, whole = [], all(p is not None for p in known)
    for ids in column:
        own = np.frombuffer(ids.as_py() or b"", "<u4")
        if whole and (not len(own) or own.max() < len(known)):
            texts.append(" ".join(map(known.__getitem__, own.tolist())))
        else:
            texts.append(" ".join(known[i] for i in own.tolist() if i < len(known) and known[i] is not None))
    return pa.array(texts, pa.string())


def decode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``tokens`` with ``decoded``: the pieces of ``ids`` parted by single spaces.

    The join with the vocabulary takes place inside the tasks. An id outside the vocabulary has no piece and is
    passed over.
    """
    kept = tokens.drop("decoded")
    sent = tokens.sparkSession.sparkContext.broadcast(_piece_table(vocabulary))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(at, _ROWS) for part in batches for at in range(0, part.num_rows, _ROWS)):
            columns = [*batch.columns, _pieces_of(batch.column("ids"), sent.value)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "decoded"])

    return kept.mapInArrow(look_up, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))
