"""Ranked lexical search, the highest-scoring documents of each query, with MaxScore over pair bounds.

Documents are dealt into blocks as they are read. Three tables of blocks follow each other in the shared folder:

* ``postings``: for each term of the queries, the documents of the block that hold it and how often;
* ``impacts``: once the counts over all documents are known, each posting's share of a score, the largest one of each
  term, and, for pairs of terms, the list of documents that hold both with the largest sum of their two shares;
* the answers: each task goes through its blocks with the queries and keeps the best documents of each so far.

In a block, a query's terms are ordered by their largest share. What the smaller ones can add together is bounded by pairs:
of two terms, no document gains more than the joint maximum of their list or the larger of the two alone, which is
less than the sum of both maxima whenever their highest shares lie in different documents. As long as the bound of the
first terms stays below the k-th best score so far, documents that hold none of the others are never looked at; the
remaining candidates are given up as soon as their score and the bound of what is left, which says for each candidate
whether it is in a pair's list, fall below it. Nothing is approximate: bounds are integers and hold for every document.

No list is gathered over blocks, so a term in a third of all documents is no hot spot, and tasks hand on at most k rows of
each query. Queries are handled in groups of at most ``GROUP_BYTES`` of text, which is what a task holds of them.

A term is a run of ASCII letters, digits and all bytes from 0x80 on, with A-Z in lower case. With N documents that hold
a term, L terms in them, n terms in a document, df documents that hold a term and tf occurrences, a term has the weight
w = floor(1000 * ln((2N + 2) / (2df + 1))), a document m = 75 + (25 * n * N) div L, and a query's score is the sum over its terms,
repeats included, of w * ((1000000000 * tf) div (1000 * tf + 12 * m)).

Defined cases: null and empty texts, and texts without terms, are neither documents nor queries with a result; texts of
any length are read whole; every row of either table counts by itself, also where rows or ids repeat; equal scores go by
ascending id, a null id last; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferryline.llm.words import join_arrays, split_arrays
from ferryline.session import materialise

BLOCK_BYTES = 16 << 20
GROUP_BYTES = 32 << 20
# What a query counts besides its text.
QUERY_BYTES = 64
# Of each query, all pairs among so many of its most frequent terms get a list.
PAIRED_TERMS = 8
_NO_ID = np.iinfo(np.int64).max

POSTINGS_SCHEMA = "ids array<long>, n_docs long, n_terms long, terms array<int>, dfs array<int>, postings binary"
IMPACTS_SCHEMA = "ids array<long>, impacts binary, pairs binary"
FOUND_SCHEMA = "query int, doc_id long, score long"

_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Queries:
    """The terms of a group of queries by number, and each query as term numbers and how often it names them."""

    numbers: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @staticmethod
    def of(texts: list[str | None]) -> Queries:
        numbers: dict[bytes, int] = {}
        terms, times = [], []
        for text in texts:
            counted = Counter(terms_of((text or "").encode()))
            terms.append(np.array([numbers.setdefault(t, len(numbers)) for t in counted], np.int64))
            times.append(np.array(list(counted.values()), np.int64))
        return Queries(numbers, terms, times)

    def pairs(self, dfs: np.ndarray, paired: int) -> np.ndarray:
        """Pairs of term numbers, lower one first: those among the most frequent terms of each query."""
        out: set[tuple[int, int]] = set()
        for own in self.terms:
            most = own[np.argsort(-dfs[own], kind="stable")][:paired]
            out.update(combinations(sorted(most.tolist()), 2))
        return np.array(sorted(out), np.int64).reshape(-1, 2)


def _by_term(terms: np.ndarray, count: int) -> np.ndarray:
    """Where the entries of each term begin in a sorted list of term numbers."""
    return np.searchsorted(terms, np.arange(count + 1))


def postings(docs: DataFrame, numbers: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Blocks of documents with the postings of the given terms."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def block(ids: list, lengths: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
        kept = [i for i, n in enumerate(lengths) if n]
        own = np.array([lengths[i] for i in kept], np.int64)
        flat = np.concatenate([codes[i] for i in kept] or [np.zeros(0, np.int64)])
        rows = np.repeat(np.arange(len(kept)), own)
        known = flat >= 0
        keys, tf = np.unique(flat[known] * len(kept) + rows[known], return_counts=True)
        terms, at = keys // max(1, len(kept)), keys % max(1, len(kept))
        distinct, dfs = np.unique(terms, return_counts=True)
        packed = join_arrays([own, terms.astype(np.int32), at.astype(np.int32), tf.astype(np.int32)])
        columns = [[[ids[i] for i in kept]], [len(kept)], [int(own.sum())], [distinct.tolist()], [dfs.tolist()], [packed]]
        types = [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "n_docs", "n_terms", "terms", "dfs", "postings"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        ids, lengths, codes, size = [], [], [], 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                body = value.as_py() or b""
                words = terms_of(body)
                ids.append(name)
                lengths.append(len(words))
                codes.append(np.fromiter(map(number, words, repeat(-1)), np.int64, len(words)))
                size += len(body)
                if size >= BLOCK_BYTES:
                    yield block(ids, lengths, codes)
                    ids, lengths, codes, size = [], [], [], 0
        if ids:
            yield block(ids, lengths, codes)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(emit, POSTINGS_SCHEMA)


def _weights(blocks: DataFrame, count: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """N, L, and df and weight of each term of the queries; as many rows are fetched as the queries have terms."""
    total = blocks.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).head()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    listed = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
    dfs = np.zeros(count, np.int64)
    for row in listed.groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).collect():
        dfs[row["terms"]] = row["df"]
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in dfs.tolist()]
    return n_docs, n_terms, dfs, np.array(weights, np.int64)


def impacts(blocks: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Blocks with each posting's share of a score, and the lists of pairs of terms with their joint maxima."""
    sent = blocks.sparkSession.sparkContext.broadcast((weights, pairs))

    def weighed(packed: bytes) -> tuple[bytes, bytes]:
        weight, chosen = sent.value
        lengths, terms, at, tf = split_arrays(packed)
        m = 75 + 25 * lengths * n_docs // n_terms
        share = weight[terms] * (1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * m[at]))
        cuts = _by_term(terms, len(weight))
        most = np.zeros(len(weight), np.int64)
        held = np.flatnonzero(np.diff(cuts))
        if len(held):
            most[held] = np.maximum.reduceat(share, cuts[held])
        found, joint, sizes, lists = [], [], [], []
        other = np.zeros(len(lengths), np.int64)
        inside = np.zeros(len(lengths), bool)
        last = -1
        for pair, (a, b) in enumerate(chosen.tolist()):
            if a != last:
                if last >= 0:
                    inside[at[cuts[last] : cuts[last + 1]]] = False
                inside[at[cuts[a] : cuts[a + 1]]] = True
                other[at[cuts[a] : cuts[a + 1]]] = share[cuts[a] : cuts[a + 1]]
                last = a
            rows = at[cuts[b] : cuts[b + 1]]
            both = inside[rows]
            if both.any():
                found.append(pair)
                joint.append(int((share[cuts[b] : cuts[b + 1]][both] + other[rows[both]]).max()))
                sizes.append(int(both.sum()))
                lists.append(rows[both])
        listed = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        packed_pairs = join_arrays([np.array(found, np.int64), np.array(joint, np.int64), np.array(sizes, np.int64), listed])
        return join_arrays([terms, at, share, most]), packed_pairs

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = weighed(batch.column(1)[i].as_py())
                columns = [batch.column(0).slice(i, 1), pa.array([one], pa.binary()), pa.array([two], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "impacts", "pairs"])

    return blocks.filter("n_docs > 0").select("ids", "postings").mapInArrow(emit, IMPACTS_SCHEMA)


class Block:
    """One block, unpacked."""

    def __init__(self, ids: list, shares: bytes, pairs: bytes, chosen: np.ndarray) -> None:
        self.ids = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        terms, self.at, self.share, self.most = split_arrays(shares)
        self.cuts = _by_term(terms, len(self.most))
        found, joint, sizes, listed = split_arrays(pairs)
        ends = np.cumsum(sizes)
        self.lists = {
            tuple(chosen[pair]): (int(most), listed[end - size : end])
            for pair, most, size, end in zip(found.tolist(), joint.tolist(), sizes.tolist(), ends.tolist(), strict=True)
        }
        self.none = listed[:0]

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.cuts[term], self.cuts[term + 1]
        return self.at[low:high], self.share[low:high]


@dataclass
class Bounds:
    """Of terms by rising maximum: ``prefix[i]`` bounds what the first i can add; ``matched[i]`` is the earlier term that term i is paired with."""

    prefix: list[int]
    matched: dict[int, tuple[int, int, np.ndarray]]


def bounds(block: Block, terms: list[int], times: list[int], singles: list[int], paired: set[tuple[int, int]]) -> Bounds:
    """Each term is paired with the earlier, still single term that lowers the sum most."""
    prefix, matched, free = [0], {}, []
    for i, term in enumerate(terms):
        best = None
        for j in free:
            key = (min(term, terms[j]), max(term, terms[j]))
            if key not in paired:
                continue
            joint, listed = block.lists.get(key, (0, block.none))
            both = min(times[i], times[j])
            more = joint * both + (times[i] - both) * (singles[i] // times[i]) + (times[j] - both) * (singles[j] // times[j])
            together = max(more if len(listed) else 0, singles[i], singles[j])
            saved = singles[i] + singles[j] - together
            if saved > 0 and (best is None or saved > best[0]):
                best = (saved, j, together, listed)
        if best is None:
            prefix.append(prefix[-1] + singles[i])
            free.append(i)
        else:
            prefix.append(prefix[-1] + singles[i] - best[0])
            free.remove(best[1])
            matched[i] = best[1:]
    return Bounds(prefix, matched)


@dataclass
class Best:
    """The best documents of a query so far, at most k, and the score from which a document counts."""

    k: int
    scores: np.ndarray
    ids: np.ndarray

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def look_up(block: Block, terms: np.ndarray, times: np.ndarray, paired: set[tuple[int, int]], best: Best) -> int:
    """Adds the block's best documents for a query; returns how many postings were read or looked up."""
    most = block.most[terms] * times
    order = [i for i in np.argsort(most, kind="stable").tolist() if most[i] > 0]
    own, often, singles = terms[order].tolist(), times[order].tolist(), most[order].tolist()
    bound = bounds(block, own, often, singles, paired)
    floor, read = best.floor, 0
    first = len(own)
    while first and bound.prefix[first - 1] >= floor:
        first -= 1
    needed = first - 1 if first else 0
    if not own or bound.prefix[-1] < floor:
        return 0
    score = np.zeros(len(block.ids), np.int64)
    for i in range(needed, len(own)):
        at, share = block.of(own[i])
        score[at] += share * often[i]
        read += len(at)
    left = np.flatnonzero(score)
    if needed and len(left):
        left = left[score[left] + _rest(block, bound, singles, needed, left) >= floor]
    for i in range(needed - 1, -1, -1):
        left = left[score[left] + bound.prefix[i + 1] >= floor]
        if not len(left):
            return read
        at, share = block.of(own[i])
        place = np.minimum(np.searchsorted(at, left), len(at) - 1)
        held = at[place] == left
        score[left[held]] += share[place[held]] * often[i]
        read += len(left)
    left = left[score[left] >= floor]
    best.add(score[left], block.ids[left])
    return read


def _rest(block: Block, bound: Bounds, singles: list[int], count: int, rows: np.ndarray) -> np.ndarray:
    """What the first ``count`` terms can add to each of ``rows``: a pair's joint maximum only where its list holds the row."""
    inside = np.zeros(len(block.ids), bool)
    rest = np.zeros(len(rows), np.int64)
    pairs = {i: m for i, m in bound.matched.items() if i < count}
    for i, (j, together, listed) in pairs.items():
        inside[listed] = True
        rest += np.where(inside[rows], together, max(singles[i], singles[j]))
        inside[listed] = False
    taken = set(pairs) | {m[0] for m in pairs.values()}
    return rest + sum(singles[i] for i in range(count) if i not in taken)


def _answers(index: DataFrame, asked: Queries, chosen: np.ndarray, k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast((asked.terms, asked.times, chosen))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, times, pairs = sent.value
        paired = set(map(tuple, pairs.tolist()))
        none = np.zeros(0, np.int64)
        found = [Best(k, none, none) for _ in terms]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["ids"], row["impacts"], row["pairs"], pairs)
                for query, best in enumerate(found):
                    look_up(block, terms[query], times[query], paired, best)
        for query, best in enumerate(found):
            names = pa.array(best.ids, pa.int64(), mask=best.ids == _NO_ID)
            columns = [pa.array([query] * len(best.ids), pa.int32()), names, pa.array(best.scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return index.mapInArrow(emit, FOUND_SCHEMA)


def _search_group(docs: DataFrame, texts: list[str | None], k: int, doc_id: str, text: str) -> DataFrame:
    """(query, rank, doc_id, score) for queries numbered by their place in ``texts``."""
    asked = Queries.of(texts)
    blocks = materialise(postings(docs, asked.numbers, doc_id, text), "postings")
    n_docs, n_terms, dfs, weights = _weights(blocks, len(asked.numbers))
    chosen = asked.pairs(dfs, PAIRED_TERMS)
    index = materialise(impacts(blocks, n_docs, n_terms, weights, chosen), "impacts")
    best_first = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return _answers(index, asked, chosen, k).withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def _groups(spark: SparkSession, queries: DataFrame) -> Iterator[list]:
    """The queries, in groups of at most ``GROUP_BYTES`` of text (or one longer text)."""
    group, size = [], 0
    for row in queries.toLocalIterator():
        group.append(row)
        size += len(row["text"] or "") + QUERY_BYTES
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def search(
    docs: DataFrame, queries: DataFrame, k: int = 20, query_id: str = "item_id", query_text: str = "text", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents with the highest scores above 0 of each query."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).cast("long").alias("name"), F.col(query_text).alias("text"))
    schema = f"{query_id} long, rank int, doc_id long, score long"
    parts = [spark.createDataFrame([], schema)]
    for group in _groups(spark, asked):
        named = spark.createDataFrame([(i, row["name"]) for i, row in enumerate(group)], f"query int, {query_id} long")
        found = _search_group(docs, [row["text"] for row in group], k, doc_id, text)
        parts.append(found.join(F.broadcast(named), "query").select(query_id, F.col("rank").cast("int"), "doc_id", "score"))
    if len(parts) == 2:
        return parts[1]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
