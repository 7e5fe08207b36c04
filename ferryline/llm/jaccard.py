"""Near-duplicate groups: a Jaccard join of word shingles by R-trees over count vectors.

A document's set holds its distinct shingles of five lower-cased words (64-bit hashes). Shingles are hashed into
groups, and a set's counts by group are a point; two sets share at most the sum of the coordinate minima of their
points, which also holds between a point and the upper corner of a box of points. An R-tree over the points of a
block gives for each of them those that could share enough; of these go on that share enough by finer points, which have
more groups than a set has shingles, and are verified on whole texts. The number of
groups is a power of two that grows with the set, as the bound says little about sets much larger than it; points of
neighbouring resolutions are compared by adding up neighbouring groups.

Blocks come from prefixes: sets with a similarity of at least 0.75 share one of the first ``n - ceil(0.75 n) + 1``
shingles in any fixed order of all shingles. The order puts shingles last that are found ``FREQUENT`` times in one of
``SAMPLED`` documents, so that a block has some ``FREQUENT * SAMPLED`` members at any size of the table unless nothing in its
documents is rare. They go to the tasks as a filter of a fixed number of bits, which now and then takes another shingle
for a frequent one, the same for all documents. Both bear on the cost alone: every document is in the blocks of its prefix.

Groups of any size: equal sets are one node from the start. A first pass tests each set against the smallest id of
one of its blocks and joins what is alike, so a large group of near copies is one component after it. The second pass
looks at blocks that still hold several components, and only at pairs across them; a block of more than ``TILE``
members is dealt out as pairs of tiles.

Defined cases: a text with fewer than five words is one shingle, a null or empty text has none and is linked with
nothing; rows without an id are given back with no component; rows that share an id are one node with the links of
all of them; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.components import components
from ferryline.llm.words import ASCII_LOWER, texts_of, unzipped, zipped
from ferryline.session import materialise

WIDTH = 5
PERCENT = 75
LEAST_GROUPS, SHINGLES_A_GROUP = 256, 4
# Points are kept with this many more bits than the trees are built on.
FINER_BITS = 3
SAMPLED = 10
FREQUENT = 5
ORDER_BITS = 1 << 26
TILE = 256
POINT_BYTES_A_TASK = 24 << 20
FANOUT = 16
FILTER_BITS = 1 << 25
_KEPT_WORDS = 250_000

KEY = ["n_shingles", "key1", "key2"]
SETS_SCHEMA = "id long, n_shingles long, key1 long, key2 long, prefix array<long>, counts binary"

# Odd multipliers, one for each word of a shingle, and the steps of a 64-bit finaliser.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in _MIX:
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingles(text: bytes, hashes: dict) -> np.ndarray:
    """The set of a text, sorted."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    wide = min(len(words), WIDTH)
    count = len(words) - wide + 1
    sums = np.full(count, wide, np.uint64)
    for k in range(wide):
        sums += values[k : k + count] * _FACTORS[k]
    return np.unique(_mixed(sums))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def least_overlap(a: np.ndarray | int, b: np.ndarray | int):
    """The shared shingles two sets of these sizes need: 100 * shared >= PERCENT * (a + b - shared)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def group_bits(n: int) -> int:
    """Log 2 of the number of groups of a tree's points at ``n`` shingles; sizes within 4/3 of each other differ by one at most."""
    return max(LEAST_GROUPS, n // SHINGLES_A_GROUP).bit_length() - 1


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def point(own: np.ndarray) -> np.ndarray:
    bits = group_bits(len(own)) + FINER_BITS
    return _narrow(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))


def folded(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts by group at a resolution that is no finer."""
    return counts if len(counts) == 1 << bits else _narrow(counts.reshape(1 << bits, -1).sum(axis=1))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The shingles found ``FREQUENT`` times or more in one of ``SAMPLED`` documents, as bits: shingle h at its low bits."""
    sample = docs.filter(F.pmod(F.xxhash64("id", F.lit("order")), F.lit(SAMPLED)) == 0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _WordHash()
            own = [shingles(text, hashes) for text in texts_of(batch)]
            values, counts = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(values)), pa.array(counts.astype(np.int64))], ["h", "n"])

    counted = sample.mapInArrow(emit, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    return _bit_table(counted, F.col("h").bitwiseAND(F.lit(ORDER_BITS - 1)), ORDER_BITS)


def _bit_table(rows: DataFrame, spot: Column, size: int) -> np.ndarray:
    """A table of ``size`` bits, set at the spots of ``rows``; fetched as words of 32, so no more than that comes to the driver."""
    words = rows.select(F.shiftright(spot, 5).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 32).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(size // 32, np.uint32)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return table


def _is_set(table: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (table[spots >> 5] >> (spots & 31).astype(np.uint32)) & np.uint32(1) == 1


def sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Size, identity (two 64-bit sums), prefix and packed point of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, hashes = sent.value, _WordHash()
        for batch in (part.slice(at, 512) for part in batches for at in range(0, part.num_rows, 512)):
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                own = shingles(text, hashes)
                if not len(own):
                    rows.append((name, 0, 0, 0, [], b""))
                    continue
                keys = own.sum(), _mixed(own ^ _FACTORS[0]).sum()
                wanted = prefix_length(len(own))
                last = _is_set(late, (own & np.uint64(ORDER_BITS - 1)).astype(np.int64))
                first = np.concatenate([own[~last][:wanted], own[last][:wanted]])[:wanted]
                packed = _packed(point(own))
                rows.append((name, len(own), int(_signed(keys[0])), int(_signed(keys[1])), _signed(first), packed))
            if len(hashes) > _KEPT_WORDS:
                hashes.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_shingles", "key1", "key2", "prefix", "counts"])

    return docs.mapInArrow(emit, SETS_SCHEMA)


def blocks(found: DataFrame, reps: DataFrame) -> DataFrame:
    """(h, id, first, members): sets that share a shingle of their prefixes, one block for each set of members.

    ``first`` is the smallest id of the block. Equal sets are represented by their smallest id. What rows are joined
    with is written first, so that both sides of a join are plain shuffles and a crowded shingle can be split.
    """
    rows = found.select(F.explode("prefix").alias("h"), "id")
    shared = materialise(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared")
    own = reps.select(F.col("rep").alias("id")).distinct()
    rows = materialise(rows.join(shared.hint("shuffle_hash"), "h").join(own, "id", "left_semi").distinct(), "blocks")
    sums = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
    block = rows.groupBy("h").agg(F.count("*").alias("members"), F.min("id").alias("first"), *sums).filter("members > 1")
    once = block.groupBy("members", "first", "s0", "s1").agg(F.min("h").alias("h")).select("h", "first", "members")
    return rows.join(materialise(once, "once").hint("shuffle_hash"), "h")


def _maybe_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not in ``ids``: a filter of a fixed number of bits goes to the tasks.

    It only spares the join that follows some rows; the more ids there are, the fewer it spares.
    """
    spot = F.pmod(F.xxhash64("id", F.lit("filter")), F.lit(FILTER_BITS))
    sent = docs.sparkSession.sparkContext.broadcast(_bit_table(ids, spot, FILTER_BITS))

    @F.pandas_udf("boolean")
    def possible(at):
        import pandas

        return pandas.Series(_is_set(sent.value, at.to_numpy(np.int64)))

    return docs.withColumn("_spot", F.coalesce(spot, F.lit(0))).filter(possible("_spot")).drop("_spot")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked for."""
    pairs = materialise(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = materialise(_maybe_in(docs, ids).join(ids, "id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in (part.slice(at, 256) for part in batches for at in range(0, part.num_rows, 256)):
            keep, known = [], {}
            for x, y in zip(texts_of(batch, 2), texts_of(batch, 3), strict=True):
                # Texts come again in neighbouring pairs.
                left, right = (known[t] if t in known else known.setdefault(t, shingles(t, hashes)) for t in (x, y))
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= PERCENT * (len(left) + len(right) - shared))
            if len(hashes) > _KEPT_WORDS:
                hashes.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(test, "a long, b long").distinct()


class RTree:
    """Boxes over points, ``FANOUT`` to a box; points lie in the order of size and then of their largest groups."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray) -> None:
        if len(sizes) > FANOUT:
            heavy = np.argsort(-points.sum(axis=0), kind="stable")[:2]
            self.order = np.lexsort((points[:, heavy[1]], points[:, heavy[0]], np.floor(np.log(np.maximum(sizes, 1)) * 4)))
        else:
            self.order = np.arange(len(sizes))
        self.levels = [(sizes[self.order], sizes[self.order], points[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            low, high, upper = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(upper, cuts)))

    def candidates(self, size: int, own: np.ndarray) -> np.ndarray:
        """Positions of the points that could share enough with a point."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, upper = self.levels[depth]
            # A box's least size bounds the overlap asked for; sizes beyond 4/3 of each other never qualify.
            smallest = np.maximum(low[at], -(-PERCENT * size // 100))
            fits = (high[at] * 100 >= PERCENT * size) & (low[at] * PERCENT <= 100 * size)
            at = at[fits & (np.minimum(upper[at], own).sum(axis=1) >= least_overlap(size, smallest))]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def _packed(counts: np.ndarray) -> bytes:
    return bytes([counts.itemsize]) + zipped(counts.tobytes())


def _point(packed: bytes) -> np.ndarray:
    return np.frombuffer(unzipped(packed[1:]), f"<u{packed[0]}")


@dataclass
class _Members:
    """The members of blocks as columns; points by row."""

    ids: np.ndarray
    tiles: np.ndarray
    sizes: np.ndarray
    components: np.ndarray
    points: list[np.ndarray]
    bits: np.ndarray
    known: dict[tuple[int, int], np.ndarray]

    def point(self, k: int, bits: int) -> np.ndarray:
        """A member's point at a resolution; equal points are folded once."""
        whole = self.points[k]
        if (id(whole), bits) not in self.known:
            self.known[id(whole), bits] = folded(whole, bits)
        return self.known[id(whole), bits]

    @staticmethod
    def of(table: pa.Table) -> _Members:
        known: dict[bytes, np.ndarray] = {}
        points = [known[p] if p in known else known.setdefault(p, _point(p)) for p in table["counts"].to_pylist()]
        columns = (table[c].to_numpy() for c in ("id", "tile", "n_shingles", "component"))
        return _Members(*columns, points, np.array([len(p).bit_length() - 1 for p in points]), {})


def _stacked(points: list[np.ndarray]) -> np.ndarray:
    return np.stack(points, dtype=np.result_type(*{p.dtype for p in points}), casting="safe")


def _join_block(members: _Members, begin: int, end: int, tiles: tuple[int, int]) -> set[tuple[int, int]]:
    """Pairs across components of a block (or of two of its tiles) that the points allow."""
    rows, found = np.arange(begin, end), set()
    names = members.components[rows]
    if (names == names[0]).all():
        return found
    own, other = rows[members.tiles[rows] == tiles[0]], rows[members.tiles[rows] == tiles[1]]
    for level in np.unique(members.bits[rows]):
        # Members of this resolution and of the next finer one; a set looks at its own level and the one below.
        held, asking = (x[(members.bits[x] == level) | (members.bits[x] == level + 1)] for x in (other, own))
        if not len(held) or not len(asking):
            continue
        coarse, finer = int(level) - FINER_BITS, None
        near = RTree(members.sizes[held], _stacked([members.point(j, coarse) for j in held])).candidates
        for k in asking:
            size = int(members.sizes[k])
            at = near(size, members.point(k, coarse))
            at = at[members.components[held[at]] != members.components[k]]
            if not len(at):
                continue
            # What a tree's points allow between texts that share half their shingles, finer points mostly do not.
            finer = _stacked([members.point(j, int(level)) for j in held]) if finer is None else finer
            shared = np.minimum(finer[at], members.point(k, int(level))).sum(axis=1)
            for j in held[at[shared >= least_overlap(size, members.sizes[held[at]])]]:
                if tiles[0] != tiles[1] or members.ids[j] > members.ids[k]:
                    a, b = int(members.ids[j]), int(members.ids[k])
                    found.add((min(a, b), max(a, b)))
    return found


def across(members: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a block and that the count vectors allow."""
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialise(named.select("h", "id", "component"), "named")
    block = named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    # Blocks now differ by component; those that still hold several go on.
    open_blocks = materialise(block.filter("low <> high").select("h", "members"), "open")
    vectors = found.filter("n_shingles > 0").select("id", "n_shingles", "counts").distinct()
    rows = named.join(open_blocks.hint("shuffle_hash"), "h").withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id", F.lit("tile")), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"low_tile": F.least("tile", "other"), "high_tile": F.greatest("tile", "other")})
    rows = materialise(rows.select("h", "low_tile", "high_tile", "tile", "id", "component"), "tiles")
    # Longer sets have more groups and are in more blocks.
    width, places = F.greatest(F.lit(LEAST_GROUPS), F.col("n_shingles") / SHINGLES_A_GROUP) * (1 << FINER_BITS), F.size("prefix")
    wide = found.agg((F.sum(width * places) / F.sum(places)).alias("bytes")).head()["bytes"] or LEAST_GROUPS
    tasks = max(256, int(rows.count() * wide / POINT_BYTES_A_TASK) + 1)
    task = F.pmod(F.xxhash64("h", "low_tile", "high_tile"), F.lit(tasks)).cast("int")
    dealt = rows.join(vectors, "id").withColumn("task", task)

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("low_tile", "ascending"), ("high_tile", "ascending")])
        keys = np.column_stack([table[c].to_numpy() for c in ("h", "low_tile", "high_tile")])
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        pairs: set[tuple[int, int]] = set()
        members = _Members.of(table)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            pairs |= _join_block(members, a, b, (int(keys[a, 1]), int(keys[a, 2])))
        columns = list(zip(*sorted(pairs), strict=True)) or [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return dealt.groupBy("task").applyInArrow(search, "a long, b long").distinct()


def bounded(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose sizes and count vectors allow the similarity asked for."""
    vectors = found.filter("n_shingles > 0").select("id", "n_shingles", "counts")
    sides = [vectors.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("counts").alias(f"c_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").filter("true").join(sides[1], "b")
    both = both.filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = []
            for left, right in zip(batch.column("c_a").to_pylist(), batch.column("c_b").to_pylist(), strict=True):
                x, y = _point(left), _point(right)
                level = min(len(x), len(y)).bit_length() - 1
                most.append(int(np.minimum(folded(x, level), folded(y, level)).sum()))
            keep = pa.array(np.array(most) >= least_overlap(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInArrow(test, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    whole = materialise(sets(rows, frequent_shingles(rows)), "sets")
    found = whole.filter("id is not null and n_shingles > 0")
    reps = materialise(found.groupBy(*KEY).agg(F.min("id").alias("rep")), "reps")
    copies = found.select("id", *KEY).join(reps, KEY).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    members = materialise(blocks(found, reps), "members")

    texts = rows.filter("id is not null and text is not null")
    stars = members.filter("id <> first").groupBy(F.col("id").alias("b")).agg(F.min("first").alias("a")).select("a", "b")
    linked = verified(bounded(stars, found), texts)
    edges = materialise(linked.union(copies), "links")
    labels = components(edges)
    late = verified(across(members.select("h", "id"), found, labels), texts)
    final = components(edges.union(late))
    return whole.select(F.col("id").alias(doc_id), "n_shingles").join(final.withColumnRenamed("id", doc_id), doc_id, "left").select(
        doc_id, "n_shingles", F.coalesce("component", doc_id).alias("component_id")
    )
