"""Repeated passages and near duplicates against brute force."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferryline.llm import jaccard, repeats
from ferryline.llm.components import components
from tests.llm.conftest import ODD_ROWS, SHARED, prose


def cut_by_hand(rows):
    """(id, bytes kept) of each row, rows in the order of their ids."""
    seen, out = set(), []
    for doc_id, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for at in range(len(body) - repeats.LENGTH + 1):
            string = body[at : at + repeats.LENGTH]
            if string in seen:
                gone[at : at + repeats.LENGTH] = True
            seen.add(string)
        out.append((doc_id, np.frombuffer(body, np.uint8)[~gone].tobytes()))
    return out


def kept(frame):
    rows = frame.select("doc_id", "kept", "n_bytes", "removed").collect()
    for row in rows:
        assert row.n_bytes - sum(s.end - s.start for s in row.removed) == len(row.kept)
    return sorted((r.doc_id, bytes(r.kept)) for r in rows)


def test_repeats(spark, odd):
    known = odd.filter("doc_id is not null and doc_id <> 17")
    rows = sorted((d, t) for d, t, *_ in ODD_ROWS if d not in (None, 17))
    assert kept(repeats.cut_repeats(known)) == sorted(cut_by_hand(rows))
    assert repeats.cut_repeats(odd).columns == ["doc_id", "lang", "source", "score", "n_chars", "n_bytes", "removed", "kept"]


def test_repeats_of_rows_with_one_id_and_without(odd):
    rows = repeats.cut_repeats(odd).filter("doc_id is null or doc_id = 17").collect()
    assert sorted(len(r.kept) > 0 for r in rows if r.doc_id == 17) == [False, True]
    assert [len(r.kept) > 0 for r in rows if r.doc_id is None] == [True]


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_in_many_surroundings(spark, tmp_path, monkeypatch, hot):
    """A common line in ever other surroundings, with and without the path for crowded anchors."""
    if hot:
        monkeypatch.setattr(repeats, "HOT_IN_BLOCK", 2)
        monkeypatch.setattr(repeats, "HOT", 4)
    line = SHARED[:150]
    rows = [(i, prose(i + 20, 12 + i) + line + prose(i + 60, 9) + ("z" * (i * 40))) for i in range(14)]
    rows += [(100, ""), (101, "abc" * 90), (102, "é" * 120 + line)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    assert kept(repeats.cut_repeats(spark.read.parquet(str(tmp_path / "docs")))) == sorted(cut_by_hand(rows))


def test_whole_characters_stay(spark, tmp_path):
    rows = [(1, "x" * 50 + "é" * 60), (2, "y" * 9 + "é" * 55 + "è" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for row in repeats.cut_repeats(docs, whole_characters=True).collect():
        bytes(row.kept).decode()


def test_whole_characters_take_little_memory():
    """Characters are told by no array that is wider than the text: 16 bytes and more for one of text ended the pipeline."""
    text = np.frombuffer(("aé日𝄞" * 100_000).encode(), np.uint8)
    covered = np.arange(len(text)) // 703 % 3 == 1
    tracemalloc.start()
    found = repeats._whole_characters(covered, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(text)
    begins = (text & 0xC0) != 0x80
    assert (found == np.minimum.reduceat(covered, np.flatnonzero(begins))[np.cumsum(begins) - 1]).all()
    assert (found != covered).any()


def test_repeats_of_nothing(empty):
    assert repeats.cut_repeats(empty).count() == 0


def test_long_text_is_cut_in_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    text = (prose(1, 150) + SHARED + prose(2, 90)).encode()
    body = np.frombuffer(text, np.uint8)
    found = repeats.find_anchors(body, np.array([0]), np.array([len(body)]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.first, found.last)])
    assert sorted(covered) == list(range(len(body) - repeats.LENGTH + 1))


@pytest.mark.parametrize("seed", range(4))
def test_prefix_groups(seed):
    random = np.random.default_rng(seed)
    symbols = np.append(random.integers(1, 4, 400), 0)
    symbols[200:260] = symbols[20:80]
    order = repeats.suffix_order(symbols, 9)
    group = repeats.long_prefix_groups(symbols, order, 9)
    texts = [tuple(symbols[s : s + 9]) for s in order]
    same = [a == b and len(a) == 9 for a, b in zip(texts, texts[1:])]
    assert [a == b for a, b in zip(group, group[1:])] == same


def by_hand(rows):
    """{id: (set size, smallest reachable id)}."""
    sets, parent = {}, {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        wide = min(len(words), 5)
        sets.setdefault(doc_id, []).append({tuple(words[k : k + wide]) for k in range(len(words) - wide + 1)} if words else set())
        parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                        low, high = sorted((root(a), root(b)))
                        parent[high] = low
    return Counter((d, len(s), root(d)) for d, own in sets.items() for s in own)


def test_near_duplicates(odd):
    rows = jaccard.near_duplicates(odd).collect()
    got = Counter(tuple(r) for r in rows if r.doc_id is not None)
    assert got == by_hand([(d, t) for d, t, *_ in ODD_ROWS if d is not None])
    assert [(r.n_shingles > 0, r.component_id) for r in rows if r.doc_id is None] == [(True, None)]


def test_near_duplicates_of_nothing(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_chains_and_tiles(spark, tmp_path, monkeypatch):
    """Links in a chain, documents that share a passage only, and blocks dealt out as tiles."""
    monkeypatch.setattr(jaccard, "TILE", 3)
    base = prose(7, 80).split()
    rows = [(i, " ".join(base[: 80 - 4 * i] + prose(300 + i, 4 * i).split())) for i in range(8)]
    rows += [(50 + i, SHARED + " " + prose(400 + i, 40 + 5 * i)) for i in range(12)]
    rows += [(80 + i, prose(500, 30).upper() + " tail" * (i % 2)) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    got = Counter(tuple(r) for r in jaccard.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).collect())
    assert got == by_hand(rows)


@pytest.mark.parametrize("seed", range(3))
def test_tree_gives_every_point_that_could_share_enough(seed):
    random = np.random.default_rng(seed)
    points = random.poisson(1.2, (150, 16))
    points[75:] = np.maximum(points[:75] + random.integers(-1, 2, (75, 16)), 0)
    sizes = points.sum(axis=1)
    tree = jaccard.RTree(sizes, points)
    for k in range(150):
        ratio = (sizes * 100 >= 75 * sizes[k]) & (75 * sizes <= 100 * sizes[k])
        want = ratio & (np.minimum(points, points[k]).sum(axis=1) >= jaccard.least_overlap(sizes, sizes[k]))
        assert set(np.flatnonzero(want)) == set(tree.candidates(int(sizes[k]), points[k]).tolist())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (9, 8), (8, 7), (5, 5), (20, 3), (7, 30)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7, 30: 7}
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_points_tell_texts_that_share_four_fifths_apart():
    """A family whose members share 480 of 600 shingles (two thirds of their union) gives no pair; a near copy does."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**64, 600, np.uint64, endpoint=False)
    family = [np.unique(np.concatenate([base[:480], draw.integers(0, 2**64, 120, np.uint64, endpoint=False)])) for _ in range(40)]
    family.append(np.unique(np.append(family[0][:560], draw.integers(0, 2**64, 40, np.uint64, endpoint=False))))
    rows = range(len(family))
    table = pa.table({
        "id": list(rows), "tile": [0] * len(family), "n_shingles": [len(s) for s in family], "component": list(rows),
        "counts": [jaccard._packed(jaccard.point(s)) for s in family],
    })
    assert jaccard._join_block(jaccard._Members.of(table), 0, len(family), (0, 0)) == {(0, 40)}
