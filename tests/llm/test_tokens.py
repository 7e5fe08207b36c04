"""BPE, packing and language model against brute force."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferryline.llm import bpe, lm, packing, words
from tests.llm.conftest import ODD_ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def want_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode(spark, odd, tokenizer):
    pieces = bpe.pieces(spark, PATH)
    rows = bpe.encode(odd, PATH, vocabulary=pieces).collect()
    got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded) for r in rows)
    want = []
    for doc_id, text, *_ in ODD_ROWS:
        ids = want_ids(tokenizer, text)
        want.append((doc_id or -1, ids, len(ids), tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    apart = bpe.decode(bpe.encode(odd, PATH), pieces).select("decoded").collect()
    assert sorted(r.decoded for r in apart) == sorted(w[3] for w in want)


def test_encode_nothing(spark, empty):
    assert bpe.encode(empty, PATH, vocabulary=bpe.pieces(spark, PATH)).count() == 0


def test_decode_passes_over_unknown_ids(spark):
    tokens = spark.createDataFrame([(1, bytearray(np.array([0, 7, 1], "<u4").tobytes()))], "doc_id long, ids binary")
    vocabulary = spark.createDataFrame([(0, "a"), (1, "b")], "id int, piece string")
    assert bpe.decode(tokens, vocabulary).head().decoded == "a b"


def test_a_table_that_changes_between_reads_is_refused(spark):
    from ferryline.llm import words

    one = spark.createDataFrame([(1, "a b", False)], "id long, text string, mark boolean").coalesce(1)
    other = spark.createDataFrame([(1, "a c", False)], "id long, text string, mark boolean").coalesce(1)
    found = words.answers(words.block_words(one, 4), lambda rows: [b""] * rows.num_rows)
    with pytest.raises(Exception, match="differ"):
        words.meet(found, words.block_codes(other, 4), lambda *_: None, "x long").collect()


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(odd, tokenizer, capacity):
    rows = packing.pack(odd, PATH, capacity=capacity).collect()
    texts = Counter((d, tuple(want_ids(tokenizer, t) + [0])) for d, t, *_ in ODD_ROWS)
    pieces = Counter()
    for (doc_id, ids), n in texts.items():
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            pieces[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_nothing(empty):
    assert packing.pack(empty, PATH).count() == 0


def test_plan_finds_exact_complements():
    slots = packing.plan({1500: 3, 548: 1, 300: 1, 248: 1, 200: 1, 148: 1}, 2048)
    assert max(s.base + s.count for s in slots) == 3
    used = Counter()
    for s in slots:
        used[s.length] += s.each * s.count
    assert used == {1500: 3, 548: 1, 300: 1, 248: 1, 200: 1, 148: 1}


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    random = np.random.default_rng(seed)
    lengths = random.integers(1, 65, 500)
    slots = packing.plan(dict(Counter(lengths.tolist())), 64)
    filled, ranks = Counter(), Counter()
    for s in slots:
        ranks[s.length] += s.each * s.count
        for k in range(s.count):
            filled[s.base + k] += s.length * s.each
    assert ranks == Counter(lengths.tolist()) and max(filled.values()) <= 64
    least = max(math.ceil(lengths.sum() / 64), (lengths > 32).sum())
    assert len(filled) <= least * 1.05 + 1


def test_plan_of_nothing():
    assert packing.plan({}) == []


def test_language_model(odd):
    got = sorted(((r.doc_id or -1, r) for r in lm.score_documents(odd).collect()), key=lambda x: x[0])
    rows = sorted(((d or -1, d, (t or "").encode().lower().split() + [None]) for d, t, *_ in ODD_ROWS), key=lambda x: x[0])
    learned = [d is not None and zlib.crc32(str(d).encode()) % 5 != 1 for _, d, _ in rows]
    counts = Counter(w for (_, _, words), use in zip(rows, learned) if use for w in words)
    total, types = sum(counts.values()), len(counts)
    for (key, row), (want_key, _, words), use in zip(got, rows, learned, strict=True):
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in words)
        assert key == want_key and row.held_out == (not use) and row.n_tokens == len(words)
        assert row.n_known == sum(counts[w] > 0 for w in words) and row.train_tokens == total
        assert row.base_score == pytest.approx(base) and math.isfinite(row.score) and row.score < 0


def test_language_model_of_nothing(empty):
    assert lm.score_documents(empty).count() == 0


def test_language_model_is_a_distribution():
    counts = lm.Counts(100, 12, 10, [b"a", b"b", b"c"], [40, 20, 10], [5] * lm.LOOKS, [1] * lm.LOOKS)
    layout = lm.Layout.of(counts)
    network = lm.Network(layout)
    states = np.ones((1, lm.HIDDEN + 1), np.float32)
    states[0, :-1] = np.linspace(-1, 1, lm.HIDDEN)
    chances = [np.exp(network.log_chance(states, np.array([c]))[0][0]) for c in range(layout.start)]
    assert sum(chances) == pytest.approx(1, abs=1e-4)


def test_gradient_of_a_window():
    layout = lm.Layout.of(lm.Counts(100, 12, 10, [b"a", b"b", b"c"], [40, 20, 10], [5] * lm.LOOKS, [1] * lm.LOOKS))
    inputs, targets = np.array([[layout.start, 1], [1, 2], [2, layout.start]]), np.array([[1, 2], [2, 0], [5, 3]])
    fresh, live = inputs == layout.start, np.ones((3, 2), bool)
    network, state = lm.Network(layout), np.full((2, lm.HIDDEN), 0.1, np.float32)
    grown, _ = network.slopes(inputs, fresh, targets, state, live)

    def mean_chance(flat):
        other = lm.Network(layout, flat)
        states, _, _ = other.run(inputs, fresh, state, keep=False)
        return float(other.log_chance(states[live], targets[live])[0].mean())

    for at in np.argsort(-np.abs(grown))[:12]:
        step = np.zeros_like(network.flat)
        step[at] = 1e-2
        slope = (mean_chance(network.flat + step) - mean_chance(network.flat - step)) / 2e-2
        assert slope == pytest.approx(float(grown[at]), rel=0.05, abs=2e-4)


def test_members_grow_with_the_distinct_words():
    def layout(distinct):
        listed, groups = lm.vocabulary_size(distinct), lm.groups_per_look(distinct)
        places = lm.LOOKS * groups
        words = [b"w%d" % i for i in range(listed)]
        return lm.Layout.of(lm.Counts(10 * distinct, distinct, 9, words, [9] * listed, [5] * places, [2] * places))

    small, large = layout(250_000), layout(4_000_000)
    assert len(large.words) == 16_000 and len(small.words) == 4_000
    assert len(large.log_group) > 3.5 * len(small.log_group)
    assert len(large.log_class) == pytest.approx(math.sqrt(large.start), rel=0.1)
    assert np.bincount(large.class_of).max() < 5 * len(large.log_class)
    # Words outside the vocabulary are told apart by context: unlike endings have members of their own.
    rare = {large.code(w, 2) for w in (b"walking", b"walked", b"nation", b"houses")}
    assert len(rare) == 4 and all(large.listed <= c < large.start for c in rare)
    assert large.code(b"walking", 0) == large.code(b"houses", 1) not in rare
    chance = np.exp(large.log_class[large.class_of] + large.log_member)
    assert chance.sum() == pytest.approx(1)


def test_lanes_follow_the_tokens_with_one_long_text():
    random = np.random.default_rng(3)
    lengths = [200_000, *random.integers(1, 900, 3000).tolist()]
    streams = [random.integers(1, 2000, n).astype(np.uint32) for n in lengths]
    tracemalloc.start()
    lanes = lm.Lanes.of(streams, 2000)
    seen = [[] for _ in streams]
    for inputs, targets, fresh, document in lanes.windows():
        for i in np.unique(document[document >= 0]):
            steps, columns = np.nonzero((document == i).T)[::-1]
            own = targets[steps, columns]
            assert len(set(columns.tolist())) == 1 and fresh[steps, columns].sum() == (not seen[i])
            assert (inputs[steps, columns] == [seen[i][-1] if seen[i] else 2000, *own[:-1]]).all()
            seen[i] += own.tolist()
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(s == want.tolist() for s, want in zip(seen, streams, strict=True))
    assert held < 100 * sum(lengths)


def test_model_beats_word_counts_on_held_out_text(spark, sf):
    scored = lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out")
    base, score = scored.agg(F.sum("base_score"), F.sum("score")).head()
    assert score > base


def test_tasks_of_training_follow_the_tokens():
    """Not the files' splits: 22 of them held 27 M tokens of a round."""
    assert lm.training_tasks(27_000_000, 6) == 6
    assert lm.training_tasks(100 * lm.GROUP_TOKENS + 1, 6) == 101
    assert lm.training_tasks(0, 0) == 1


def test_a_round_has_few_tasks(spark, monkeypatch, tmp_path):
    """A table of many small files is learned from in as many tasks as its tokens ask for."""
    streams = [np.array([1, 2, 0], np.uint32)] * 4
    row = ([True] * 4, [3] * 4, bytes(lm.join_arrays([np.concatenate(streams)])))
    rows = [(block, *row) for block in range(96)]
    spark.createDataFrame(rows, "block long, marks array<boolean>, n_tokens array<long>, codes binary").repartition(96).write.parquet(f"{tmp_path}/coded")
    layout = lm.Layout.of(lm.Counts(100, 12, 10, [b"a", b"b", b"c"], [40, 20, 10], [5] * lm.LOOKS, [1] * lm.LOOKS))
    monkeypatch.setattr(lm, "training_tasks", lambda tokens, cores: 2)
    seen = []
    kind = type(spark.range(0))
    original = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (seen.append(self.rdd.getNumPartitions()), original(self, *a, **b))[1])
    lm.fit(spark.read.parquet(f"{tmp_path}/coded"), layout, 1152)
    assert seen == [2] * lm.ROUNDS


def test_texts_are_split_into_words_once(odd, monkeypatch):
    """One scan gives the words and the codes; each scan of its own cost a tenth of the whole."""
    kind, seen = type(odd), []
    original = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (seen.append(self.columns), original(self, *a, **b))[1])
    lm.score_documents(odd).collect()
    assert sum("text" in columns for columns in seen) == 1


def test_words_and_codes_of_one_scan(odd):
    rows = odd.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") < 12).alias("mark"))
    for got, expected in zip(words.words_and_codes(rows, 7, True), (words.block_words(rows, 7, True), words.block_codes(rows, 7, True)), strict=True):
        assert got.schema.simpleString() == expected.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


def test_clipped_scores_count_alike():
    """Scores are held down only where one could be too high; elsewhere that changes nothing."""
    random = np.random.default_rng(3)
    states, weights = random.uniform(-1, 1, (50, lm.HIDDEN + 1)).astype(np.float32), random.normal(0, 1, (lm.HIDDEN + 1, 9)).astype(np.float32)
    picked, found = random.integers(0, 9, 50), []
    for clip in (False, True):
        out, slope, grad = np.zeros(50, np.float32), np.zeros_like(weights), np.zeros((50, lm.HIDDEN), np.float32)
        lm._softmax(states, weights, picked, out, slope, grad, 50, clip)
        found.append(np.concatenate([out, slope.ravel(), grad.ravel()]))
    assert (found[0] == found[1]).all()
