"""Quality rules, language, top-k, counts and shards, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferryline.llm import langid, positions, quality, sharding, token_counts, topk
from ferryline.llm.oracles import ORACLES
from ferryline.llm.queries import QUERIES
from tests.llm.conftest import ODD_ROWS, prose


def test_quality_against_sql(odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept broken_rules".split()
    want = db.execute(f"select {', '.join(names)} from ({ORACLES['op5_quality_rules']}) where doc_id <> 17").fetchall()
    got = quality.judge(odd.filter("doc_id <> 17")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_quality_rules_reject_and_keep(spark):
    good = prose(1, 200)
    rows = [(1, good), (2, " ".join(f"{w}&&&" for w in good.split())), (3, "the " * 100), (4, "short"), (5, None), (6, "Zq!! " * 3 + "Wx!! Yz!! " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine"))
    assert [tuple(r) for r in quality.keep_good(docs).collect()] == [(1, good, "mine")]
    assert "Python" not in quality.judge(docs)._jdf.queryExecution().executedPlan().toString()


def test_quality_of_nothing(empty):
    assert quality.judge(empty).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces([b"a", b"b", b"ab", b"ba", b"aba"])
    table = np.array([[0.3], [0.2], [0.25], [0.15], [0.1], [0]])

    def brute(text):
        if not text:
            return 1.0
        return sum(table[i, 0] * brute(text[len(p) :]) for i, p in enumerate(pieces.listed) if text.startswith(p))

    runs = [b"a", b"ab", b"ababa", b"bbab", b"abaab"]
    assert np.exp(langid.forward(pieces, table, runs)[:, 0]) == pytest.approx([brute(r) for r in runs])


def test_language_of_held_out_rows(spark, sf, pieces):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))), pieces)
    told = langid.predict(docs, model).filter(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in told]) >= 0.95 and all(0 <= r.score <= 1 for r in told)


def test_language_model_learns_from_every_row(spark):
    """Probabilities of pieces against expectation maximisation by hand, of two languages with thousands of rows."""
    listed = [b" ", b"a", b"b", b"ab", b"ba"]
    draw = random.Random(3)
    rows = [(i, " ".join("".join(draw.choice("aab" if lang == "x" else "abb") for _ in range(draw.randint(1, 5))) for _ in range(2)), lang) for i in range(3_500) for lang in "xy"]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Pieces(listed))
    assert model.languages == ["x", "y"]

    def cut(run):
        return [[]] if not run else [[k, *rest] for k, p in enumerate(listed) if run.startswith(p) for rest in cut(run[len(p) :])]

    for column, lang in enumerate("xy"):
        counts = Counter(b" " + word.encode() for _, text, own in rows if own == lang for word in text.split())
        chances = np.full(len(listed), 1 / len(listed))
        for _ in range(langid.ROUNDS):
            expected = np.zeros(len(listed))
            for run, n in counts.items():
                ways = [(np.prod(chances[way]), way) for way in cut(run)]
                for chance, way in ways:
                    np.add.at(expected, way, n * chance / sum(c for c, _ in ways))
            chances = (expected + langid._PRIOR) / (expected.sum() + langid._PRIOR * len(listed))
        assert model.table[:-1, column] == pytest.approx(chances, rel=1e-9)


def test_language_of_odd_rows(odd, empty, pieces):
    model = langid.fit(odd, pieces)
    assert model.languages == ["de", "en", "fr"]
    told = langid.predict(odd, model).collect()
    assert len(told) == len(ODD_ROWS) and "score" in told[0]
    for row in told:
        has_letter = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == "und") == (not has_letter) and (row.score > 0) == has_letter
    assert {r.lang_pred for r in told if r.doc_id in (11, 13)} == {"de"}
    nothing = langid.fit(empty, pieces)
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(empty, model).count() == 0


def top_by_hand(rows, k):
    """Best score of any pair of vectors for two ids."""
    vectors = {}
    for vec_id, values in rows:
        if vec_id is None or values is None or any(v is None or not math.isfinite(v) for v in values):
            continue
        vectors.setdefault(vec_id, []).append([math.floor(256 * v) for v in values])
    out = []
    for q in (v for v in vectors if v % 50 == 0):
        scores = []
        for c in vectors:
            if c != q:
                scores.append((-max(sum(a * b for a, b in zip(x, y)) for x in vectors[q] for y in vectors[c]), c))
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_A_CELL", 40)
    monkeypatch.setattr(topk, "QUERIES_A_CELL", 2)
    random = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in random.normal(size=6)]) for i in range(130)]
    rows += [(i, rows[7][1]) for i in range(200, 260)] + [(7, rows[7][1]), (50, rows[3][1]), (3, rows[90][1])]
    rows += [(300, None), (350, [1.0, None]), (None, [1.0]), (400, [float("nan")] * 6), (450, [float("inf")]), (500, []), (550, [0.5, 0.25])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows, 5)


def test_top_k_with_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_A_CELL", 20)
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=3).tolist()) for i in range(60)]
    rows += [(i, [2e6, 0.0, float(i)]) for i in (60, 61, 62)] + [(100, [3e5, 0.0, 1.0]), (150, [-2.5e9, 1.0, 0.5]), (151, [1e7, -3e9, 2.0]), (200, [0.0, 7.0e4 + 1 / 256, 0.0])]
    rows += [(63, [1e3, 0.0, 1e12]), (250, [0.5, 1e9, 1e-3])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = top_by_hand(rows, 5)
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got)) == want and {r.query_id for r in got} == {0, 50, 100, 150, 200, 250}


def test_a_score_beyond_64_bits_is_an_error(spark):
    for sign in (1.0, -1.0):
        vectors = spark.createDataFrame([(0, [1e15]), (1, [sign * 1e15])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()


def test_top_k_of_nothing_and_of_one(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(0, [1.0])]):
        assert topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).count() == 0


def test_deltas_and_repeated_commits(spark, odd, empty, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0 and rollup.batches() == []
    assert rollup.commit("a", token_counts.inserted(odd, "words/1"))
    first = sorted(map(str, rollup.totals().collect()))
    assert not rollup.commit("a", token_counts.inserted(odd, "words/1"))
    assert sorted(map(str, rollup.totals().collect())) == first
    want = Counter()
    for _, text, lang, source in ODD_ROWS:
        want[source, lang] += len((text or "").encode().split())
    assert {(r.source, r.lang): r.n_tokens for r in rollup.totals().collect()} == {k: n for k, n in want.items()}
    one = odd.filter("source = 'a'")
    assert rollup.commit("b", token_counts.revised(one, "words/1", one, "words/2"))
    assert {r.tokenizer for r in rollup.totals().filter("source = 'a'").collect()} == {"words/2"}
    assert rollup.commit("c", token_counts.deleted(one, "words/2")) and rollup.commit("d", token_counts.inserted(empty, "words/1"))
    assert rollup.totals().filter("source = 'a'").count() == 0 and rollup.batches() == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        rollup.commit("../x", token_counts.inserted(odd, "words/1"))


def test_totals_of_many_batches_before_and_after_compaction(spark, odd, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.compact() == 0
    plus, minus = token_counts.inserted(odd, "words/1"), token_counts.deleted(odd, "words/1")
    for n in range(6):
        rollup.commit(f"b{n}", minus if n == 4 else plus)
    want = {(r.source, r.lang): r.n_tokens * 4 for r in rollup.deltas(["b0"]).collect()}

    def totals():
        return {(r.source, r.lang): r.n_tokens for r in rollup.totals().collect()}

    assert totals() == want and rollup.deltas()._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert rollup.compact() == 6 and totals() == want and rollup.batches() == [f"b{n}" for n in range(6)]
    assert not rollup.commit("b3", plus) and rollup.commit("b7", plus) and rollup.compact() == 1
    assert totals() == {k: n // 4 * 5 for k, n in want.items()}
    # A run that died between its rename and its deletions: the batch lies in both places.
    sums = rollup.deltas().collect()
    spark.createDataFrame(sums, token_counts.DELTA_SCHEMA).write.parquet(f"{rollup.folder}/batch=b2")
    assert totals() == {k: n // 4 * 5 for k, n in want.items()} and rollup.compact() == 0
    assert rollup._named("batch=") == [] and len(rollup._bases()) == 1


def test_a_commit_that_dies_leaves_nothing_that_counts(spark, odd, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    bad = token_counts.inserted(odd, "words/1").withColumn("n_docs", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        rollup.commit("a", bad)
    assert rollup.batches() == [] and rollup.commit("a", token_counts.inserted(odd, "words/1"))


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = sharding.hilbert_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("shards", [3, 40])
def test_shards(odd, shards):
    rows = sharding.shard(odd, shards).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(ODD_ROWS) and max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    cells = [r.cell for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert cells == sorted(cells)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in ODD_ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_cells_follow_the_order_of_values(spark):
    rows = [(v,) for v in ["a"] * 50 + ["b", "c", "d"] + ["é"] * 20 + ["z", None]]
    table = spark.createDataFrame(rows, "source string")
    own = sharding.marks(table, "source", 3)
    cells = {r.source: r.cell for r in table.select("source", sharding.category(F.col("source"), own).alias("cell")).distinct().collect()}
    assert own == ["a"] * 4 + ["d", "é"] and cells == {None: 0, "a": 1, "b": 5, "c": 5, "d": 5, "z": 6, "é": 6}
    assert sharding.marks(table.limit(0), "source", 3) == []


def test_shards_can_be_skipped_by_least_and_greatest_value(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    placed = sharding.shard(docs, 40).select("doc_id", "size", "shard").join(docs.select("doc_id", "source", "lang"), "doc_id")
    for column, most in (("source", 0.4), ("lang", 0.6)):
        ranges = placed.groupBy("shard").agg(F.min(column).alias("low"), F.max(column).alias("high")).collect()
        values = [r[0] for r in placed.select(column).distinct().collect() if r[0] is not None]
        read = [sum(r.low is not None and r.low <= v <= r.high for r in ranges) / 40 for v in values]
        assert sum(read) / len(read) < most, (column, read)


def test_shards_of_nothing(empty):
    assert sharding.shard(empty, 40).count() == 0


def test_numbers_without_gaps_in_a_large_cell(spark, tmp_path):
    rows = spark.range(5000).withColumn("cell", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1))
    rows.write.parquet(str(tmp_path / "rows"))
    ranked = positions.numbered(spark.read.parquet(str(tmp_path / "rows")), "cell", ["id"], 5000).collect()
    for cell in (-1, 3):
        own = sorted(r["rank"] for r in ranked if r["cell"] == cell)
        assert own == list(range(len(own)))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.dtypes == before.dtypes and 0 < docs.count() <= before.count()
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns
        assert stage(spark, empty, "").count() == 0
    same = {3, 10, 13}
    left = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, "").collect()]
    assert same.isdisjoint(left) and Counter(left)[17] == 1 and None in left
    texts = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, odd, "").collect()}
    assert texts[4] is None and texts[5] == "" and texts[3] == "" and texts[1] == ODD_ROWS[0][1]


def test_every_query_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
