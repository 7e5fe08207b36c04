"""Stages of the pipeline on planted rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SHARED, prose

ITALIAN = (
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita e quanto a dir qual era cosa dura "
    "questa selva selvaggia e aspra e forte che nel pensier rinova la paura tanto amara che poco piu morte ma per trattar del ben che vi trovai"
)
RUSSIAN = "Все счастливые семьи похожи друг на друга каждая несчастливая семья несчастлива по своему все смешалось в доме "


def noise(seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(120))


@pytest.fixture
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_texts_of_no_learned_language_go_and_others_stay(spark, documents):
    planted = [(-1, ITALIAN * 2), (-2, RUSSIAN * 3), *((-3 - i, noise(i)) for i in range(5))]
    rows = spark.createDataFrame(planted, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")})
    good = corpus_pipeline.quality_rules(spark, documents, "")
    table = corpus_pipeline.materialise(good.unionByName(rows.withColumn("n_chars", F.length("text").cast("long"))), "planted")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, table, "").collect()}
    clean = {r.doc_id for r in good.select("doc_id").collect()}
    assert not kept & {d for d, _ in planted}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_rows_that_share_an_id_are_documents_of_their_own(spark, tmp_path):
    rows = [(1, prose(1, 90)), (1, prose(2, 90)), (1, prose(1, 90)), (2, prose(2, 90) + " tail"), (3, prose(3, 90)), (None, prose(3, 90)), (4, None), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("mine")).repartition(2).write.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert kept.columns == ["doc_id", "text", "place"]
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(1, prose(1, 90)), (1, prose(2, 90)), (3, prose(3, 90)), (None, prose(3, 90)), (4, None), (5, "")], key=str)


def test_columns_of_any_name_come_through(spark, tmp_path):
    names = ["kept", "n_bytes", "removed", "_kept", "was_null", "pred", "rate", "score", "bucket", "block"]
    rows = spark.createDataFrame([(i, SHARED + prose(i, 60)) for i in range(4)] + [(9, None)], "doc_id long, text string")
    rows = rows.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.length("text").cast("long")})
    rows = rows.withColumns({n: F.concat(F.lit(f"{n}-"), "doc_id") for n in names})
    rows.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes
        for row in out.collect():
            assert all(row[n] == f"{n}-{row.doc_id}" for n in names)


def test_run_equals_the_stages_by_hand(spark, sf, tmp_path):
    """Near duplicates and repeats of the run against brute force over what the first two stages keep."""
    from ferryline.llm.jaccard import _WordHash, shingles
    from tests.llm.test_duplicates import cut_by_hand

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.quality_rules(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")
    second = corpus_pipeline.language_id(spark, corpus_pipeline.materialise(first, "first"), "")
    rows = sorted((r.doc_id, r.text) for r in second.select("doc_id", "text").collect())
    hashes = _WordHash()
    sets = {d: set(shingles(t.encode(), hashes).tolist()) for d, t in rows}
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    cut = dict(cut_by_hand([(d, t) for d, t in rows if root(d) == d]))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(cut)
    kept = corpus_pipeline.suffix_array_dedup(spark, corpus_pipeline.materialise(corpus_pipeline.near_duplicates(spark, corpus_pipeline.materialise(second, "second"), ""), "third"), "")
    for row in kept.collect():
        # Characters covered in part stay, so a text may be a little longer than its bytes by hand.
        assert len(cut[row.doc_id]) <= len(row.text.encode()) <= len(cut[row.doc_id]) + 8
