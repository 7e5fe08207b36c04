"""From raw documents to packed sequences: the stages of a training-data pipeline, each on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``.
``run`` writes what a stage returns as Parquet to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.llm import jaccard, langid, packing, quality, repeats
from ferryline.operators.ordinal import with_ordinal
from ferryline.session import materialise

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAST_LANGUAGE_SCORE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and short texts go, repeated rows are judged alike."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with a score of ``LEAST_LANGUAGE_SCORE`` or more and that look like it.

    A text looks like its language if its log likelihood by character reaches the floor that the training texts told to be in that
    language set (``langid.rate_floors``), so a text in a language that was not learned, or none at all, goes. Where
    no row has a label there is nothing to learn from, and documents are rejected only for having no letter. Null and
    empty texts go; texts of any length are scored whole; repeated rows are judged alike.
    """
    pred = _free(docs, "pred")
    score, rate = _free(docs, "score"), _free(docs, "rate")
    learned = docs.filter(~langid.held_out(F.col("doc_id")))
    model = langid.fit(learned, langid.Pieces.load(BYTE_PIECES))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = materialise(langid.predict(docs, model, pred=pred, score=score, rate=rate), "told")
    floors = langid.rate_floors(told.filter(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()), pred, rate)
    unlike = F.lit(False)
    for lang, floor in floors.items():
        unlike = unlike | ((F.col(pred) == lang) & (F.col(rate) < floor))
    return told.filter((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE) & ~unlike).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates; rows without an id are in no group and stay.

    Rows are told apart by id and text: of rows alike in both one stays, and rows that share an id but not a text are
    documents of their own. A text without words is like no other.
    """
    named = docs.filter("doc_id is not null")
    counts = named.agg(F.count("*").alias("rows")).head()["rows"], named.select("doc_id").distinct().count()
    if counts[0] == counts[1]:
        groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
        gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    place, by_text = _free(docs, "place"), _free(docs, "by_text")
    known = named.withColumn(by_text, F.xxhash64("text"))
    places = with_ordinal(materialise(known.select("doc_id", by_text).distinct(), "rows"), ["doc_id", by_text], name=place)
    placed = materialise(known.join(places, ["doc_id", by_text]).select(place, *docs.columns), "placed")
    groups = jaccard.near_duplicates(placed.select(place, "text"), doc_id=place)
    gone = groups.filter(F.col("component_id") != F.col(place)).select(place).distinct()
    kept = placed.join(gone, place, "left_anti").dropDuplicates([place])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; characters that are covered in part stay. Null texts stay null.

    Empty texts stay empty, of rows that share id and text one keeps its text, and columns of any name are given back.
    """
    empty = _free(docs, "was_null")
    # Columns named like those that the operator adds go under other names meanwhile.
    names = {c: c for c in docs.columns}
    taken = docs.withColumn(empty, F.col("text").isNull())
    for added in ("n_bytes", "removed", "kept"):
        if added in names:
            names[added] = _free(taken, f"_{added}")
            taken = taken.withColumnRenamed(added, names[added])
    cut = repeats.cut_repeats(taken, whole_characters=True)
    text = F.when(~F.col(empty), F.decode("kept", "UTF-8"))
    again = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        again = again.withColumn("n_chars", F.when(~F.col(empty), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return again.select(*(F.col(names[c]).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset; a null or empty text is one piece with the end alone."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

# No stage but the first can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
