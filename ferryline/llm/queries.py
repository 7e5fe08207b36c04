"""One query of each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.llm import bpe, jaccard, langid, lexical_search, lm, packing, prefix_trie, quality, repeats, secret_scan, sharding, token_counts, topk
from ferryline.session import shared_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

SHORT_CHARS = 200

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_exclamations", "n_stop_words", "n_lines", "broken_rules",
    )


@register
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = bpe.encode(docs, WORD_BPE, vocabulary=bpe.pieces(spark, WORD_BPE))
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@register
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


@register
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load, a revision of one source's tokenizer and the removal of short documents, each handed in twice."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, shared_path(spark, "token-counts"))
    moved = F.coalesce(F.col("source") == "src0", F.lit(False))
    short = F.coalesce(F.length("text"), F.lit(0)) < SHORT_CHARS
    old, new = token_counts.deleted, token_counts.inserted
    revision = token_counts.revised(docs.filter(moved), "words/1", docs.filter(moved), "words/2")
    removal = old(docs.filter(short & ~moved), "words/1").unionByName(old(docs.filter(short & moved), "words/2"))
    for name, changes in (("1-load", new(docs, "words/1")), ("2-revision", revision), ("3-removal", removal)):
        rollup.commit(name, changes)
        rollup.commit(name, changes)
    return rollup.totals()


@register
def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "cell", "source_cell", "lang_cell",
    )


@register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))), langid.Pieces.load(BYTE_PIECES))
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register
def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@register
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    n_spans = F.size("removed").cast("long")
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register
def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@register
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]
    counts = [F.size(secret_scan.of_kinds(F.col("spans"), [kind])).cast("long").alias(f"n_{kind}") for kind in kinds]
    base = secret_scan.listed(secret_scan.of_kinds(F.col("spans"), kinds))
    return found.select(
        "doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans")
    )


@register
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
