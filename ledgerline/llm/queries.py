"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    alignment,
    byte_bpe,
    checks,
    embeddings,
    language,
    packing,
    preference,
    prefix_trie,
    quality,
    secrets,
    simhash,
    token_counts,
    top_inner,
    url_filter,
)
from ledgerline.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), 1024)


@query("op6_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=1024)


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), tau=3, words_per_shingle=3)


@query("op8_quality_rules", checks.QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), "v1").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op9_byte_bpe")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op10_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.counted(secrets.findings(docs, secrets.trained(docs)))


@query("op3_preference_format", checks.PREFERENCE)
def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = preference.preference_pairs(turns, preference.with_other_answers(turns), pair_col="conv_id")
    spans = lambda mask: F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        F.col("n_shared").cast("long").alias("n_shared"),
        "prompt",
        "chosen",
        "rejected",
        spans("chosen_mask").alias("chosen_mask"),
        spans("rejected_mask").alias("rejected_mask"),
    )


@query("op4_url_filter", checks.URLS)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op5_embedding_near_dedup", checks.EMBEDDINGS)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", checks.PREFIX_TRIE)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_digests(table(spark, sf_dir, "conversations"))
    trie = prefix_trie.prefix_trie(*prefix_trie.with_shared_starts(turns))
    nodes = prefix_trie.with_parent(trie.nodes).join(prefix_trie.end_digests(trie.ends), prefix_trie.NODE, "left")
    return nodes.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


@query("op13_top_inner", checks.TOP_INNER)
def top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner.top_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
