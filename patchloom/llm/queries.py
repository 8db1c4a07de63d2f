"""Registered queries of the operators, each thin over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchloom.llm import common as C
from patchloom.llm import classifier, clusters, dialogs, html_text, jaccard, mixing, packing, quality, repeats, search, secrets, suffix_tree, urls

Query = Callable[[SparkSession, str], DataFrame]


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(C.read(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(C.read(spark, sf_dir, "pages"))


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(C.read(spark, sf_dir, "embeddings"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(C.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(C.read(spark, sf_dir, "pages"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(C.read(spark, sf_dir, "labels"))
    return mixing.mix(C.read(spark, sf_dir, "documents"), weights).select(
        "doc_id", "size", "source_size", "target", "taken")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.read(spark, sf_dir, "documents"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(C.read(spark, sf_dir, "documents"))


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(C.read(spark, sf_dir, "documents"))


def suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(C.read(spark, sf_dir, "documents"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogs.digests(dialogs.repair(dialogs.damaged(C.read(spark, sf_dir, "conversations"))))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(C.read(spark, sf_dir, "embeddings")).drop("checks")


QUERIES: dict[str, Query] = {
    "op1_suffix_array_dedup": suffix_array_dedup,
    "op2_html_extraction": html_extraction,
    "op3_best_fit_packing": best_fit_packing,
    "op4_exact_topk": exact_topk,
    "op5_quality_rules": quality_rules,
    "op6_url_filters": url_filters,
    "op7_quality_classifier": quality_classifier,
    "op8_source_mix": source_mix,
    "op9_ngram_jaccard": ngram_jaccard,
    "op10_secret_scans": secret_scans,
    "op11_suffix_tree_scores": suffix_tree_scores,
    "op12_conversation_repair": conversation_repair,
    "op13_centroid_clusters": centroid_clusters,
}
