"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointerloom.llm import fingerprints, quality, toxicity
from pointerloom.llm.common import remainder, scratch
from pointerloom.llm.filter_audit import filter_audit
from pointerloom.llm.html_text import extract_text
from pointerloom.llm.ngram_join import ngram_components
from pointerloom.llm.oracles import ORACLES
from pointerloom.llm.packing import best_fit_pack
from pointerloom.llm.pieces import piece_tokens
from pointerloom.llm.prefix_trie import conversation_trie
from pointerloom.llm.sharding import shard_documents
from pointerloom.llm.token_store import read_tokens, write_tokens
from pointerloom.llm.url_templates import judge_urls
from pointerloom.llm.vector_forest import near_vectors


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def judged(scores: DataFrame, fold: tuple[int, int], threshold: float) -> DataFrame:
    divisor, out = fold
    return scores.select(
        "doc_id",
        (remainder("doc_id", divisor) == out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    prints = fingerprints.edited_fingerprints(table(spark, folder, "documents"))
    text = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return prints.withColumns(text)


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit_quality(docs, labels)
    return judged(quality.score_quality(docs, model), quality.HELD_OUT, 0.7)


def op3_vector_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op4_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(table(spark, folder, "documents"), path, tokenizer, end_id=2)
    return read_tokens(spark, path, with_ids=False)


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return best_fit_pack(table(spark, folder, "documents"), tokenizer, end_id=1)


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_tokens(table(spark, folder, "documents"), model, with_ids=False)


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"))


def op9_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"), shards=8)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    return judged(toxicity.score_toxicity(docs, model), toxicity.HELD_OUT, 0.5)


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op11_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return audit.drop("filter")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_vector_forest": op3_vector_forest,
    "op4_token_store": op4_token_store,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_html_text": op6_html_text,
    "op7_pieces": op7_pieces,
    "op8_ngram_join": op8_ngram_join,
    "op9_jump_sharding": op9_jump_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_url_templates": op11_url_templates,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}
__all__ = ["ORACLES", "QUERIES"]
