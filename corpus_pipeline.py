"""A corpus from raw documents: toxic and poor texts go, one of each group of near
copies stays, and what is left is packed into training sequences.

Each stage takes the session, the documents its predecessor kept and the folder of
the tables, and returns a frame that is written and read again before the next.
Rows are kept as they are, with all columns. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pointerloom.llm import quality, toxicity
from pointerloom.llm.common import written
from pointerloom.llm.ngram_join import one_of_each
from pointerloom.llm.packing import best_fit_pack

END_ID = 1


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, _labels(spark, sf_dir)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more."""
    return quality.keep_quality(docs, quality.fit_quality(docs, _labels(spark, sf_dir)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("best_fit_packing", pack),
]

# Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
