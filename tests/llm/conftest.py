"""Helpers of the tests of the training-data operators."""

import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Frames of documents from (doc_id, text) pairs, over a few partitions."""

    def documents(rows, parts=3, extra=False):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        return df.selectExpr("*", "1 as start", "'x' as score", "2 as shard") if extra else df

    return documents
