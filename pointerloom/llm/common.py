"""Small helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointerloom.operators.skew import shared_folder

MEMO_LIMIT = 500_000
#: Rows of a batch that are turned into Python objects at a time.
PORTION_ROWS = 512


class Memo(dict):
    """What a function gives for a key, kept for a bounded number of keys."""

    def __init__(self, function, limit: int = MEMO_LIMIT):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


_kept: dict = {}


def kept(key, make):
    """What a worker process holds from task to task: one thing, the last it was asked for.

    A worker that goes on to another operator gives up what it held for the one before.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give up what the worker process held for another operator."""
    _kept.clear()


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8, null as the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def portions(
    batches: Iterator[pa.RecordBatch], rows: int = PORTION_ROWS
) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows, so that copies of long texts stay few."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
    pa.default_memory_pool().release_unused()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, divisor: int):
    """crc32 of an id as text modulo ``divisor``: how labelled rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], rows: int
) -> DataFrame:
    """``doc_id, label, text`` of at most ``rows`` labelled documents outside a fold.

    ``fold`` is (divisor, remainder held out). The choice is by a hash of the id,
    so it is the same in every run. Only this table of ids and labels, which
    ``rows`` bounds, is broadcast; texts stay where they are scanned.
    """
    divisor, out = fold
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(remainder("doc_id", divisor) != out)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.col("_label").alias("label"), "text")
    )
