"""Shards by jump consistent hashing: no table of a ring, few rows move when it grows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.operators.skew import number_rows

# Fixed value: the multiplier of the generator in the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. With one more shard, keys move only into the new one."""
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    at = np.zeros(len(state), dtype=np.float64)
    while len(moving):
        shard[moving] = at
        state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1)
        at = np.floor((shard[moving] + 1) * step)
        stays = at < shards
        moving, at = moving[stays], at[stays]
    return shard


def shard_rows(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """Add ``out``, the shard of a row by ``key`` alone, and ``out`` of one more shard.

    The second is ``grown_`` + ``out``. A null key is a key like any other. Columns
    of these names are replaced. Map-only.
    """
    grown = f"grown_{out}"
    keyed = df.drop(out, grown, "_key").withColumn("_key", F.xxhash64(key))
    schema = keyed.drop("_key").schema.add(out, "integer").add(grown, "integer")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy().view(np.uint64)
            found = [pa.array(jump(keys, n), type=pa.int32()) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=schema.names)

    return keyed.mapInArrow(place, schema)


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Every document with its shard, size, text checksum and place in the shard.

    Law ``key``: ``doc_id`` and the number of shards decide. ``slot`` numbers a
    shard's rows from 0 by ascending ``doc_id`` (null first, repeated ids by size
    and checksum). Texts are not shuffled, only these few numbers are.
    Null texts have size 1 and the checksum of the empty text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = shard_rows(rows, "doc_id", shards)
    numbered = number_rows(placed, ["shard", "doc_id", "size", "text_crc32"])
    # One row per shard.
    first = numbered.groupBy("shard").agg(F.min("idx").alias("_first"))
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("idx") - F.col("_first")).alias("slot"),
        "grown_shard",
    )
