"""Token ids in files: each document one zstandard frame, one shared dictionary.

A store is a folder with two Parquet tables. ``dictionary`` has one row: the
dictionary trained on serialized id arrays, its hash, the id width and the end
id. ``blocks`` has rows of about ``BLOCK_BYTES``: the frames of consecutive
documents one after another, their ids, lengths and end places (the offset
index, which a column-pruned scan reads without the frames), and the hash of the
dictionary they need. A single document is read by its block and its place.

Empty table: a store without blocks. Null texts are empty. Repeated ids are
separate documents, in the order of their texts; null ids come first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointerloom.llm.common import texts_of
from pointerloom.llm.encoding import encoder

BLOCK_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
# The dictionary is fitted on the beginnings of this many documents, no more.
SAMPLE_DOCUMENTS = 500
SAMPLE_CHARACTERS = 8_192
LEVEL = 3

BLOCKS = (
    "slice int, block int, start long, n_tokens long, doc_ids array<long>, "
    "counts array<long>, ends array<long>, frames binary, dictionary_hash string"
)


def serialized(ids: bytes, end_id: int, dtype: np.dtype) -> bytes:
    return ids + np.array([end_id], dtype=dtype).tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the id arrays of a bounded sample; empty if there is too little."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    keys = [r.doc_id for r in chosen.where("doc_id is not null").collect()]
    rows = (
        docs.where(F.col("doc_id").isin(keys))
        .select("doc_id", F.substring("text", 1, SAMPLE_CHARACTERS).alias("text"))
        .orderBy("doc_id", "text")
        .limit(SAMPLE_DOCUMENTS)
        .collect()
    )
    code = encoder(tokenizer)
    samples = [
        serialized(ids, end_id, code.dtype)
        for ids in code.encode([(r.text or "").encode() for r in rows])
    ]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _block_rows(tokenizer: str, end_id: int, dictionary: bytes, digest: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        slice_, block, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, ends, frames, size = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            columns = [[slice_], [block], [start], [sum(counts)], [ids], [counts], [ends]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * 3
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds)]
            arrays += [pa.array([b"".join(frames)], type=pa.binary()), pa.array([digest])]
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for key, coded in zip(keys, code.encode(texts_of(batch, "text"))):
                data = serialized(coded, end_id, code.dtype)
                frames.append(compressor.compress(data))
                size += len(frames[-1])
                ids.append(key)
                counts.append(len(data) // code.dtype.itemsize)
                ends.append(size)
                if size >= BLOCK_BYTES:
                    yield row()
                    block, start = block + 1, start + sum(counts)
                    ids, counts, ends, frames, size = [], [], [], [], 0
        if ids:
            yield row()

    return pack


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode whole texts and write them as a store in ascending ``doc_id`` order.

    One range exchange of the texts; each slice is encoded and written as a
    stream, so memory holds a batch and a block whatever the slice is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    dictionary = train_dictionary(rows, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    width = encoder(tokenizer).dtype.itemsize
    spark.createDataFrame(
        [(digest, bytearray(dictionary), width, end_id)],
        "dictionary_hash string, dictionary binary, width int, end_id int",
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = ordered.mapInArrow(_block_rows(tokenizer, end_id, dictionary, digest), BLOCKS)
    # Frames are compressed already.
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


class Reader:
    """Opens frames of a store; refuses those of another dictionary."""

    def __init__(self, dictionary_hash: str, dictionary: bytes, width: int):
        if hashlib.sha256(dictionary).hexdigest() != dictionary_hash:
            raise ValueError("the dictionary of the store is damaged")
        self.hash, self.dtype = dictionary_hash, np.dtype(f"<u{width}")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdDecompressor(dict_data=shared)

    def ids(self, frames: bytes, low: int, high: int, dictionary_hash: str) -> np.ndarray:
        if dictionary_hash != self.hash:
            raise ValueError("frames need another dictionary")
        return np.frombuffer(self.zstd.decompress(frames[low:high]), dtype=self.dtype)


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.dictionary_hash, bytes(row.dictionary), row.width


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a store: ``doc_id, start, n_tokens, ids_crc32`` and their ``ids``.

    ``start`` counts the ids of all documents before. Only the sums of slices
    (one row per written partition) are put in order and broadcast.
    """
    given = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("slice").agg(F.sum("n_tokens").alias("_size"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifts = sizes.select("slice", (F.sum("_size").over(earlier) - F.col("_size")).alias("shift"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*given)
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["counts"], dtype=np.int64)
                starts = r["shift"] + r["start"] + np.cumsum(counts) - counts
                lows = [0, *r["ends"][:-1]]
                crcs, lists = [], []
                for low, high, count in zip(lows, r["ends"], r["counts"]):
                    ids = reader.ids(r["frames"], low, high, r["dictionary_hash"]).astype("<u4")
                    if len(ids) != count:
                        raise ValueError("a frame and the offset index differ")
                    crcs.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        lists.append(ids.astype(np.int32))
                arrays = [
                    pa.array(r["doc_ids"], type=pa.int64()),
                    pa.array(starts, type=pa.int64()),
                    pa.array(counts, type=pa.int64()),
                    pa.array(crcs, type=pa.int64()),
                ]
                if with_ids:
                    arrays.append(pa.array(lists, type=pa.list_(pa.int32())))
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return blocks.join(F.broadcast(shifts), "slice").mapInArrow(unpack, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with one ``doc_id``; reads the index and their blocks only."""
    reader = Reader(*_dictionary(spark, path))
    index = spark.read.parquet(f"{path}/blocks")
    places = (
        index.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
        .select("slice", "block", "doc_ids", "ends")
        .collect()
    )
    found = []
    for p in sorted(places):
        frames = index.where((F.col("slice") == p["slice"]) & (F.col("block") == p["block"]))
        row = frames.select("frames", "dictionary_hash").first()
        for k, key in enumerate(p.doc_ids):
            if key == doc_id:
                low = p.ends[k - 1] if k else 0
                ids = reader.ids(bytes(row.frames), low, p.ends[k], row.dictionary_hash)
                found.append(ids.tolist())
    return found
