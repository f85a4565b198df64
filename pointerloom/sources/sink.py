"""Writers of samples and sequences, and of logs as many small files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.schema import FEATURES, SAMPLE_COLUMNS


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples as parquet, a folder per source, features as 32-bit floats."""
    columns = [
        F.col(c).cast("float") if c in FEATURES else F.col(c)
        for c in SAMPLE_COLUMNS
    ]
    samples.select(*columns).write.mode(mode).partitionBy("source").parquet(path)


def write_sequences(seqs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sequences as parquet: ``seq_id``, 32-bit feature arrays and ``label``."""
    seqs.select(
        "seq_id", F.col("features").cast("array<array<float>>"), F.col("label").cast("int")
    ).write.mode(mode).parquet(path)


def write_files(lines: DataFrame, root: str, header: str | None = None, suffix: str = "") -> int:
    """A text file per ``part`` of ``part, line`` rows: the header, then its lines. Returns their number.

    Rows of a part must follow each other in one partition. A folder per partition
    holds the files of its parts, so far fewer folders than files are listed later. Files are
    written by pyarrow where the rows lie, as Spark's writers take a folder, a commit
    and on local disks several processes for each. A file gets its name when it is whole, so
    a repeated task only replaces files by like ones. ``root`` is shared by all executors and
    in a file system that pyarrow knows.
    """
    place = re.sub("^file:/+", "/", root.rstrip("/"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(place)
        folder = f"{base}/{TaskContext.get().partitionId():05}"
        part, stream, draft, n = None, None, f"{folder}/.{uuid.uuid4().hex}", 0

        def close() -> None:
            stream.close()
            store.move(draft, f"{folder}/part={part}{suffix}")

        for batch in batches:
            for key, line in zip(batch.column("part").to_pylist(), batch.column("line").to_pylist()):
                if stream is None or key != part:
                    if stream is None:
                        store.create_dir(folder)
                    else:
                        close()
                    part, stream, n = key, store.open_output_stream(draft), n + 1
                    if header is not None:
                        stream.write(f"{header}\n".encode())
                stream.write(f"{line or ''}\n".encode())
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return lines.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
