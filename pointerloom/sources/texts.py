"""Lines and whole texts of many files, opened by the tasks that read them.

Spark's readers hold a name, a size and a place of every file in the driver, several
times over, and set up a reader for each. Here a table of files is dealt out to tasks, and a
task opens its files one after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointerloom.operators.skew import materialise
from pointerloom.sources.listing import local_name, opened_by_tasks

# Bytes that the opening of a file counts as, that a task gets, and of the largest piece of a file.
OPEN_BYTES, TASK_BYTES, PIECE_BYTES = 16 << 10, 16 << 20, 32 << 20
# Bytes read at once and handed over at once, and lines of a block.
READ_BYTES, BATCH_BYTES, BLOCK_LINES = 1 << 20, 4 << 20, 1000
# Bytes of texts that may well be broadcast.
SMALL_BYTES = 1 << 20

MARK = b"\xef\xbb\xbf"

PIECE = "path string, file_path string, start long, stop long, header binary, before long"
BLOCK = "session_id string, header binary, first long, lines array<binary>"
_BLOCK = pa.schema([
    ("session_id", pa.string()), ("header", pa.binary()), ("first", pa.int64()), ("lines", pa.list_(pa.binary())),
])
_UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def _piece_bytes(spark: SparkSession) -> int:
    """Bytes of a file that are read as one piece at most: not more than Spark's own readers take."""
    setting = spark.conf.get("spark.sql.files.maxPartitionBytes").lower()
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", setting).groups()
    return min(PIECE_BYTES, max(1, int(number) << _UNITS[unit]))


def _dealt(pieces: DataFrame, n: int, size: int) -> DataFrame:
    """``n`` files or pieces of ``size`` bytes in as many partitions as these ask for.

    Unless their texts are small, they pass an RDD, of which no size is known: by the size of this
    table Spark would take what is read for small too, and broadcast it through the driver in a join.
    """
    spark = pieces.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-(size + n * OPEN_BYTES) // TASK_BYTES))
    if size > SMALL_BYTES:
        pieces = spark.createDataFrame(pieces.rdd, pieces.schema)
    return pieces.repartition(max(1, min(n, tasks)))


def _chunks(path: str, start: int, stop: int) -> Iterator[bytes]:
    r"""The lines that begin in ``[start, stop)``, whole, some at a time.

    ``\r`` ends a line as ``\n`` does; the empty line between both counts as little as others.
    """
    with open(path, "rb") as file:
        at = max(start - 1, 0)
        file.seek(at)
        rest: list[bytes] = []
        inside = start == 0
        while data := file.read(READ_BYTES):
            data = data.replace(b"\r", b"\n")
            begin, at = at, at + len(data)
            if not inside:
                skip = data.find(b"\n") + 1
                if not skip:
                    continue
                if begin + skip >= stop:
                    return
                data, begin, inside = data[skip:], begin + skip, True
            if at >= stop:
                end = data.find(b"\n", max(stop - 1 - begin, 0))
                if end >= 0:
                    yield b"".join([*rest, data[:end]])
                    return
            cut = data.rfind(b"\n") + 1
            if cut:
                yield b"".join([*rest, data[:cut]])
                rest = []
            rest.append(data[cut:])
        yield b"".join(rest)


def _lines(path: str, start: int, stop: int) -> Iterator[list[bytes]]:
    for k, chunk in enumerate(_chunks(path, start, stop)):
        if start == k == 0:
            chunk = chunk.removeprefix(MARK)
        if lines := [line for line in chunk.split(b"\n") if line]:
            yield lines


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that have lines, with the first and the number of these."""
    for batch in batches:
        for piece in batch.to_pylist():
            n, first = 0, None
            for lines in _lines(local_name(piece["path"]), piece["start"], piece["stop"]):
                n, first = n + len(lines), lines[0] if first is None else first
            if n:
                row = {c: [piece[c]] for c in ("path", "file_path", "start", "stop")}
                yield pa.RecordBatch.from_pydict({**row, "header": pa.array([first], pa.binary()), "before": [n]})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of data lines: the header of their file, the number of the first, the lines."""
    ids, headers, firsts, ends, held, size = [], [], [], [0], [], 0

    def handed() -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held, pa.binary()))
        columns = [pa.array(ids), pa.array(headers, pa.binary()), pa.array(firsts, pa.int64()), lists]
        return pa.RecordBatch.from_arrays(columns, schema=_BLOCK)

    for batch in batches:
        for piece in batch.to_pylist():
            header, row = piece["header"], piece["before"]
            for lines in _lines(local_name(piece["path"]), piece["start"], piece["stop"]):
                if not row:
                    header = lines[0]
                for k in range(0 if row else 1, len(lines), BLOCK_LINES):
                    block = lines[k : k + BLOCK_LINES]
                    ids.append(piece["file_path"])
                    headers.append(header)
                    firsts.append(row + k - 1)
                    held += block
                    ends.append(len(held))
                    size += sum(map(len, block))
                    if size >= BATCH_BYTES or len(held) >= 16 * BLOCK_LINES:
                        yield handed()
                        ids, headers, firsts, ends, held, size = [], [], [], [0], [], 0
                row += len(lines)
    if ids:
        yield handed()


def line_blocks(files: DataFrame) -> DataFrame:
    """Data lines of files in blocks: ``session_id, header, first, lines``.

    ``header`` is the first line of a file, ``first`` the number of a block's first line among those
    after it; empty lines do not count. A file beyond the size of a piece is read in pieces; their
    lines are counted first, in a scan of such files alone, so that no line is shuffled.
    """
    size = _piece_bytes(files.sparkSession)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    pieces = files.where("length > 0").select("path", "file_path", "length", starts.alias("start")).select(
        "path", "file_path", "start", F.least(F.col("start") + size, "length").alias("stop"),
        F.lit(None).cast("binary").alias("header"), F.lit(0).cast("long").alias("before"),
        (F.col("length") > size).alias("cut"),
    )
    totals = {r.cut: (r.n, r.bytes) for r in pieces.groupBy("cut").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bytes")
    ).collect()}
    whole, cut = (pieces.where(c).drop("cut") for c in ("not cut", "cut"))
    if True in totals:
        in_file = Window.partitionBy("path").orderBy("start")
        earlier = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = _dealt(cut, *totals[True]).mapInArrow(_count, PIECE)
        numbered = counted.select(
            "path", "file_path", "start", "stop",
            F.first("header").over(in_file).alias("header"),
            (F.sum("before").over(earlier) - F.col("before")).alias("before"),
        )
        whole = whole.unionByName(materialise(numbered))
    return _dealt(whole, *map(sum, zip((0, 0), *totals.values()))).mapInArrow(_read, BLOCK)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0
    handed = lambda: pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.binary())], ["file_path", "value"])
    for batch in batches:
        for path, file_path in zip(batch.column("path").to_pylist(), batch.column("file_path").to_pylist()):
            with open(local_name(path), "rb") as file:
                texts.append(file.read())
            ids.append(file_path)
            size += len(texts[-1])
            if size >= BATCH_BYTES or len(ids) >= 10_000:
                yield handed()
                ids, texts, size = [], [], 0
    if ids:
        yield handed()


def whole_texts(spark: SparkSession, places: list[str], pattern: str, files: DataFrame) -> DataFrame:
    """Texts of ``files``, those below ``places`` that match, as ``file_path, value``."""
    if not opened_by_tasks(places):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        return reader.text(places, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    read = _dealt(files.select("path", "file_path"), n, size).mapInArrow(_whole, "file_path string, value binary")
    return read.select("file_path", F.col("value").cast("string").alias("value"))
