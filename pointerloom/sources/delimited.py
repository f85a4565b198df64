"""Readers of delimited logs whose columns are named by each file's own header.

Files of one folder may name, order and separate their columns differently, so
a schema by position does not do. Lines are read as text and matched with the
header line of their file; which delimiter and which columns apply is decided
per file by expressions, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointerloom.functions.expr import python_float
from pointerloom.sources.listing import full_names, matching, opened_by_tasks, refuse_ignored, walk
from pointerloom.sources.texts import line_blocks

# Columns that hold the time of an HMI record, the first present one counts (fixed values).
HMI_TIME_COLUMNS = ("epoch", "initepoch", "timestamp")

# A noncharacter: what no text holds.
HIDDEN = "\uffff"


def _lines(spark: SparkSession, places: list[str]) -> DataFrame:
    """Lines that are not empty, with the file, the split and a number rising in the split."""
    refuse_ignored(spark, places, "*.csv")
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(places)
        .select(
            F.col("_metadata.file_path").alias("session_id"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.rtrim("value", F.lit("\r")).alias("line"),
        )
        .where(F.length("line") > 0)
        .withColumn("line_id", F.monotonically_increasing_id())
    )


def _cells(line: Column, delimiter: Column) -> Column:
    """Fields of a line; a delimiter inside double quotes does not split.

    Every second part between quotes is inside; its delimiters are hidden while the
    line is split, so the work grows with the length of the line.
    """
    parts = F.transform(
        F.split(line, '"'),
        lambda part, i: F.when(i % 2 == 1, F.replace(part, delimiter, F.lit(HIDDEN))).otherwise(part),
    )
    cells = F.split(F.array_join(parts, '"'), delimiter)
    bare = F.transform(
        cells,
        lambda c: F.replace(
            F.regexp_replace(F.replace(c, F.lit(HIDDEN), delimiter), '^"|"$', ""), F.lit('""'), F.lit('"')
        ),
    )
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(F.split(line, delimiter))


def _files(lines: DataFrame) -> DataFrame:
    """Header line per file and the line counts and first line of each split.

    One row per split of a file: far fewer than lines.
    """
    splits = lines.groupBy("session_id", "split_start").agg(
        F.min("line_id").alias("first_id"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min_by("line", "line_id").alias("first_line"),
    )
    in_file = Window.partitionBy("session_id").orderBy("split_start")
    before = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return splits.select(
        "session_id",
        "split_start",
        "first_id",
        F.first("first_line").over(in_file).alias("header"),
        (F.sum("n_lines").over(before) - F.col("n_lines")).alias("lines_before"),
    )


def _by_spark(spark: SparkSession, places: list[str], sep: Column) -> DataFrame:
    """Data lines of files that only Spark opens, as ``read_delimited`` gives them.

    ``row_idx`` comes from the line counts of earlier splits, so lines are not sorted. The
    text is scanned once: its lines are exchanged by file and split, and the table of splits, which
    holds each header split once, is made from the same exchange. Spark's list of files
    stands in the driver.
    """
    lines = _lines(spark, places).repartition("session_id", "split_start")
    files = _files(lines).withColumn("sep", sep).withColumn("names", _cells(F.col("header"), F.col("sep")))
    return (
        lines.join(files.drop("header"), ["session_id", "split_start"])
        .withColumn(
            "row_idx", F.col("lines_before") + F.col("line_id") - F.col("first_id") - F.lit(1)
        )
        .where("row_idx >= 0")
        .select("session_id", "row_idx", "names", _cells(F.col("line"), F.col("sep")).alias("cells"))
    )


def read_delimited(
    spark: SparkSession, folder: str | list[str] | DataFrame, delimiter: str | Column
) -> DataFrame:
    """Data lines as ``session_id, row_idx, names, cells``.

    ``row_idx`` counts the data lines of a file from 0. Lines come in blocks that know
    their file's header and their first number, so they are neither shuffled nor sorted, and a
    header is split once per block. ``delimiter`` may depend on the column ``header``. Instead of
    places, ``folder`` may be a table of files that tasks open, as the catalogue gives it.
    """
    sep = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    if isinstance(folder, DataFrame):
        files = folder
    else:
        places = full_names(spark, folder)
        if not opened_by_tasks(places):
            return _by_spark(spark, places, sep)
        files = matching(walk(spark, places), "*.csv")
    named = (
        line_blocks(files).withColumn("header", F.col("header").cast("string"))
        .withColumn("sep", sep)
        .withColumn("names", _cells(F.col("header"), F.col("sep")))
    )
    rows = named.select("session_id", "first", "names", "sep", F.posexplode("lines").alias("place", "bytes"))
    return rows.select(
        "session_id",
        (F.col("first") + F.col("place")).alias("row_idx"),
        "names",
        _cells(F.col("bytes").cast("string"), F.col("sep")).alias("cells"),
    )


def _cell(name: str) -> Column:
    """Field of a column, NULL where the file or the line lacks it or it is empty."""
    place = F.array_position("names", name)
    value = F.when(place > 0, F.get("cells", (place - 1).cast("int")))
    return F.when(F.length(value) > 0, value)


def _has(name: str) -> Column:
    return F.array_contains("names", name)


def read_ck(spark: SparkSession, folder: str | list[str] | DataFrame) -> DataFrame:
    """Pointer events of blank-separated files, a session per file.

    Event order at equal times is line order (``tie``). A file without one of
    the four columns stops the read.
    """
    needed = ("timestamp", "event", "xpos", "ypos")
    complete = F.forall(F.array(*[F.lit(c) for c in needed]), lambda c: F.array_contains("names", c))
    lines = read_delimited(spark, folder, " ")
    checked = F.when(complete, F.col("session_id")).otherwise(
        F.raise_error(F.concat(F.lit("missing column in "), F.col("session_id")))
    )
    # Out of an array of one, as filters on plain columns are moved before them and repeat their work.
    event = F.struct(
        checked.alias("session_id"),
        python_float(_cell("timestamp")).alias("timestamp"),
        F.col("row_idx").alias("tie"),
        _cell("event").alias("event"),
        python_float(_cell("xpos")).alias("xpos"),
        python_float(_cell("ypos")).alias("ypos"),
    )
    return lines.select(F.inline(F.array(event)))


def read_hvt(
    spark: SparkSession,
    folder: str | list[str] | DataFrame,
    max_rows: int | None = None,
) -> DataFrame:
    """Trajectory records of ``;``-separated files, a session per file, in line order.

    ``velocity`` and ``distance`` are NULL where missing; ``has_velocity`` and
    ``has_distance`` tell whether the file has the column at all.
    """
    lines = read_delimited(spark, folder, ";")
    kept = lines if max_rows is None else lines.where(F.col("row_idx") < max_rows)
    return kept.select(
        "session_id",
        "row_idx",
        python_float(_cell("velocity")).alias("velocity"),
        python_float(_cell("distance")).alias("distance"),
        _has("velocity").alias("has_velocity"),
        _has("distance").alias("has_distance"),
    )


def read_hmi(
    spark: SparkSession,
    folder: str | list[str] | DataFrame,
    max_records: int | None = None,
) -> DataFrame:
    """HMI records with the text of their time column as ``epoch``.

    A file is split at ``;`` if that shows a column ``epoch`` or ``initepoch``,
    else at ``,``. The time is the first present of ``epoch``, ``initepoch`` and
    ``timestamp``; a file with none of them has no records.
    """
    at_semicolon = _cells(F.col("header"), F.lit(";"))
    delimiter = F.when(
        F.array_contains(at_semicolon, "epoch") | F.array_contains(at_semicolon, "initepoch"), ";"
    ).otherwise(",")
    lines = read_delimited(spark, folder, delimiter)
    kept = lines if max_records is None else lines.where(F.col("row_idx") < max_records)
    epoch, usable = F.lit(None).cast("string"), F.lit(False)
    for name in reversed(HMI_TIME_COLUMNS):
        epoch = F.when(_has(name), _cell(name)).otherwise(epoch)
        usable = usable | _has(name)
    return kept.where(usable).select("session_id", "row_idx", epoch.alias("epoch"))
