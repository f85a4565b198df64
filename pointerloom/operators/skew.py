"""Numbering and opening rows that hold when one key owns much of the data.

A window over ``partitionBy(session)`` puts a whole session into one task. Here
rows get positions from slices of the whole table instead, whatever the keys are.
Tables that several plans read are written to a folder that a scope can clear.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BLOCK = 4096

_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def session_bounds(df: DataFrame, key: str, position: str) -> DataFrame:
    """First and last position and row count per session (combined map-side)."""
    return df.groupBy(key).agg(
        F.min(position).alias("first_pos"),
        F.max(position).alias("last_pos"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session may go without; it gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pointerloom-"))
    return context.getCheckpointDir()


@contextmanager
def table_scope(spark: SparkSession) -> Iterator[str]:
    """Tables that plans write inside go when it ends, also after a failure.

    Frames made inside must be used up inside: they read these tables. Scopes can be
    nested; an inner one clears its own tables. Yields the scope's folder.
    """
    folder = f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    outer = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        path.getFileSystem(conf).delete(path, True)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a table that driver and executors share, in the scope if there is one."""
    return f"{_scope.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start there."""
    path = table_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(
    df: DataFrame, order: list[str], idx: str = "idx", slices: int | None = None, kept: str | None = None
) -> DataFrame:
    """Consecutive numbers from 0 over the whole table in a total ``order``.

    A range exchange sorts the table in slices of like size whatever the keys
    are, each row gets its place in its slice, and slices are shifted by the
    sizes of those before. The slices are written before they are counted, so
    a repeated task cannot cut them anew. The list of slice sizes has one row
    per shuffle partition, which bounds both its sort and its broadcast. ``slices``
    is how many there are at most; left out, Spark's own number. ``kept`` names a column
    for the slice of a row.
    """
    place = F.monotonically_increasing_id()
    sliced = (
        df.repartitionByRange(*([slices] if slices else []), *order)
        .sortWithinPartitions(*order)
        .withColumn("_slice", F.shiftright(place, 33).cast("int"))
        .withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    table = materialise(sliced)
    sizes = table.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifts = sizes.select(
        "_slice", (F.sum("_size").over(earlier) - F.col("_size")).alias("_shift")
    )
    return (
        table.join(F.broadcast(shifts), "_slice")
        .withColumns({idx: F.col("_shift") + F.col("_place"), **({kept: F.col("_slice")} if kept else {})})
        .drop("_slice", "_place", "_shift")
    )


def row_index(
    df: DataFrame, key: str, lead: str, order: list[str], slices: int | None = None
) -> DataFrame:
    """``row_number() - 1`` per ``key`` in the order ``lead, *order``, as ``row_idx``.

    Rows are numbered over the whole table, key by key, and each key's first number is
    taken off. No key is a group of rows anywhere: the first numbers are combined map-side
    and joined by key and slice, so that a task gets some slices of a large key at most.
    Null keys are a key.
    """
    numbered = number_rows(df, [key, lead, *order], "_nth", slices, "_in")
    parts = numbered.groupBy(F.col("_in").alias("_at"), F.col(key).alias("_key")).agg(F.min("_nth").alias("_first"))
    first = parts.withColumn("_first", F.min("_first").over(Window.partitionBy("_key")))
    return (
        numbered.join(first, (F.col("_in") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")))
        .withColumn("row_idx", F.col("_nth") - F.col("_first"))
        .drop("_nth", "_in", "_at", "_key", "_first")
    )


def explode_range(df: DataFrame, n: str, out: str, spread: bool = False) -> DataFrame:
    """One row per integer in ``[0, n)``, none where ``n`` is 0 or less.

    The range is opened in two steps of at most ``RANGE_BLOCK`` values inside,
    so a long one never stands in memory as one array. ``spread`` shuffles the
    outer steps, so a long one is not opened by a single task either. They go to a given
    number of tasks, as the bytes before the opening do not tell how many rows come of them.
    """
    last = F.floor((F.col(n) - 1) / F.lit(RANGE_BLOCK)).cast("long")
    outer = df.where(F.col(n) > 0).withColumn(
        "_outer", F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    if spread:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        outer = outer.repartition(tasks, *outer.columns)
    start = F.col("_outer") * RANGE_BLOCK
    stop = F.least(F.col(n), start + RANGE_BLOCK) - 1
    return outer.withColumn(out, F.explode(F.sequence(start, stop))).drop("_outer")
