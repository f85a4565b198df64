"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.llm.common import written


class Forest:
    """Union-find over whole numbers; the root of a tree is its least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        low, high = min(a, b), max(a, b)
        self.parent[low] = low
        self.parent[high] = low


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition with no more of them than nodes."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
    rows = [(x, forest.root(x)) for x in list(forest.parent)]
    rows = [(x, top) for x, top in rows if x != top]
    columns = list(zip(*rows)) if rows else [[], []]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, type=pa.int64()) for c in columns], names=["a", "b"]
    )


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; a component is its least node.

    Each partition's edges are reduced to a spanning forest first. Then large-star
    and small-star steps alternate, in which every node hands its neighbours its
    least neighbour; they end when the edges no longer change, after about
    log n rounds. Each round is written to the shared folder.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = pairs.where("a is not null and b is not null and a <> b")
    now = written(pairs.mapInArrow(_spanning, "a long, b long").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(small, "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def contiguous(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in a sorted array, with its end."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
