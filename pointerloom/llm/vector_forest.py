"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits by random directions until leaves are small, each time at the
emptiest place near the middle, so that a dense family is rather left whole. Rows
close to a split go to both sides, so most near pairs meet in some leaf of every
tree. The trees are fitted on a bounded sample; every row is then put into all of
its leaves, and rows of a leaf are compared exactly. A pair counts in the first
leaf that both are in. Leaves give counts and a spanning forest, not pairs.

A leaf too large for a task, which is a dense family or more rows than the sample
tells apart, is cut into blocks, and every two blocks are compared: nothing is
dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.llm.common import written
from pointerloom.llm.graph import Forest, components

THRESHOLD = 0.95
TREES = 4
#: The trees are fitted on at most this many distinct vectors.
SAMPLE_ROWS = 16_000
#: Leaves are split above this many rows, as far as the sample can tell.
LEAF_ROWS = 300
LEAST_SAMPLED = 12
#: Half the width of the zone around a split whose rows go to both sides.
SPILL = 0.02
DIRECTIONS = 8
#: A node is left whole if so many of its rows are this close to their mean.
DENSE_SHARE, DENSE_COSINE = 0.6, 0.975
#: Leaves above this many rows are compared block by block.
BLOCK_ROWS = 1_500
SEED = 5


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision."""
    wide = values.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def usable(vector) -> bool:
    """Whether a vector can link: not null, not empty, not zero, all finite."""
    if vector is None or not len(vector):
        return False
    values = np.array(vector, dtype=np.float64)
    return bool(np.isfinite(values).all() and values.any())


def fit_tree(rows: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[list, int]:
    """Nodes (direction, limit, below, above), leaves as their number; and how many leaves.

    ``scale`` is how many rows of the table one of the sample stands for.
    """
    nodes: list = []
    leaves = 0

    def place(members: np.ndarray) -> tuple:
        x = rows[members]
        best = None
        for _ in range(DIRECTIONS):
            direction = rng.normal(size=rows.shape[1])
            direction /= np.linalg.norm(direction)
            at = np.sort(x @ direction)
            inner = at[int(len(at) * 0.3) : int(len(at) * 0.7) + 1]
            limits = (inner[1:] + inner[:-1]) / 2
            if not len(limits):
                continue
            near = np.searchsorted(at, limits + SPILL) - np.searchsorted(at, limits - SPILL)
            k = int(near.argmin())
            if best is None or near[k] < best[0]:
                best = (int(near[k]), direction, float(limits[k]))
        return best

    waiting = [(np.arange(len(rows)), -1, 0)]
    while waiting:
        members, parent, side = waiting.pop()
        split = None
        if len(members) * scale > LEAF_ROWS and len(members) >= LEAST_SAMPLED:
            mean = rows[members].mean(axis=0)
            mean /= np.linalg.norm(mean) or 1.0
            if (rows[members] @ mean >= DENSE_COSINE).mean() < DENSE_SHARE:
                split = place(members)
        if split is not None and split[0] > 0.8 * len(members):
            split = None
        if split is None:
            here, leaves = -1 - leaves, leaves + 1
        else:
            here = len(nodes)
            nodes.append([split[1], split[2], None, None])
            at = rows[members] @ split[1]
            waiting.append((members[at <= split[2] + SPILL], here, 2))
            waiting.append((members[at >= split[2] - SPILL], here, 3))
        if parent >= 0:
            nodes[parent][side] = here
    return nodes, leaves


def fit_forest(
    rows: np.ndarray, scale: float, trees: int = TREES, first: int = 0
) -> tuple[list[tuple[list, int]], int]:
    """Trees with the number of their first leaf, from ``first`` on; and the next free number."""
    rng, forest = np.random.default_rng(SEED), []
    for _ in range(trees):
        nodes, leaves = fit_tree(rows, scale, rng)
        forest.append((nodes, first))
        first += leaves
    return forest, first


def fit_widths(vectors: list[bytes], scale: float) -> tuple[dict[int, list], int]:
    """A forest for each width in a sample, leaves numbered across widths."""
    of_width: dict[int, list[bytes]] = defaultdict(list)
    for v in vectors:
        of_width[len(v) // 8].append(v)
    forests, first = {}, 0
    for width, parts in sorted(of_width.items()):
        rows = np.frombuffer(b"".join(parts), np.float64).reshape(-1, width)
        forests[width], first = fit_forest(rows, scale, first=first)
    return forests, first


def leaves_of(rows: np.ndarray, forest: list[tuple[list, int]]) -> list[list[int]]:
    """Numbers of all leaves of every row, ascending."""
    out: list[list[int]] = [[] for _ in range(len(rows))]
    for nodes, first in forest:
        waiting = [(np.arange(len(rows)), 0 if nodes else -1)]
        while waiting:
            members, here = waiting.pop()
            if not len(members):
                continue
            if here < 0:
                for i in members.tolist():
                    out[i].append(first - 1 - here)
                continue
            direction, limit, below, above = nodes[here]
            at = rows[members] @ direction
            waiting.append((members[at <= limit + SPILL], below))
            waiting.append((members[at >= limit - SPILL], above))
    return [sorted(x) for x in out]


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least common number of rows of two tables, whose rows ascend and end in -1 or -2."""
    least = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        shared = (a[:, k : k + 1] == b).any(axis=1)
        least = np.where(shared, np.minimum(least, a[:, k]), least)
    return least


COMPARED = "rep long, links long, root long"


def _compare(threshold: float):
    """Links of the rows of a leaf, or between two blocks of one; they have one width."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaf, i, j = (k.as_py() for k in key)
        reps = table.column("rep").to_numpy()
        copies = table.column("n").to_numpy()
        block = table.column("block").to_numpy()
        data = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float64)
        rows = data.reshape(len(reps), -1)
        codes = table.column("leaves").to_pylist()
        deep = max(map(len, codes))
        padded = np.array([c + [-1] * (deep - len(c)) for c in codes], dtype=np.int64)
        other = np.where(padded < 0, -2, padded)
        links = np.zeros(len(reps), dtype=np.int64)
        forest = Forest()
        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block == j)
        for low in range(0, len(left), 256):
            part = left[low : low + 256]
            p, q = np.nonzero(rows[part] @ rows[right].T >= threshold)
            p, q = part[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            for at in range(0, len(p), 50_000):
                a, b = p[at : at + 50_000], q[at : at + 50_000]
                new = first_common(padded[a], other[b]) == leaf
                a, b = a[new], b[new]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for x, y in zip(reps[a].tolist(), reps[b].tolist()):
                    forest.join(x, y)
        touched = np.flatnonzero(links)
        return pa.table(
            {
                "rep": pa.array(reps[touched]),
                "links": pa.array(links[touched]),
                "root": pa.array([forest.root(x) for x in reps[touched].tolist()], pa.int64()),
            }
        )

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector by cosine.

    Vectors link with those of their own length; null, empty, zero or not finite
    ones with nothing. Equal vectors are compared once. ``vec_id`` names a row; a null one
    is left out of components and links. An empty table gives no rows.
    """
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    classes = (
        ids.where("embedding is not null and vec_id is not null")
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (r, n, unit_rows(np.array([v], dtype=np.float64)).tobytes())
                for r, n, v in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "embedding")))
                if usable(v)
            ]
            columns = list(zip(*found)) if found else [[], [], []]
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["rep", "n", "vector"]
            )

    # Equal once more at length 1: multiples of a vector stay classes of their own.
    units = written(classes.mapInArrow(clean, "rep long, n long, vector binary"), "units")
    total = units.count()
    if not total:
        return ids.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    # Every width has its share of the sample.
    sample = units.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("vector").collect()
    forests, free = fit_widths([bytes(r.vector) for r in sample], total / len(sample))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            found: list[list[int]] = [[] for _ in vectors]
            widths = np.array([len(v) // 8 for v in vectors], dtype=np.int64)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width).tolist()
                if width not in forests:
                    # Too rare for the sample: one leaf.
                    here = [[free + width]] * len(at)
                else:
                    data = np.frombuffer(b"".join(vectors[i] for i in at), np.float64)
                    here = leaves_of(data.reshape(-1, width), forests[width])
                for i, leaves in zip(at, here):
                    found[i] = leaves
            leaves = pa.array(found, type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, leaves], names=["rep", "n", "vector", "leaves"]
            )

    placed = written(
        units.mapInArrow(place, "rep long, n long, vector binary, leaves array<long>"), "placed"
    )
    # One row per leaf: the sample bounds their number, but for widths too rare for it.
    counts = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
    blocks = counts.select("leaf", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    spread = (
        placed.withColumn("leaf", F.explode("leaves"))
        .join(F.broadcast(blocks), "leaf")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "partner"))
        .withColumn("j", F.greatest("block", "partner"))
        .select("leaf", "i", "j", "block", "rep", "n", "vector", "leaves")
    )
    compared = written(
        spread.groupBy("leaf", "i", "j").applyInArrow(_compare(threshold), COMPARED),
        "compared",
    )
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        units.join(links, "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "rep",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    members = ids.join(classes.select("embedding", "rep"), "embedding", "left")
    out = members.join(known, "rep", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
