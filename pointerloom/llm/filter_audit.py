"""Audit of a chain of filters: what each removes, in every order they could run in.

Every document gets a mask with a bit per filter it fails. The masks of a part of the
corpus (a language, say) are counted, and the counts become a decision diagram: one
level per filter, a node per distinct way in which what follows can turn out, each with
the number of documents below it. Neighbouring levels can be swapped in place, so all
orders are visited by one swap each. In any of them the path on which every filter is
passed has the whole story: the branch that leaves it at a level is what that filter removes there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Orders are listed in full: their number is the factorial of this at most.
MOST_FILTERS = 8
SPACES = r"[\x20\x09-\x0D]+"
# What a document weighs: itself, and itself if its label is good or toxic.
WEIGHTS = ("n", "good", "toxic")

SCHEMA = (
    "part string, filter_order string, step int, filter string, kept long, removed long, "
    "redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


class Diagram:
    """A count-weighted decision diagram over failure masks; level i tests ``order[i]``.

    ``low`` is where a filter is passed, ``high`` where it is failed. Equal nodes of a
    level are one node; the last level holds the distinct weights themselves.
    """

    def __init__(self, counts: np.ndarray):
        """``counts`` has an axis of 2 (passed, failed) per filter and one of weights."""
        self.filters = counts.ndim - 1
        self.order = list(range(self.filters))
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[np.ndarray] = []
        self.levels: list[dict[tuple, int]] = [{} for _ in range(self.filters + 1)]
        self.root = self._build(counts, 0)

    def _build(self, counts: np.ndarray, level: int) -> int:
        if level == self.filters:
            key = tuple(counts.tolist())
            if key not in self.levels[level]:
                self.levels[level][key] = self._add(-1, -1, counts)
            return self.levels[level][key]
        return self._node(
            level, self._build(counts[0], level + 1), self._build(counts[1], level + 1)
        )

    def _add(self, low: int, high: int, weight: np.ndarray) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.low) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        found = self.levels[level].get((low, high))
        if found is None:
            found = self._add(low, high, self.weight[low] + self.weight[high])
            self.levels[level][(low, high)] = found
        return found

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one; what is above stays as it is."""
        nodes = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        low, high = self.low, self.high
        for node in nodes:
            a, b = low[node], high[node]
            passed = self._node(level + 1, low[a], low[b])
            failed = self._node(level + 1, high[a], high[b])
            low[node], high[node] = passed, failed
            self.levels[level][(passed, failed)] = node
        order = self.order
        order[level], order[level + 1] = order[level + 1], order[level]

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(filter, weights removed, weights kept) along the path that passes everything."""
        node = self.root
        for which in self.order:
            yield which, self.weight[self.high[node]], self.weight[self.low[node]]
            node = self.low[node]


def plain_changes(items: int) -> Iterator[int]:
    """Places of swaps that lead through all orders of ``items`` things, each once."""
    place, step = list(range(items)), [-1] * items
    thing = list(range(items))
    while True:
        movable = [
            x for x in range(items)
            if 0 <= place[x] + step[x] < items and thing[place[x] + step[x]] < x
        ]
        if not movable:
            return
        x = movable[-1]
        at, to = place[x], place[x] + step[x]
        other = thing[to]
        thing[at], thing[to], place[x], place[other] = other, x, to, at
        for y in range(x + 1, items):
            step[y] = -step[y]
        yield min(at, to)


def audit_orders(counts: np.ndarray, names: Sequence[str]) -> list[tuple]:
    """Rows ``filter_order, step, filter, kept, removed, ..., shapley`` of all orders."""
    filters = len(names)
    fails = [counts.take(1, axis=k).reshape(-1, counts.shape[-1])[:, 0].sum() for k in range(filters)]
    alone = [counts[tuple(int(k == j) for j in range(filters))][0] for k in range(filters)]
    shapley = [0] * filters
    diagram, rows = Diagram(counts), []

    def visit() -> None:
        order = "".join(names[k] for k in diagram.order)
        for step, (k, removed, kept) in enumerate(diagram.steps(), 1):
            shapley[k] += int(removed[0])
            rows.append((order, step, k, kept[0], removed, fails[k] - removed[0], alone[k]))

    visit()
    for level in plain_changes(filters):
        diagram.swap(level)
        visit()
    return [
        (order, step, names[k], int(kept), int(gone[0]), int(redundant), int(only), int(gone[1]),
         int(gone[2]), shapley[k])
        for order, step, k, kept, gone, redundant, only in rows
    ]


def text_filters() -> list[tuple[str, Column]]:
    """Failure conditions of single texts, over a column ``text`` without nulls."""
    words = F.array_remove(F.split("text", SPACES), "")
    number = lambda column: column.cast("long")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return [
        ("A", F.size(words) < 200),
        ("B", 100 * number(F.size(F.array_distinct(words))) < 50 * number(F.size(words))),
        ("C", 100 * number(capitals) > 3 * number(F.length("text"))),
        ("D", F.col("text").rlike(r"[#$%&*|]")),
    ]


def failure_masks(
    docs: DataFrame,
    labels: DataFrame,
    filters: Sequence[tuple[str, Column]],
    part: str,
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail.

    Bit k stands for filter k, the bit after the last for a text that a smaller doc_id
    has too. Texts are read once; what is shuffled of a document is its id, the digest
    of its text and its mask. Copies are counted by digest, part and label before their
    smallest id is looked for, so a text that a third of all documents have is a few
    rows by then.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    failed = [F.when(fails, 1 << k).otherwise(0) for k, (_, fails) in enumerate(filters)]
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    masked = rows.select("doc_id", "part", digest.alias("digest"), sum(failed, F.lit(0)).alias("mask"))
    judged = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max((F.col("quality") == 1).cast("long")).alias("good"),
            F.max((F.col("toxic") == 1).cast("long")).alias("toxic"),
        )
    )
    cell = ["digest", "part", "mask", "good", "toxic"]
    one = (
        masked.join(judged, "doc_id", "left")
        .fillna(0, ["good", "toxic"])
        .groupBy("doc_id", *cell)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    cells = one.groupBy(*cell).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(named).alias("first"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    here = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n"))
    again = 1 << len(filters)
    return (
        cells.withColumn("smallest", smallest)
        .withColumn("originals", F.col("nameless") + F.coalesce(here, F.lit(0)))
        .select(
            "part", "good", "toxic",
            F.explode(
                F.array(
                    F.struct(F.col("mask"), F.col("originals").alias("n")),
                    F.struct(
                        (F.col("mask") + again).alias("mask"),
                        (F.col("n") - F.col("originals")).alias("n"),
                    ),
                )
            ).alias("c"),
        )
        .groupBy("part", "c.mask")
        .agg(
            F.sum("c.n").alias("n"),
            F.sum(F.col("c.n") * F.col("good")).alias("good"),
            F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"),
        )
    )


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Sequence[tuple[str, Column]] | None = None,
    part: str = "lang",
    duplicates: str = "E",
) -> DataFrame:
    """What every filter removes at every place of every order, per part of ``docs``.

    ``filters`` are names (a letter each) with failure conditions over a column
    ``text``; one more filter, ``duplicates``, fails documents whose text a smaller
    ``doc_id`` has anywhere in the table. A row per part, order and step: documents
    ``kept`` after it and ``removed`` by it, ``redundant`` ones (fail it, gone before),
    ``unique_fails`` (fail nothing else), ``good_lost`` and ``toxic_lost`` (removed with
    that label), and ``shapley``, what the filter removes summed over all orders.

    A part reaches its diagram as at most 2 ** filters counts. Null texts are empty,
    a null part is the empty one. A null id is no smaller id and has none; rows that
    repeat id and text are copies of no smaller id and count each. Of repeated labels
    any that says so decides. An empty table gives no rows. Other columns are ignored.
    """
    filters = text_filters() if filters is None else list(filters)
    names = [*(name for name, _ in filters), duplicates]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders, at most {MOST_FILTERS}")
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def audit(cells: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((2,) * len(names) + (len(WEIGHTS),), dtype=np.int64)
        bits = {m: tuple(m >> k & 1 for k in range(len(names))) for m in cells["mask"]}
        for mask, *weights in cells[["mask", *WEIGHTS]].itertuples(index=False):
            counts[bits[mask]] += weights
        rows = [(cells["part"].iloc[0], *r) for r in audit_orders(counts, names)]
        return pd.DataFrame(rows, columns=columns)

    masks = failure_masks(docs, labels, filters, part)
    return masks.groupBy("part").applyInPandas(audit, SCHEMA)
