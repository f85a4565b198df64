"""The filter audit against SQL and plain counting on small tables."""

from itertools import permutations, product

import duckdb
import numpy as np
import pytest

from pointerloom.llm.filter_audit import Diagram, audit_orders, filter_audit, plain_changes
from pointerloom.llm.oracles import OP12

TEXTS = [
    "word " * 250, " ".join(f"w{k}" for k in range(230)), "ABC DEF " * 150, "a|b", "", None,
    "x\x85y é\tx \x0b\x1cz", "# " + "q " * 300, "Long text " + " ".join(map(str, range(50_000))),
]


def plain_steps(counts, names, order):
    """(filter, removed, kept, good removed) of one order by walking over all masks."""
    masks, gone, out = list(product((0, 1), repeat=len(names))), set(), []
    for k in order:
        now = [m for m in masks if m[k] and m not in gone]
        gone.update(now)
        kept = sum(int(counts[m][0]) for m in masks if m not in gone)
        out.append((names[k], sum(int(counts[m][0]) for m in now), kept, sum(int(counts[m][1]) for m in now)))
    return out


@pytest.mark.parametrize("filters", [1, 2, 3, 5])
def test_all_orders(filters):
    counts = np.random.default_rng(filters).integers(0, 4, (2,) * filters + (3,))
    names = "ABCDE"[:filters]
    rows = audit_orders(counts, names)
    by_order = {}
    for order, step, name, kept, removed, *_, good, _, _ in rows:
        by_order.setdefault(order, []).append((name, removed, kept, good))
    assert sorted(by_order) == sorted("".join(p) for p in permutations(names))
    for order, steps in by_order.items():
        assert steps == plain_steps(counts, names, [names.index(x) for x in order])


def test_swaps_keep_the_diagram_small():
    # Only one mask has documents: a chain of nodes beside the empty ones, in every order.
    counts = np.zeros((2,) * 5 + (3,), dtype=int)
    counts[0, 1, 0, 0, 1] = 7
    diagram = Diagram(counts)
    for level in plain_changes(5):
        diagram.swap(level)
        assert max(map(len, diagram.levels)) <= 2
        assert diagram.weight[diagram.root].tolist() == [7, 7, 7]


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")


@pytest.mark.parametrize("seed", [0, 1])
def test_like_sql(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [
        (None if k % 11 == 0 else int(draw.integers(0, 60)), TEXTS[int(draw.integers(0, len(TEXTS)))],
         [None, "", "en", "fr"][int(draw.integers(0, 4))], 1)
        for k in range(80)
    ]
    labels = [(k % 40, k % 2 if k % 5 else None, k % 3 % 2, "en") for k in range(60)] + [(None, 1, 1, "en")]
    docs, marks = frames(spark, rows, labels)
    db = duckdb.connect()
    db.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    db.register("labels", marks.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    names = db.sql(OP12).columns
    got = filter_audit(docs, marks).select(*names)
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.sql(OP12).fetchall())


def test_hot_text_and_empty(spark):
    docs, marks = frames(spark, [(k, "same", "en", 0) for k in range(200)], [])
    rows = filter_audit(docs, marks).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.filter, r.kept, r.removed) for r in rows][:2] == [("E", 1, 199), ("A", 0, 1)]
    assert rows[1].redundant == 199 and rows[1].unique_fails == 1
    assert filter_audit(docs.limit(0), marks).count() == 0
    with pytest.raises(ValueError):
        filter_audit(docs, marks, [(str(k), None) for k in range(9)])
