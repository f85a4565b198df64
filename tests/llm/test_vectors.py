"""Vector forest, components and the pipeline against plain forms."""

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from pointerloom.llm import vector_forest
from pointerloom.llm.graph import components
from pointerloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(9, 8), (8, 7), (1, 2), (2, 3), (3, 1), (5, 5), (None, 4), (20, 1), (20, 7)]
    edges += [(100 + k, 101 + k) for k in range(60)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    want = {k: 1 for k in (1, 2, 3, 7, 8, 9, 20)} | {100 + k: 100 for k in range(61)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors():
    rng = np.random.default_rng(6)
    rows = [rng.normal(size=16) for _ in range(150)]
    for _ in range(4):
        base = rng.normal(size=16)
        rows += [base + rng.normal(size=16) * rng.choice((0.02, 0.15)) for _ in range(30)]
    rows += [rows[0]] * 5 + [rows[0] * 2.5]
    out = [(k, [float(v) for v in r]) for k, r in enumerate(rows)]
    return out + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16),
                  (903, [float("inf")] + [1.0] * 15), (904, [1.0, 2.0]), (905, [])]


@pytest.mark.parametrize("block", [1_500, 20])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_forest, "BLOCK_ROWS", block)
    monkeypatch.setattr(vector_forest, "LEAF_ROWS", 40)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as n", "2 as leaf"
    )
    got = {r.vec_id: r for r in vector_forest.near_vectors(df.repartition(4)).collect()}
    assert len(got) == len(rows)
    good = [(k, np.array(v)) for k, v in rows if k < 900]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    found = np.array([got[k].n_links for k, _ in good])
    assert (found <= linked.sum(axis=1)).all()
    assert found.sum() >= 0.9 * linked.sum()
    for k in range(900, 906):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[0].n_links >= 6 and got[0].component_id == 0
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


@pytest.mark.parametrize("sample", [16_000, 20])
def test_vectors_of_several_widths(spark, monkeypatch, sample):
    monkeypatch.setattr(vector_forest, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(vector_forest, "LEAF_ROWS", 40)
    rng = np.random.default_rng(9)
    rows = []
    for width, families in ((16, 60), (8, 50), (3, 1)):
        for _ in range(families):
            first = len(rows)
            base = rng.normal(size=width)
            rows += [(first + k, first, [float(v) for v in base * (k + 1)]) for k in range(3)]
            rows.append((first + 3, first, rows[-1][2]))
    df = spark.createDataFrame([(k, v) for k, _, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_forest.near_vectors(df.repartition(4)).collect()}
    for k, first, _ in rows:
        assert got[k].n_links >= 3 and got[k].component_id <= first
    assert all(got[k].component_id == first for k, first, v in rows if len(v) == 16)
    assert {got[k].component_id for k, _, v in rows if len(v) == 3} == {len(rows) - 4}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_forest.near_vectors(empty).collect() == []
    nulls = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    (r,) = vector_forest.near_vectors(nulls).collect()
    assert (r.n_links, r.component_id, r.kept) == (0, 1, True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, FOLDER)
        assert after.schema == docs.schema
        assert after.exceptAll(kept).isEmpty()
        kept = spark.createDataFrame(after.collect(), docs.schema)
    assert 0 < kept.count() < docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_pipeline_without_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        assert after.count() == 0
