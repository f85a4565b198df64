import pytest
from pyspark.sql import functions as F

from pointerloom.operators.sequences import long_form, sequences
from pointerloom.schema import FEATURES


@pytest.fixture(scope="module")
def samples(spark):
    """1,003 samples: one session of 700, 60 of 5 and one of 3; features tell the place."""
    place = F.col("id")
    session = F.when(place < 700, "a-hot").when(place < 1000, F.concat(F.lit("b"), F.lpad(((place - 700) / 5).cast("int").cast("string"), 3, "0"))).otherwise("c")
    return (
        spark.range(1003)
        .select(
            session.alias("session_id"), place.alias("window_idx"),
            *[(place * 9 + i).cast("double").alias(f) for i, f in enumerate(FEATURES)],
            (place % 6).cast("int").alias("label"),
        )
        .orderBy(F.rand(5))
    )


@pytest.mark.parametrize("bucket", [8, 100, 65_536])
def test_global(samples, bucket):
    got = sequences(samples, ["session_id", "window_idx"], bucket=bucket).orderBy("seq_id").collect()
    assert [r.seq_id for r in got] == list(range(996))
    for r in got:
        assert [row[0] for row in r.features] == [9.0 * (r.seq_id + p) for p in range(8)]
        assert [row[8] - row[0] for row in r.features] == [8.0] * 8
        assert r.label == (r.seq_id + 7) % 6 and r.window_idx == r.seq_id + 7


@pytest.mark.parametrize("bucket", [8, 100])
def test_inside_sessions(samples, bucket):
    runs = sequences(samples, ["session_id", "window_idx"], scope="session", bucket=bucket)
    got = runs.collect()
    assert sorted(r.window_idx for r in got) == list(range(7, 700))
    assert {r.session_id for r in got} == {"a-hot"}
    assert all([row[0] for row in r.features] == [9.0 * (r.window_idx - 7 + p) for p in range(8)] for r in got)
    threes = sequences(samples, ["session_id", "window_idx"], seq_len=3, scope="session", bucket=bucket)
    assert threes.count() == 698 + 60 * 3 + 1


def test_caps_and_short_tables(samples):
    order = ["session_id", "window_idx"]
    capped = sequences(samples, order, max_sequences=10)
    assert sorted(r.seq_id for r in capped.collect()) == list(range(10))
    few = samples.where("window_idx < 7")
    assert sequences(few, order).count() == 0
    assert sequences(samples.where("window_idx < 8"), order).count() == 1
    assert sequences(samples.where("false"), order).count() == 0
    assert sequences(samples, order, seq_len=1).count() == 1003


def test_long_form(samples):
    rows = long_form(sequences(samples, ["session_id", "window_idx"], max_sequences=2), ["seq_id"])
    got = {(r.seq_id, r.pos): r.meanVelocity for r in rows.collect()}
    assert got == {(s, p): 9.0 * (s + p) for s in range(2) for p in range(8)}


def test_arguments(samples):
    for bad in ({"scope": "file"}, {"seq_len": 0}, {"bucket": 7}):
        with pytest.raises(ValueError):
            sequences(samples, ["window_idx"], **bad)


def test_session_scope_parts_sources(spark):
    rows = [(rank, tag, "5", k, *[float(rank)] * 9, rank) for rank, tag in enumerate(("CK", "HVT"))
            for k in range(12 if rank else 5)]
    names = ["source_rank", "source", "session_id", "window_idx", *FEATURES, "label"]
    df = spark.createDataFrame(rows, names)
    runs = sequences(df, ["source_rank", "session_id", "window_idx"], scope="session").collect()
    assert len(runs) == 5 and all(r.label == 1 for r in runs)
    assert all(v == 1.0 for r in runs for sample in r.features for v in sample)
    assert sorted(r.seq_id for r in runs) == [5, 6, 7, 8, 9]
