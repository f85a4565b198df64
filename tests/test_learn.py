import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointerloom.operators import explore, learn
from pointerloom.plans.queries import formula_weights
from pointerloom.schema import FEATURES, SAMPLE_COLUMNS


def scalar_gru(run, weights, layers):
    """Scores of one run, a number at a time."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    seen = [list(map(float, step)) for step in run]
    for layer in range(layers):
        wi, wh = weights[f"w_ih_{layer}"], weights[f"w_hh_{layer}"]
        bi, bh = weights[f"b_ih_{layer}"], weights[f"b_hh_{layer}"]
        size = wh.shape[1]
        state, states = [0.0] * size, []
        for x in seen:
            i = [sum(w * v for w, v in zip(wi[r], x)) + bi[r] for r in range(3 * size)]
            h = [sum(w * v for w, v in zip(wh[r], state)) + bh[r] for r in range(3 * size)]
            reset = [sigmoid(i[k] + h[k]) for k in range(size)]
            update = [sigmoid(i[size + k] + h[size + k]) for k in range(size)]
            new = [math.tanh(i[2 * size + k] + reset[k] * h[2 * size + k]) for k in range(size)]
            state = [(1 - z) * n + z * s for z, n, s in zip(update, new, state)]
            states.append(state)
        seen = states
    return [sum(w * v for w, v in zip(row, seen[-1])) + b for row, b in zip(weights["w_out"], weights["b_out"])]


@pytest.fixture(scope="module")
def runs(spark):
    rng = random.Random(4)
    rows = [
        (i, [[rng.random() for _ in FEATURES] for _ in range(8)], rng.randrange(6)) for i in range(150)
    ]
    return spark.createDataFrame(rows, "seq_id long, features array<array<float>>, label int").cache()


def test_recurrent_scores(runs):
    weights = formula_weights()
    assert sum(w.size for w in weights.values()) == 10_662
    scored = learn.score_sequences(runs.repartition(5), weights).collect()
    assert len(scored) == 150
    for r in scored[:20]:
        want = scalar_gru(r.features, weights, learn.LAYERS)
        assert r.scores == pytest.approx(want, abs=1e-9)
        assert r.prediction == int(np.argmax(want))
    assert learn.score_sequences(runs.where("false"), weights).count() == 0


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    assert df.select(learn.argmax(F.col("s"))).first()[0] == 1


def test_softmax_of_large_scores(spark):
    df = spark.createDataFrame([([1000.0, 999.0],)], "s array<double>")
    p = df.select(learn.softmax(F.col("s"))).first()[0]
    assert p == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.e)])


def test_epoch_metrics(spark):
    rows = [(0, [0.5, 0.5], 0, 1), (0, [0.25, 0.75], 0, 1), (1, [0.9, 0.1], 1, 1)]
    df = spark.createDataFrame(rows, "label int, probabilities array<double>, prediction int, epoch int")
    r = learn.epoch_metrics(df, ["epoch"]).first()
    assert r.n == 3 and r.accuracy == 100.0
    assert r.loss == pytest.approx(-(math.log(0.5) + math.log(0.25) + math.log(0.1)) / 3)
    empty = learn.epoch_metrics(df.where("false")).first()
    assert (empty.n, empty.loss, empty.accuracy) == (0, 0.0, 0.0)


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 10.0], [5.0], [float(i * 7919 % 10007) for i in range(4000)],
    [1.0] * 3000 + [2.0] * 100 + [float(i) for i in range(900)],
])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentile(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    assert learn.exact_percentile(df, "x", q).first().value == pytest.approx(np.percentile(values, q * 100))


def test_percentile_of_nothing(spark):
    assert learn.exact_percentile(spark.createDataFrame([], "x double"), "x", 0.95).first().value is None


def test_gate(spark):
    metrics = spark.createDataFrame(
        [("avg_latency_ms", 50.0), ("file_size_mb", 19.9), ("p95_latency_ms", 70.0)], "metric string, value double"
    )
    limits = {"file_size_mb": learn.SIZE_LIMIT_MB, "avg_latency_ms": learn.MEAN_LATENCY_LIMIT_MS}
    got = {r.metric: r.passed for r in learn.metric_gate(metrics, limits).collect()}
    assert got == {"avg_latency_ms": False, "file_size_mb": True}


def test_shuffled_batches(runs):
    def draw(**parameters):
        rows = learn.shuffled_batches(runs.select("seq_id"), **parameters).collect()
        return [r.seq_id for r in sorted(rows, key=lambda r: (r.batch_id, r.batch_pos))], rows

    first, rows = draw(seed=1)
    assert sorted(first) == list(range(150)) and first != sorted(first)
    assert {b: sum(r.batch_id == b for r in rows) for b in (0, 1, 2)} == {0: 64, 1: 64, 2: 22}
    assert draw(seed=1)[0] == first
    assert draw(seed=1, epoch=1)[0] != first and draw(seed=2)[0] != first


def test_fit_and_predict(runs):
    easy = runs.withColumn("label", F.when(F.element_at("features", -1)[0] > 0.5, 1).otherwise(0))
    model = learn.fit_classifier(easy, epochs=12, learning_rate=0.02, seed=3)
    losses = [r.loss for r in learn.loss_history(model, easy).orderBy("iteration").collect()]
    assert len(losses) > 2 and losses[-1] < losses[0]
    scored = learn.predict(model, easy)
    metrics = learn.epoch_metrics(scored).first()
    assert metrics.n == 150 and metrics.accuracy > 90.0
    assert all(len(r.probabilities) == 6 for r in scored.limit(3).collect())


def test_steps_do_not_depend_on_partitions(runs):
    def history(df, **given):
        return learn.fit_classifier(df, epochs=2, batch_size=50, seed=5, **given).history

    one, eight = history(runs.coalesce(1)), history(runs.repartition(8))
    assert [e for e, *_ in one] == [1, 2]
    assert one == [(e, pytest.approx(loss, abs=1e-9), pytest.approx(a)) for e, loss, a in eight]
    assert abs(history(runs, learning_rate=0.05)[1][1] - one[1][1]) > 1e-3
    assert learn.fit_classifier(runs.limit(0), epochs=1).history == []


def test_many_steps_in_few_jobs(spark, runs, monkeypatch):
    """A job per slice of batches, not per batch; slices and large batches give the same steps."""
    history = lambda: learn.fit_classifier(runs, epochs=2, batch_size=10, seed=5).history
    spark.sparkContext.setJobGroup("fit", "fit")
    one = history()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 2 * 15
    for rows in (20, 5):  # two batches a slice; a batch is more than a slice
        monkeypatch.setattr(learn, "STEP_ROWS", rows)
        assert one == [(e, pytest.approx(loss, abs=1e-9), pytest.approx(a)) for e, loss, a in history()]


def test_gradient_like_differences():
    draw = np.random.default_rng(4)
    model = learn.Perceptron.drawn(12, 5, 6, seed=1)
    x, y = draw.normal(size=(7, 12)), draw.integers(0, 6, 7)
    gradient, loss, hits = model.gradient(x, y)
    assert hits == int((model.scores(x).argmax(axis=1) == y).sum())
    for k in draw.choice(len(gradient), 25, replace=False):
        near = []
        for step in (1e-6, -1e-6):
            moved = learn.Perceptron(12, 5, 6, model.parameters.copy())
            moved.parameters[k] += step
            near.append(moved.gradient(x, y)[1])
        assert gradient[k] == pytest.approx((near[0] - near[1]) / 2e-6, abs=1e-5)


def test_sums_in_a_tree(runs, monkeypatch):
    model = learn.Perceptron.drawn(72, 4, 6, seed=2)
    rows = runs.select("features", F.col("label").cast("long").alias("label")).repartition(7)
    flat = learn._summed(rows, model)
    monkeypatch.setattr(learn, "FAN_IN", 2)
    tree = learn._summed(rows, model)
    assert flat[0] == tree[0] == 150 and flat[2] == tree[2]
    assert np.allclose(flat[3], tree[3]) and flat[1] == pytest.approx(tree[1])


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        f = rng.random(9)
        f[3] = rng.integers(0, 4) / 10
        f[4] = 0.25
        if i % 50 == 0:
            f[1] = math.nan
        rows.append(("CK", f"s{i % 7}", i, None, None, *map(float, f), 0))
    rows += [("HMI", "h", i, None, None, 1.0, *([0.0] * 8), 1) for i in range(100)]
    kinds = {"source": "string", "session_id": "string", "window_idx": "long", "label": "int"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in SAMPLE_COLUMNS)).cache()


def test_counts(samples):
    assert {r.source: r.n_samples for r in explore.source_counts(samples).collect()} == {
        "CK": 400, "HVT": 0, "HMI": 100, "AP": 0}


def test_correlation(samples):
    want = samples.toPandas()[list(FEATURES)].corr()
    got = {(r.feature_a, r.feature_b): r.corr for r in explore.feature_corr(samples).collect()}
    assert len(got) == 81
    for a in FEATURES:
        for b in FEATURES:
            assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    constant = explore.feature_corr(samples.where("source = 'CK'"))
    assert {r.corr for r in constant.where(F.col("feature_a") == FEATURES[4]).collect()} == {None}


def test_density(samples):
    rows = explore.feature_density(samples).collect()
    assert {(r.source, r.feature) for r in rows} == {("CK", "meanVelocity"), ("CK", "hesitationCount")}
    for feature in ("meanVelocity", "hesitationCount"):
        v = np.array([r[feature] for r in samples.where("source = 'CK'").collect()])
        h = v.std(ddof=1) * len(v) ** -0.2
        mine = sorted((r.x, r.density) for r in rows if r.feature == feature)
        assert len(mine) == 200
        assert mine[0][0] == pytest.approx(v.min() - 3 * h) and mine[-1][0] == pytest.approx(v.max() + 3 * h)
        for x, d in mine[::20]:
            assert d == pytest.approx(np.exp(-0.5 * ((x - v) / h) ** 2).sum() / len(v) / h / math.sqrt(2 * math.pi))
        x, d = np.array(mine).T
        assert np.trapezoid(d, x) == pytest.approx(1.0, abs=0.01)


def test_range(samples):
    got = {(r.source, r.feature): r for r in explore.feature_range(samples).collect()}
    assert len(got) == 18
    r = got["CK", "maxVelocity"]
    assert r.n_missing == 8 and 0 <= r.lowest < r.highest < 1
    assert got["HMI", "meanVelocity"].share_at_1 == 1.0 and got["HMI", "dwellTimeMs"].share_at_0 == 1.0


def test_loss_of_vanished_probabilities(spark):
    rows = [([0.0, 1000.0], 0, 1), ([0.0, 1000.0], 1, 1)]
    df = spark.createDataFrame(rows, "scores array<double>, label int, prediction int")
    r = learn.epoch_metrics(df).first()
    assert (r.n, r.loss, r.accuracy) == (2, 500.0, 50.0)
    with pytest.raises(Exception, match="not a class"):
        learn.epoch_metrics(df.selectExpr("scores", "7 as label", "prediction")).collect()
