"""Batches, scoring, fitting and evaluation over sequences."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointerloom.operators.skew import materialise, number_rows, table_path, table_scope
from pointerloom.schema import FEATURES, LABELS, SEQ_LEN

# Sizes and training settings of the model (fixed values).
HIDDEN = 32
LAYERS = 2
CLASSES = len(LABELS)
EPOCHS = 5
BATCH_SIZE = 64
LEARNING_RATE = 1e-3
ADAM_MEAN, ADAM_SQUARE, ADAM_LEAST = 0.9, 0.999, 1e-8

# Rows of consecutive batches that one task takes its steps over, larger batches aside.
STEP_ROWS = 65_536
# Rows of sums that one task adds up.
FAN_IN = 64
# Bins a range of values is counted in when a rank is looked for.
BINS = 1024
MOST_DOUBLE = sys.float_info.max

# Limits of a deployed model (fixed values).
SIZE_LIMIT_MB = 20.0
MEAN_LATENCY_LIMIT_MS = 50.0


def shuffled_batches(
    seqs: DataFrame, key: str = "seq_id", epoch: int = 0, seed: int = 0, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Sequences in a random order that ``seed`` and ``epoch`` repeat, as ``batch_id``.

    The order is that of a hash of the key; the last batch may be short.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))
    return (
        number_rows(seqs.withColumn("_draw", draw), ["_draw", key], "_nth")
        .withColumn("batch_id", F.floor(F.col("_nth") / batch_size).cast("long"))
        .withColumn("batch_pos", (F.col("_nth") % batch_size).cast("int"))
        .drop("_draw", "_nth")
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def gru_scores(batch: np.ndarray, weights: dict[str, np.ndarray], layers: int = LAYERS) -> np.ndarray:
    """Class scores of a batch of runs: stacked GRU, last step, linear head.

    ``weights`` holds, per layer ``l``, ``w_ih_l`` and ``w_hh_l`` with ``b_ih_l``
    and ``b_hh_l`` (reset, update and candidate gates stacked), and ``w_out``
    with ``b_out``.
    """
    seen = batch
    for layer in range(layers):
        w_hh, b_hh = weights[f"w_hh_{layer}"], weights[f"b_hh_{layer}"]
        hidden = w_hh.shape[1]
        from_input = seen @ weights[f"w_ih_{layer}"].T + weights[f"b_ih_{layer}"]
        state = np.zeros((len(batch), hidden))
        states = []
        for step in range(batch.shape[1]):
            from_state = state @ w_hh.T + b_hh
            gates = _sigmoid(from_input[:, step, : 2 * hidden] + from_state[:, : 2 * hidden])
            reset, update = gates[:, :hidden], gates[:, hidden:]
            candidate = np.tanh(
                from_input[:, step, 2 * hidden :] + reset * from_state[:, 2 * hidden :]
            )
            state = candidate + update * (state - candidate)
            states.append(state)
        seen = np.stack(states, axis=1)
    return seen[:, -1] @ weights["w_out"].T + weights["b_out"]


def score_sequences(
    seqs: DataFrame, weights: dict[str, np.ndarray], layers: int = LAYERS
) -> DataFrame:
    """Add ``scores`` (one per class) and ``prediction`` to sequences.

    A map-only step over Arrow batches. The weights have a fixed size, about
    eleven thousand numbers, and reach each executor once.
    """
    shared = seqs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value
        for runs in batches:
            if len(runs) == 0:
                yield pd.Series([], dtype=object)
                continue
            flat = np.concatenate([np.concatenate(run) for run in runs]).astype(np.float64)
            scores = gru_scores(flat.reshape(len(runs), -1, len(FEATURES)), held, layers)
            yield pd.Series(list(scores))

    return seqs.withColumn("scores", forward("features")).withColumn(
        "prediction", argmax(F.col("scores"))
    )


def argmax(scores: Column) -> Column:
    """Position of the highest score, the lowest one of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def softmax(scores: Column) -> Column:
    """Class probabilities from scores."""
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)


def log_softmax(scores: Column) -> Column:
    """Logarithms of class probabilities, finite however far scores are apart."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    mass = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(scores, lambda s: s - top - F.ln(mass))


# The least positive double: a probability below it counts as it.
LEAST_PROBABILITY = 5e-324


def epoch_metrics(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Cross-entropy loss and accuracy in percent of scored rows, per ``group``.

    ``scored`` has ``prediction``, ``label`` and ``scores`` or ``probabilities``; scores
    are preferred, as no loss gets lost where a probability vanishes. A label that
    is null or no class is an error. The mean over rows equals the size-weighted
    mean over batches. Combined map-side.
    """
    if "scores" in scored.columns:
        logs = log_softmax(F.col("scores"))
    else:
        least = F.lit(LEAST_PROBABILITY)
        logs = F.transform("probabilities", lambda p: F.ln(F.greatest(p, least)))
    own = F.get(logs, F.col("label").cast("int"))
    loss = -F.coalesce(own, F.raise_error(F.lit("a label is not a class")).cast("double"))
    hit = F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)
    return scored.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"),
        F.coalesce(F.avg(hit) * 100.0, F.lit(0.0)).alias("accuracy"),
    )


def exact_percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Exact percentile with linear interpolation, as one row ``value``.

    Selection by narrowing: each round counts the values of ``BINS`` even bins of the
    range that holds the wanted rank, map-side, and goes on with that bin between its
    least and greatest value, until they are one. The value of the next rank is the least
    one above unless copies reach so far. A round is one scan, whatever the size; counts
    and extremes of ``BINS`` bins pass through the driver. NULL of an empty table; missing
    values are left out.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return df.sparkSession.createDataFrame([(None,)], "value double")
    rank = q * (n - 1)
    first, below, inside = math.floor(rank), 0, n
    while low < high:
        # Halves, as the range of all doubles is not one; infinite ends keep bins of their own.
        bottom, top = max(low, -MOST_DOUBLE), min(high, MOST_DOUBLE)
        share = (F.col("v") / 2 - bottom / 2) / (top / 2 - bottom / 2 or 1.0)
        at = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (BINS - 1)).cast("int")
        at = F.when(F.col("v") == low, -1).when(F.col("v") == high, BINS).otherwise(at)
        counts = (
            values.where(F.col("v").between(F.lit(low), F.lit(high)))
            .groupBy(at.alias("bin"))
            .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()
        )
        for c in sorted(counts):
            inside, low, high = c.n, c.low, c.high
            if first < below + inside:
                break
            below += inside
    value = low
    part = rank - first
    if part and first + 1 >= below + inside:
        above = values.where(F.col("v") > F.lit(value)).agg(F.min("v")).first()[0]
        value += (above - value) * part
    return df.sparkSession.createDataFrame([(value,)], "value double")


def latency_metrics(timings: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Mean and 95th percentile (interpolated) of latencies, as ``metric, value`` rows."""
    mean = timings.agg(F.avg(column).alias("value"))
    p95 = exact_percentile(timings, column, 0.95)
    return mean.select(F.lit("avg_latency_ms").alias("metric"), "value").unionByName(
        p95.select(F.lit("p95_latency_ms").alias("metric"), "value")
    )


def metric_gate(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Check ``metric, value`` rows against upper limits; a value at its limit fails."""
    table = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    return (
        metrics.withColumn("limit", table[F.col("metric")])
        .where(F.col("limit").isNotNull())
        .withColumn("passed", F.coalesce(F.col("value") < F.col("limit"), F.lit(False)))
    )


@dataclass
class Perceptron:
    """One hidden layer of rectified units on a flattened run, with a softmax on top.

    ``parameters`` is one vector: weights and biases of both layers. ``history`` has
    epoch, mean loss and accuracy in percent over the batches as they were trained on.
    """

    inputs: int
    hidden: int
    classes: int
    parameters: np.ndarray
    history: list[tuple[int, float, float]] = field(default_factory=list)

    @classmethod
    def drawn(cls, inputs: int, hidden: int, classes: int, seed: int) -> Perceptron:
        draw = np.random.default_rng(seed)
        first = draw.normal(0, math.sqrt(2 / inputs), inputs * hidden)
        second = draw.normal(0, math.sqrt(1 / hidden), hidden * classes)
        parts = [first, np.zeros(hidden), second, np.zeros(classes)]
        return cls(inputs, hidden, classes, np.concatenate(parts))

    def layers(self, vector: np.ndarray) -> tuple[np.ndarray, ...]:
        """Weights and biases as views of a vector of their size."""
        shapes = [(self.inputs, self.hidden), (self.hidden,), (self.hidden, self.classes), (self.classes,)]
        cuts = np.cumsum([int(np.prod(x)) for x in shapes])[:-1]
        return tuple(v.reshape(x) for v, x in zip(np.split(vector, cuts), shapes))

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers(self.parameters)
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, int]:
        """Summed gradient of the cross-entropy, summed loss, and how many are right."""
        w1, b1, w2, b2 = self.layers(self.parameters)
        inner = np.maximum(x @ w1 + b1, 0)
        scores = inner @ w2 + b2
        scores -= scores.max(axis=1, keepdims=True)
        logs = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
        rows = np.arange(len(y))
        error = np.exp(logs)
        error[rows, y] -= 1
        back = (error @ w2.T) * (inner > 0)
        parts = [x.T @ back, back.sum(axis=0), inner.T @ error, error.sum(axis=0)]
        hits = int((scores.argmax(axis=1) == y).sum())
        return np.concatenate([p.ravel() for p in parts]), float(-logs[rows, y].sum()), hits


@dataclass
class Adam:
    """Steps by running means of gradients and of their squares."""

    rate: float
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def step(self, parameters: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = ADAM_MEAN * self.first + (1 - ADAM_MEAN) * gradient
        self.second = ADAM_SQUARE * self.second + (1 - ADAM_SQUARE) * gradient**2
        mean = self.first / (1 - ADAM_MEAN**self.steps)
        square = self.second / (1 - ADAM_SQUARE**self.steps)
        return parameters - self.rate * mean / (np.sqrt(square) + ADAM_LEAST)


SUMS = "n long, loss double, hits long, gradient binary"
SUM_FIELDS = pa.schema(
    [("n", pa.int64()), ("loss", pa.float64()), ("hits", pa.int64()), ("gradient", pa.binary())]
)


def _sums(n: int, loss: float, hits: int, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [{"n": n, "loss": loss, "hits": hits, "gradient": gradient.tobytes()}], schema=SUM_FIELDS
    )


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _gradients(model: Perceptron):
    """One row per task: sums over its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, hits, total = 0, 0.0, 0, np.zeros_like(model.parameters)
        for batch in batches:
            if batch.num_rows:
                y = batch.column("label").to_numpy()
                gradient, more, right = model.gradient(_flat(batch.column("features"), model.inputs), y)
                n, loss, hits, total = n + len(y), loss + more, hits + right, total + gradient
        yield _sums(n, loss, hits, total)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    if rows:
        total = np.sum([np.frombuffer(r["gradient"]) for r in rows], axis=0)
        yield _sums(*(sum(r[c] for r in rows) for c in ("n", "loss", "hits")), total)


def _summed(runs: DataFrame, model: Perceptron) -> tuple[int, float, int, np.ndarray]:
    """Sums over all runs: of a task's rows in the task, then of tasks in a tree."""
    sums = runs.mapInArrow(_gradients(model), SUMS)
    tasks = runs.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(_added, SUMS)
    rows = sums.collect()
    total = np.sum([np.frombuffer(r.gradient) for r in rows], axis=0)
    return sum(r.n for r in rows), sum(r.loss for r in rows), sum(r.hits for r in rows), total


STATE = "parameters binary, first binary, second binary, steps long, n long, loss double, hits long"


def _walked(model: Perceptron, adam: Adam, batch_size: int):
    """Steps over rows that come batch by batch; one row of what they lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, losses, right = 0, 0.0, 0
        x, y = np.empty((0, model.inputs)), np.empty(0, dtype=np.int64)

        def step(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal n, losses, right
            gradient, loss, hits = model.gradient(x, y)
            model.parameters = adam.step(model.parameters, gradient / len(y))
            n, losses, right = n + len(y), losses + loss, right + hits

        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([x, _flat(batch.column("features"), model.inputs)])
                y = np.concatenate([y, batch.column("label").to_numpy()])
                whole = len(y) - len(y) % batch_size
                for at in range(0, whole, batch_size):
                    step(x[at : at + batch_size], y[at : at + batch_size])
                x, y = x[whole:], y[whole:]
        if len(y):
            step(x, y)
        vectors = {"parameters": model.parameters, "first": adam.first, "second": adam.second}
        state = {name: [v.tobytes()] for name, v in vectors.items()}
        yield pa.RecordBatch.from_pydict(
            {**state, "steps": [adam.steps], "n": [n], "loss": [losses], "hits": [right]}
        )

    return run


def _walk(rows: DataFrame, model: Perceptron, adam: Adam, batch_size: int) -> tuple[int, float, int]:
    """Steps over a slice of an epoch where it lies; the state goes on to the next slice."""
    ordered = rows.coalesce(1).sortWithinPartitions("batch_id", "batch_pos").select("features", "label")
    end = ordered.mapInArrow(_walked(model, adam, batch_size), STATE).first()
    model.parameters, adam.first, adam.second = (
        np.frombuffer(v) for v in (end.parameters, end.first, end.second)
    )
    adam.steps = end.steps
    return end.n, end.loss, end.hits


def fit_classifier(
    seqs: DataFrame,
    seq_len: int = SEQ_LEN,
    hidden: int = HIDDEN,
    epochs: int = EPOCHS,
    batch_size: int = BATCH_SIZE,
    learning_rate: float = LEARNING_RATE,
    seed: int = 0,
) -> Perceptron:
    """Train a classifier of runs by synchronous mini-batch gradient steps.

    This is not a recurrent network but a perceptron on the ``seq_len * 9`` values. Each
    epoch is dealt into the batches of ``shuffled_batches``, written in slices of whole
    batches, ``STEP_ROWS`` rows or one batch. Steps follow each other by nature: a task takes
    those over its slice and hands parameters and Adam's state, a few thousand numbers, on to
    the next by way of the driver. A batch of more rows is a slice, and a step then sums its
    gradient where the rows lie. Results depend on the seed, not on partitions. The tables of an
    epoch go when it ends. An empty table leaves the drawn parameters and no history.
    """
    spark = seqs.sparkSession
    model = Perceptron.drawn(seq_len * len(FEATURES), hidden, CLASSES, seed)
    adam = Adam(learning_rate, np.zeros_like(model.parameters), np.zeros_like(model.parameters))
    runs = materialise(seqs.select("seq_id", "features", F.col("label").cast("long").alias("label")))
    per_slice = max(1, STEP_ROWS // batch_size)
    for epoch in range(1, epochs + 1):
        seen, losses, right = 0, 0.0, 0
        with table_scope(spark):
            path = table_path(spark, "batches")
            batches = shuffled_batches(runs, epoch=epoch, seed=seed, batch_size=batch_size)
            sliced = batches.withColumn("slice", F.floor(F.col("batch_id") / per_slice).cast("long"))
            if batch_size <= STEP_ROWS:
                sliced = sliced.repartition("slice")
            columns = ["features", "label", "batch_id", "batch_pos", "slice"]
            sliced.select(*columns).write.partitionBy("slice").parquet(path)
            last = spark.read.parquet(path).agg(F.max("slice")).first()[0] if not runs.isEmpty() else None
            for k in range(-1 if last is None else last + 1):
                rows = spark.read.schema(
                    "features array<array<double>>, label long, batch_id long, batch_pos int"
                ).parquet(f"{path}/slice={k}")
                if batch_size <= STEP_ROWS:
                    n, loss, hits = _walk(rows, model, adam, batch_size)
                else:
                    n, loss, hits, gradient = _summed(rows.select("features", "label"), model)
                    model.parameters = adam.step(model.parameters, gradient / n)
                seen, losses, right = seen + n, losses + loss, right + hits
        if seen:
            model.history.append((epoch, losses / seen, 100.0 * right / seen))
    return model


def loss_history(model: Perceptron, like: DataFrame) -> DataFrame:
    """Mean loss and accuracy in percent of each epoch (``iteration``, from 1)."""
    return like.sparkSession.createDataFrame(
        model.history, "iteration int, loss double, accuracy double"
    )


def predict(model: Perceptron, seqs: DataFrame) -> DataFrame:
    """Add ``scores``, ``probabilities`` and ``prediction`` of a trained classifier; map-only."""

    @F.pandas_udf("array<double>")
    def forward(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        flat = np.concatenate([np.concatenate(run) for run in features]).astype(np.float64)
        return pd.Series(list(model.scores(flat.reshape(len(features), -1))))

    scored = seqs.withColumn("scores", forward("features"))
    return scored.withColumns(
        {"probabilities": softmax(F.col("scores")), "prediction": argmax(F.col("scores"))}
    )
