"""Toxic passages by maximum-scoring segments over token log-odds.

Log-odds of words between toxic and clean documents have a Dirichlet prior that
follows the whole sample; words too rare to tell fall back on the log-odds of
their first letters. A constant is taken off every word, so clean text drifts
down and a passage of toxic words stands out as a segment. One linear scan finds
all maximal segments. How likely clean text of that length is to hold a segment
so high follows the extreme-value law: its rate is K * n * exp(-lambda * score),
with lambda and K fitted on clean documents. A document's evidence is the sum over its
significant segments, and a logistic curve turns it into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.llm.common import Memo, labelled_sample, portions, release, texts_of

# At most this many labelled documents are learned from.
SAMPLE_ROWS = 24_000
# One in so many of these calibrates, the others give the log-odds.
CALIBRATION_SHARE = 4
HELD_OUT = (5, 0)

PRIOR_TOTAL = 500.0
SIGNIFICANT_Z = 1.96
LEAD_BYTES = 4
DRIFT = 0.5
MOST = 8.0
PUNCTUATION = b".,;:!?\"'()[]{}<>*-_|%$&#"


def token_of(chunk: bytes) -> bytes:
    """A word without case and outer punctuation."""
    return chunk.decode("utf-8", "replace").lower().encode().strip(PUNCTUATION)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum), by one scan over the scores.

    A list of disjoint candidates is kept, each with the running sum before it
    and at its end. A new positive score either stands alone, or joins back to
    the last candidate that began lower and ended no higher. Each candidate knows
    the last one before it that began lower, so none is passed over twice.
    """
    total = np.cumsum(scores)
    held: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        first, low, high = i, float(total[i] - scores[i]), float(total[i])
        k = len(held) - 1
        while True:
            # Candidates that began at or above this one cannot be joined to it.
            while k >= 0 and held[k][2] >= low:
                k = held[k][4]
            if k < 0 or held[k][3] >= high:
                break
            first, low, under = held[k][0], held[k][2], held[k][4]
            del held[k:]
            k = under
        held.append((first, i + 1, low, high, k))
    return [(a, b, high - low) for a, b, low, high, _ in held]


def log_odds(counts: dict, toxic: float, clean: float) -> dict:
    """Log-odds with their z scores of ``key -> (toxic, clean)`` counts.

    The prior of a key is its share of both classes together, worth
    ``PRIOR_TOTAL`` words in all.
    """
    out, n = {}, toxic + clean
    for key, (y1, y0) in counts.items():
        a = PRIOR_TOTAL * (y1 + y0) / n
        o1 = math.log((y1 + a) / (toxic + PRIOR_TOTAL - y1 - a))
        o0 = math.log((y0 + a) / (clean + PRIOR_TOTAL - y0 - a))
        out[key] = (o1 - o0, (o1 - o0) / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)))
    return out


@dataclass
class ToxicModel:
    """Scores of significant words and word beginnings, and the calibration."""

    words: dict[bytes, float] = field(default_factory=dict)
    leads: dict[bytes, float] = field(default_factory=dict)
    decay: float = 1.0
    rate: float = 1e-3
    slope: float = 1.0
    offset: float = -3.0

    def word_score(self, chunk: bytes) -> float:
        token = token_of(chunk)
        score = self.words.get(token)
        if score is None:
            score = self.leads.get(token[:LEAD_BYTES], 0.0)
        return min(score, MOST) - DRIFT

    def scorer(self) -> Memo:
        return Memo(self.word_score)

    def segments(self, text: bytes, memo: Memo) -> tuple[int, list[tuple[int, int, float]]]:
        chunks = text.split()
        scores = np.fromiter(map(memo.__getitem__, chunks), dtype=np.float64, count=len(chunks))
        return len(chunks), maximal_segments(scores)

    def passages(self, text: bytes, memo: Memo) -> list[tuple[int, int, float, float]]:
        """Significant segments: first word, end, score, expected number by chance."""
        n, found = self.segments(text, memo)
        rated = [(a, b, s, self.rate * n * math.exp(-self.decay * s)) for a, b, s in found]
        return [r for r in rated if r[3] < 1]

    def evidence(self, text: bytes, memo: Memo) -> float:
        """Sum of -ln(expected number) over the significant segments."""
        return sum(-math.log(max(e, 1e-300)) for *_, e in self.passages(text, memo))

    def score(self, text: bytes, memo: Memo) -> float:
        x = self.offset + self.slope * math.log1p(self.evidence(text, memo))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def fit_decay(scores: Counter) -> float:
    """The positive root of sum p * exp(t * s) = 1 for the word scores of clean text."""
    values = np.array(list(scores), dtype=np.float64)
    shares = np.array(list(scores.values()), dtype=np.float64)
    shares /= shares.sum()
    low, high = 0.0, 1.0
    while (shares * np.exp(high * values)).sum() < 1 and high < 32:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(mid * values)).sum() < 1 else (low, mid)
    return high


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull to (1, -1)."""
    w, prior = np.array([1.0, -1.0]), np.array([1.0, -1.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + 0.05 * (w - prior)
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word beginnings of a partition of the sample, by class."""
    counts: dict[tuple[bytes, bool], list[int]] = {}
    clean = Memo(token_of)
    for batch in portions(batches):
        labels = batch.column("label").to_pylist()
        for label, text in zip(labels, texts_of(batch, "text")):
            for chunk, n in Counter(text.split()).items():
                token = clean[chunk]
                for key in ((token, False), (token[:LEAD_BYTES], True)):
                    counts.setdefault(key, [0, 0])[1 - label] += n
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in keys], type=pa.binary()),
            pa.array([lead for _, lead in keys], type=pa.bool_()),
            pa.array([counts[k][0] for k in keys], type=pa.int64()),
            pa.array([counts[k][1] for k in keys], type=pa.int64()),
        ],
        names=["token", "is_lead", "toxic", "clean"],
    )


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    fold: tuple[int, int] = HELD_OUT,
    rows: int = SAMPLE_ROWS,
) -> ToxicModel:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    Counts are made and summed by Spark; the driver gets words that stand out.
    Without labelled rows of both classes the model finds nothing toxic.
    """
    sample = labelled_sample(docs, labels, "toxic", fold, rows)
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATION_SHARE))
    counts = (
        sample.where(part != 0)
        .select("label", "text")
        .mapInArrow(_count_words, "token binary, is_lead boolean, toxic long, clean long")
        .groupBy("token", "is_lead")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .persist()
    )
    n1, n0 = counts.where("not is_lead").agg(F.sum("toxic"), F.sum("clean")).first()
    model = ToxicModel()
    if not n1 or not n0:
        counts.unpersist()
        return model
    # Only what is more common in toxic text, relative to its size, can score.
    likely = counts.where(F.col("toxic") * n0 > F.col("clean") * n1).where("toxic >= 2").collect()
    counts.unpersist()
    for target, lead in ((model.words, False), (model.leads, True)):
        table = {bytes(r.token): (r.toxic, r.clean) for r in likely if r.is_lead is lead}
        for key, (delta, z) in log_odds(table, n1, n0).items():
            if z > SIGNIFICANT_Z and delta > DRIFT and key:
                target[key] = delta
    return _calibrate(model, sample.where(part == 0).select("label", "text"))


def _calibrate(model: ToxicModel, sample: DataFrame) -> ToxicModel:
    """Fit the law of clean segments, then the curve from evidence to probability."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        memo = model.scorer()
        for batch in portions(batches):
            rows = []
            for label, text in zip(batch.column("label").to_pylist(), texts_of(batch, "text")):
                n, found = model.segments(text, memo)
                words = Counter(round(memo[c], 2) for c in text.split())
                rows.append(
                    {
                        "label": label,
                        "n": n,
                        "segments": [s for *_, s in found],
                        "values": list(words),
                        "times": list(words.values()),
                    }
                )
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema(
                    [
                        ("label", pa.int32()),
                        ("n", pa.int64()),
                        ("segments", pa.list_(pa.float64())),
                        ("values", pa.list_(pa.float64())),
                        ("times", pa.list_(pa.int64())),
                    ]
                ),
            )

    schema = "label int, n long, segments array<double>, values array<double>, times array<long>"
    rows = sample.mapInArrow(measure, schema).collect()
    clean = [r for r in rows if r.label == 0]
    words = Counter({-DRIFT: 1.0, MOST - DRIFT: 1e-6})
    for r in clean:
        for v, t in zip(r["values"], r.times):
            words[v] += t
    model.decay = fit_decay(words)
    heights = np.array([s for r in clean for s in r.segments] or [0.0])
    length = max(1, sum(r.n for r in clean))
    # Mean number of segments per word that clean text holds, carried back to height 0.
    model.rate = (0.5 + float(np.exp(model.decay * np.minimum(heights, MOST)).sum())) / length
    model.rate = min(1.0, max(model.rate, 1e-6))
    x, y = [], []
    for r in rows:
        rated = [model.rate * r.n * math.exp(-model.decay * s) for s in r.segments]
        x.append(math.log1p(sum(-math.log(max(e, 1e-300)) for e in rated if e < 1)))
        y.append(r.label)
    model.slope, model.offset = fit_logistic(np.array(x), np.array(y, dtype=np.float64))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score`` of every whole text, map-only.

    Null and empty texts hold no segment and get the lowest score. Repeated rows
    and null ids are rows like any other; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        memo = model.scorer()
        for batch in portions(batches):
            scores = [model.score(t, memo) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, type=pa.float64())],
                names=["doc_id", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double")


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Significant passages: ``doc_id, first_word, end_word, score, expected, passage``."""
    names = ["doc_id", "first_word", "end_word", "score", "expected", "passage"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        memo = model.scorer()
        for batch in portions(batches):
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                for a, b, s, e in model.passages(text, memo):
                    words = b" ".join(text.split()[a:b]).decode("utf-8", "replace")
                    rows.append((key, a, b, s, e, words))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    schema = "doc_id long, first_word long, end_word long, score double, expected double"
    return rows.mapInArrow(run, schema + ", passage string")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """Rows whose score is below ``threshold``, all columns as they were; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        memo = model.scorer()
        for batch in portions(batches):
            keep = [model.score(t, memo) < threshold for t in texts_of(batch, "text")]
            yield batch.filter(pc.equal(pa.array(keep, type=pa.bool_()), True))

    return docs.mapInArrow(run, docs.schema)
