"""Quality of texts by supervised subword embeddings.

Every word has learned vectors for itself and its character n-grams, in a table
of hashed buckets; a word is their mean and a document the mean of its words. A
softmax over two classes stands on top. All is trained by stochastic gradient
descent in numpy on a bounded sample. A word equal to the one before adds a word
of its own kind, so monotone repetition can be learned.

For scoring, the difference of the two class weights is multiplied into the
table once: a document's logit is then the mean of one number per word.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.llm.common import Memo, labelled_sample, portions, release, texts_of

# At most this many labelled documents are learned from.
SAMPLE_ROWS = 2_500
HELD_OUT = (4, 2)

BUCKETS = 1 << 17
WIDTH = 16
SHORTEST, LONGEST = 2, 4
EPOCHS = 5
BATCH = 32
RATE = 4.0
SEED = 11

REPEATED = b"\x00again"
NOTHING = b"\x00nothing"


def subwords(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks at both ends."""
    marked = f"<{word.decode('utf-8', 'replace')}>"
    grams = [
        marked[i : i + n].encode()
        for n in range(SHORTEST, LONGEST + 1)
        for i in range(len(marked) - n + 1)
    ]
    return [zlib.crc32(g) % BUCKETS for g in (b"\x01" + word, *grams)]


def words_of(text: bytes) -> list[bytes]:
    words = text.split() or [NOTHING]
    again = sum(map(operator.eq, words, words[1:]))
    return words + [REPEATED] * again


def document_buckets(text: bytes, memo: Memo) -> tuple[list[int], list[float]]:
    """Buckets of a document with their weights, which sum to 1."""
    words = words_of(text)
    weights: dict[int, float] = defaultdict(float)
    for word in words:
        ids = memo[word]
        share = 1 / (len(ids) * len(words))
        for b in ids:
            weights[b] += share
    return list(weights), list(weights.values())


@dataclass
class QualityModel:
    """One logit per bucket and a bias: what the trained network adds up to."""

    logits: np.ndarray
    bias: float

    def word_logit(self, word: bytes) -> float:
        return float(self.logits[subwords(word)].mean())

    def scorer(self) -> Memo:
        return Memo(self.word_logit)

    def score(self, text: bytes, memo: Memo) -> float:
        words = words_of(text)
        x = self.bias + sum(map(memo.__getitem__, words)) / len(words)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS
) -> QualityModel:
    """Stochastic gradient descent over documents given as (buckets, weights)."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = np.array([0, math.log(share / (1 - share))], dtype=np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    steps = epochs * -(-len(rows) // BATCH) if len(rows) else 0
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            parts = [rows[i] for i in chosen]
            ids = np.concatenate([b for b, _ in parts])
            share_of = np.concatenate([w for _, w in parts])[:, None]
            sizes = np.array([len(b) for b, _ in parts])
            starts = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(table[ids] * share_of, starts, axis=0)
            logits = hidden @ weights + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            error = (p - target[chosen]) / len(chosen)
            rate = RATE * (1 - done / steps)
            back = error @ weights.T
            change = np.repeat(back, sizes, axis=0) * share_of
            # Documents of a batch share buckets: sum their changes before they count.
            unique, inverse = np.unique(ids, return_inverse=True)
            summed = np.stack(
                [np.bincount(inverse, change[:, k], len(unique)) for k in range(WIDTH)], axis=1
            )
            table[unique] -= rate * BATCH * summed.astype(np.float32)
            weights -= 0.1 * rate * hidden.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            done += 1
    difference = weights[:, 1] - weights[:, 0]
    return QualityModel((table @ difference).astype(np.float64), float(bias[1] - bias[0]))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    fold: tuple[int, int] = HELD_OUT,
    rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    Executors hash the sample's texts; the driver gets bucket weights, at most
    ``BUCKETS`` per document. Without labelled rows every text scores one half.
    """

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(subwords)
        for batch in portions(batches):
            found = [document_buckets(t, memo) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([np.array(b, "<i4").tobytes() for b, _ in found], pa.binary()),
                    pa.array([np.array(w, "<f4").tobytes() for _, w in found], pa.binary()),
                ],
                names=["doc_id", "label", "buckets", "weights"],
            )

    sample = labelled_sample(docs, labels, "quality", fold, rows).select(
        F.col("doc_id").cast("long").alias("doc_id"), "label", "text"
    )
    found = sample.mapInArrow(
        featurize, "doc_id long, label int, buckets binary, weights binary"
    ).collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.buckets)))
    parts = [(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.weights, "<f4")) for r in found]
    return train(parts, np.array([r.label for r in found], dtype=np.int64))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every whole text, map-only.

    Null and empty texts are scored as a word of their own kind. Repeated rows
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


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """Rows whose score is at least ``threshold``, all columns as they were; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        memo = model.scorer()
        for batch in portions(batches):
            keep = [model.score(t, memo) >= threshold for t in texts_of(batch, "text")]
            yield batch.filter(pc.equal(pa.array(keep, type=pa.bool_()), True))

    return docs.mapInArrow(run, docs.schema)
