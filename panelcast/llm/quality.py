"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors: one per hashed word, per hashed character n-gram (3 to 5
characters, word edges included) and per repeated three-word window (one shared vector). A softmax layer
turns the average into two class probabilities. Vectors and layer are trained together by plain
stochastic gradient descent in numpy on a bounded sample of labelled rows. Scoring is linear in the
average, so each bucket is reduced to one number before it is sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import blocks, fitted, keep_rows
from panelcast.llm.features import Block, repeats

#: Buckets of hashed features; the last one is the repeated-window feature.
BUCKET_BITS = 17
BUCKETS = (1 << BUCKET_BITS) + 1
DIM = 8
GRAMS = (3, 4, 5)
REPEAT_WORDS = 3
#: Most labelled rows that are read for training (smallest hashes of their ids).
TRAIN_ROWS = 3000
BLOCK_CHARS = 250_000


def bucketed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (bucket, text number) of all features of a block."""
    block = Block.of(texts)
    shift = np.uint64(64 - BUCKET_BITS)
    words, owner = block.words()
    yield (words >> shift).astype(np.int64), owner
    for n in GRAMS:
        grams, gram_owner = block.grams(n)
        yield (grams >> shift).astype(np.int64), gram_owner
    again = repeats(words, owner, REPEAT_WORDS)
    yield np.full(len(again), BUCKETS - 1), again


@dataclass(frozen=True)
class Model:
    """Log-odds of class 1 per unit of each bucket's share, and the constant."""

    weights: np.ndarray
    bias: float


def descend(
    rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 5, rate: float = 0.5, seed: int = 7
) -> Model:
    """Rows are (distinct buckets, counts, label). No rows give a model that scores 0.5."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)) if rows else np.zeros((BUCKETS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps = epochs * max(len(rows), 1)
    done = 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, counts, label = rows[k]
            step = rate * (1 - done / steps)
            done += 1
            share = counts / max(counts.sum(), 1)
            hidden = share @ vectors[at]
            logits = hidden @ layer + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = layer @ wrong
            layer -= step * np.outer(hidden, wrong)
            bias -= 0.1 * step * wrong
            # Shares are small: a feature's own step is scaled up by the number of distinct features.
            vectors[at] -= (step * np.minimum(share * len(at), 5.0))[:, None] * back
    # Scoring is linear in the average: one number per bucket.
    weights = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]))


def train(rows: DataFrame) -> Model:
    """Model of ``training_rows``, trained in one task; the driver receives one number per bucket."""

    def fit(taken: list[dict]) -> Model:
        taken.sort(key=lambda r: (str(r["doc_id"]), r["label"], r["at"]))
        return descend([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.float32), r["label"]) for r in taken])

    return fitted(rows, fit)


def training_rows(
    docs: DataFrame, labels: DataFrame, label_column: str, limit: int = TRAIN_ROWS
) -> DataFrame:
    """Counted features (label, doc_id, at, n) of at most ``limit`` labelled documents.

    ``labels`` has doc_id and the label column; rows with a null in either are skipped. The sample is
    ``limit`` rows at most, so joining it by broadcast is bounded; there is one row for a doc_id and label however
    often documents repeats them.
    """
    chosen = (
        labels.select("doc_id", F.col(label_column).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(limit)
    )
    # Of rows that share a doc_id the text with the least hash is taken, before features, within each task first.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("label", "doc_id").agg(
        F.min(F.struct(F.xxhash64("text"), "text")).alias("least")
    ).select("label", "least.text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text, key in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = np.unique(np.concatenate([b for b, _ in bucketed([text or ""])]), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array([label], pa.int32()), "doc_id": pa.array([key], batch.column(2).type),
                    "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                    "n": pa.array([n.astype(np.float32).tobytes()], pa.binary()),
                })

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"label int, doc_id {kind}, at binary, n binary")


def probability(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 per text."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for at, owner in bucketed(texts):
        total += np.bincount(owner, weights[at], len(texts))
        count += np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per input row: ``doc_id`` and ``score``, the probability of class 1.

    Null and empty texts have no features and get the model's constant. Null ids and repeated rows are
    kept; other columns are dropped. Nothing is shuffled.
    """
    weights, bias = model.weights, model.bias
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in blocks((x.as_py() for x in batch.column(1)), BLOCK_CHARS):
                value = probability(texts, weights, bias)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(texts)), pa.array(value)], names=["doc_id", "score"]
                )
                done += len(texts)

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, cut: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose ``text`` scores ``cut`` or more."""
    weights, bias = model.weights, model.bias
    return keep_rows(docs, lambda texts: probability(texts, weights, bias) >= cut, BLOCK_CHARS)
