"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are counts of lower-case words and of their five-character grams (word edges included). One
weight vector is shared by all ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k) with
t_1 < t_2 < ...; the severity of a text is its expected grade, the sum of these probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import blocks, fitted, keep_rows
from panelcast.llm.features import Block

GRAM = 5
#: Most labelled rows of each class that are read for training (smallest hashes of their ids).
TRAIN_TOXIC, TRAIN_CLEAN = 1000, 4000
#: A feature is kept if this share of the toxic training texts (three at least) has it and it is so many times likelier there.
LEAST_SHARE, LEAST_LIFT = 0.008, 10.0
GRADES = 3
FILTER_BITS = 22
BLOCK_CHARS = 250_000


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    block = Block.of([t.lower() for t in texts])
    yield block.words()
    yield block.grams(GRAM)


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted 64-bit feature hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def predict(self, texts: list[str]) -> np.ndarray:
        """P(grade >= k) per text and k."""
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        shift = np.uint64(64 - FILTER_BITS)
        table[self.keys >> shift] = True
        total = np.zeros(len(texts))
        for h, owner in features(texts):
            near = table[h >> shift]
            h, owner = h[near], owner[near]
            if len(h):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                total += np.bincount(owner[hit], self.weights[at[hit]], len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - total[:, None], -500, 500)))


Row = tuple[np.ndarray, np.ndarray, int]  # distinct feature hashes, counts, label or grade


def select(rows: list[Row], toxic: list[bool]) -> np.ndarray:
    """Hashes that occur in enough toxic texts and are far likelier there; sorted."""
    bad = [r[0] for r, t in zip(rows, toxic) if t]
    good = [r[0] for r, t in zip(rows, toxic) if not t]  # counted one by one, not copied together
    if not bad:
        return np.zeros(0, np.uint64)
    keys, n = np.unique(np.concatenate(bad), return_counts=True)
    enough = n >= max(3, LEAST_SHARE * len(bad))
    keys, n = keys[enough], n[enough]
    seen = np.zeros(len(keys))
    for other in good if len(keys) else ():
        at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
        seen[at[keys[at] == other]] += 1
    lift = (n / len(bad)) / ((seen + 0.5) / (len(good) + 1))
    return keys[lift >= LEAST_LIFT]


def matrix(rows: list[Row], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, column, count) of the kept features."""
    r, c, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, (h, n, _) in enumerate(rows):
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            r.append(np.full(hit.sum(), k)), c.append(at[hit]), v.append(n[hit].astype(float))
    return np.concatenate(r), np.concatenate(c), np.concatenate(v)


def grade(rows: list[Row], keys: np.ndarray, levels: int = GRADES) -> list[int]:
    """Grades from 0/1 labels: clean texts 0, toxic ones 1 to ``levels`` by their hits, in equal shares."""
    at, _, n = matrix(rows, keys)
    hits = np.bincount(at, n, len(rows))
    toxic = np.array([bool(r[2]) for r in rows], dtype=bool)
    cuts = np.quantile(hits[toxic], np.arange(1, levels) / levels) if toxic.any() else np.zeros(levels - 1)
    return [int(1 + (cuts < x).sum()) if t else 0 for x, t in zip(hits, toxic)]


def train(rows: list[Row], keys: np.ndarray, levels: int = GRADES, rounds: int = 400, ridge: float = 1e-4) -> Model:
    """Proportional-odds fit by full gradients with momentum scaling (Adam); ``rows`` carry grades.

    No rows or no features give a model of base rates (probability 0 where nothing was seen).
    """
    y = np.array([r[2] for r in rows], dtype=int)
    above = y[:, None] >= np.arange(1, levels + 1)[None, :]
    rates = (above.sum(0) + 0.5) / (len(y) + 1.0 if len(y) else 1e6)
    start = np.log(1 - rates) - np.log(rates)
    w = np.zeros(len(keys))
    # thresholds = first + running sums of exp(gaps), so their order cannot break
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 0.05))
    at, col, n = matrix(rows, keys)
    params = np.concatenate([w, [first], gaps])
    m, s = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1 if len(rows) and len(keys) else 1):
        w, t = params[: len(keys)], params[len(keys)] + np.concatenate([[0], np.cumsum(np.exp(params[len(keys) + 1 :]))])
        z = np.bincount(at, n * w[col], len(rows))
        p = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -500, 500)))
        p = np.concatenate([np.ones((len(y), 1)), p, np.zeros((len(y), 1))], axis=1)
        i = np.arange(len(y))
        mass = np.maximum(p[i, y] - p[i, y + 1], 1e-12)
        slope = p * (1 - p)
        gz = -(slope[i, y] - slope[i, y + 1]) / mass / len(y)
        gt = np.zeros(levels + 2)
        np.add.at(gt, y, slope[i, y] / mass / len(y))
        np.add.at(gt, y + 1, -slope[i, y + 1] / mass / len(y))
        gt = gt[1:-1]
        gw = np.bincount(col, n * gz[at], len(keys)) + ridge * w
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(params[len(keys) + 1 :])])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    t = params[len(keys)] + np.concatenate([[0], np.cumsum(np.exp(params[len(keys) + 1 :]))])
    return Model(keys, params[: len(keys)], t)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counted features (label, doc_id, h, n) of a bounded sample of labelled texts (``labels``: doc_id, toxic).

    Rows with a null in doc_id or toxic are skipped. At most TRAIN_TOXIC + TRAIN_CLEAN rows are chosen, so the
    broadcast join is bounded; there is one row for a doc_id and label.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("label = 1").orderBy(*order).limit(TRAIN_TOXIC).unionAll(
        known.where("label = 0").orderBy(*order).limit(TRAIN_CLEAN)
    )
    # Of rows that share a doc_id the text with the least hash is taken, before features, within each task first.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("label", "doc_id").agg(
        F.min(F.struct(F.xxhash64("text"), "text")).alias("least")
    ).select("label", "least.text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text, key in zip(*(c.to_pylist() for c in batch.columns)):
                h, n = np.unique(np.concatenate([f for f, _ in features([text or ""])]), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array([label], pa.int32()), "doc_id": pa.array([key], batch.column(2).type),
                    "h": pa.array([h.tobytes()], pa.binary()),
                    "n": pa.array([np.minimum(n, 65535).astype(np.uint16).tobytes()], pa.binary()),
                })

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"label int, doc_id {kind}, h binary, n binary")


def fit(rows: DataFrame) -> Model:
    """Selects features, grades the 0/1 labels and fits the ordinal model, all in one task on the bounded sample."""

    def learn(taken: list[dict]) -> Model:
        taken.sort(key=lambda r: (str(r["doc_id"]), r["label"], r["h"]))
        counted = [(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.uint16), r["label"]) for r in taken]
        keys = select(counted, [bool(r[2]) for r in counted])
        return train([(h, n, g) for (h, n, _), g in zip(counted, grade(counted, keys))], keys)

    return fitted(rows, learn)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per input row: ``doc_id``, ``severity`` (expected grade) and ``p_toxic`` = P(grade >= 1).

    Null and empty texts have no feature and get the base rates. Null ids and repeated rows are kept, other
    columns are dropped. Nothing is shuffled.
    """
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in blocks((x.as_py() for x in batch.column(1)), BLOCK_CHARS):
                p = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(texts)), pa.array(p.sum(axis=1)), pa.array(p[:, 0])],
                    names=["doc_id", "severity", "p_toxic"],
                )
                done += len(texts)

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, severity double, p_toxic double")


def keep_clean(docs: DataFrame, model: Model, cut: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose ``text`` has P(grade >= 1) below ``cut``."""
    return keep_rows(docs, lambda texts: model.predict(texts)[:, 0] < cut, BLOCK_CHARS)
