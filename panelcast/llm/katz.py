"""Language-model scores by a Katz backoff bigram model over all documents.

P(w | h) = d(c(hw)) c(hw) / c(h) for a pair seen in training, alpha(h) P(w) for another, with Good-Turing
discounts d and alpha such that every history sums to one exactly; P(w) = (c(w) + 1) / (N + V + 1). The
history of a text's first token is the end token.

Texts become batches of token numbers with a sorted local vocabulary. Counting and look-up are one exchange:
each batch sends the sorted hashes of its distinct pairs, cut into hash ranges, to the range's count table;
the range adds all batches up and answers in the order of the question. A word, pair or history
therefore reaches a range at most once per batch, however frequent it is, and no table is gathered
anywhere. Words and pairs are known by 64-bit hashes. All sums behind alpha are whole numbers.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import blocks, stored
from panelcast.llm.features import mix

#: Counts up to here are discounted.
CUTOFF = 5
BATCH_CHARS = 8_000_000
#: Keys per hash range that the number of ranges aims at.
RANGE_KEYS = 1_500_000
END = b"\n"  # no word holds white space


def planes(values: np.ndarray) -> bytes:
    """Bytes of whole numbers, most alike bytes together, for the shuffle's compression."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted hashes pass from one of ``ranges`` equal hash ranges to the next."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def tokenise(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


_BATCH = "batch long, ids array<{}>, lengths binary, train binary, vocab binary, tokens binary, n_tokens long"


def batches(docs: DataFrame) -> DataFrame:
    """Token numbers of whole texts in batches; ``docs``: doc_id, text, train (boolean)."""
    picked = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in arrow:
            done = 0
            for texts in blocks((x.as_py() for x in batch.column(1)), BATCH_CHARS):
                # Words are numbered as they come: no list holds all words of a batch.
                place: dict[bytes, int] = defaultdict(itertools.count().__next__)
                numbers = []
                for text in texts:
                    words = tokenise(text)
                    numbers.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                lengths = np.array([len(x) for x in numbers], np.uint32)
                tokens = np.concatenate(numbers)
                del numbers
                digest = xxhash.xxh64_intdigest
                vocab, local = np.unique(np.fromiter(map(digest, place), np.uint64, len(place)), return_inverse=True)
                tokens = local.astype(np.uint32)[tokens]
                flags = np.array(batch.column(2).slice(done, len(texts)).to_pylist(), dtype=np.uint8)
                ids = batch.column(0).slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), ids),
                     *[pa.array([x], pa.binary()) for x in (planes(lengths), flags.tobytes(), pack_keys(vocab), planes(tokens))],
                     pa.array([len(tokens)], pa.int64())],
                    names=["batch", "ids", "lengths", "train", "vocab", "tokens", "n_tokens"],
                )
                number += 1

    return picked.mapInArrow(run, _BATCH.format(kind))


class Batch:
    """One batch unpacked, with its distinct pairs (history, token)."""

    def __init__(self, row):
        self.lengths = from_planes(row.lengths, np.uint32).astype(np.int64)
        self.train = np.frombuffer(row.train, np.uint8).astype(bool)
        self.vocab = unpack_keys(row.vocab)
        self.tokens = from_planes(row.tokens, np.uint32).astype(np.int32)  # 32 bits number any text's tokens
        self.owner = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.learned = self.train[self.owner] if len(self.tokens) else np.zeros(0, bool)

    def pairs(self) -> None:
        """Sets ``keys`` (sorted distinct pair hashes), ``pair`` (per token), ``history`` and ``head`` (per key)."""
        end = int(np.searchsorted(self.vocab, np.uint64(xxhash.xxh64_intdigest(END))))
        history = np.concatenate([np.array([end], np.int32), self.tokens[:-1]]) if len(self.tokens) else self.tokens
        # Words are mixed once each, before they become the histories of pairs.
        hashed = mix(self.vocab)[history]
        hashed += self.vocab[self.tokens]
        hashed = mix(hashed)
        order = np.argsort(hashed, kind="stable").astype(np.int32)
        hashed = hashed[order]
        fresh = np.ones(len(order), bool)
        np.not_equal(hashed[1:], hashed[:-1], out=fresh[1:])
        self.keys, first = hashed[fresh], order[fresh]
        del hashed
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.history, self.head = history[first], self.tokens[first]


_ASK = "batch long, shard int, keys binary, counts binary"


def _asked(batch: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[dict]:
    at = cuts(keys, ranges)
    for s in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[s], at[s + 1])
        yield {"batch": batch, "shard": s, "keys": pack_keys(keys[part]), "counts": planes(counts[part].astype(np.uint32))}


_ASK_ARROW = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def ask(table: DataFrame, ranges: int, pairs: bool) -> DataFrame:
    """Per batch and hash range: sorted keys (words or pairs) and their training counts."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            for row in rows.to_pandas().itertuples():
                one = Batch(row)
                if pairs:
                    one.pairs()
                    keys, at = one.keys, one.pair
                else:
                    keys, at = one.vocab, one.tokens
                counts = np.bincount(at[one.learned], minlength=len(keys))
                yield pa.RecordBatch.from_pylist(list(_asked(row.batch, keys, counts, ranges)), _ASK_ARROW)

    columns = ["batch", "lengths", "train", "vocab", "tokens"]
    return table.select(columns).mapInArrow(run, _ASK)


_ANSWER = "batch long, shard int, counts binary, owned binary, n_of array<long>"


def count(asked: DataFrame) -> DataFrame:
    """The count tables, one per hash range, as answers: totals per asked key and who saw it first in training.

    The row with batch -1 holds the range's statistics: sum of counts, number of keys, keys counted once, twice, ...
    """

    def merge(blocks_of: pd.DataFrame) -> pd.DataFrame:
        blocks_of = blocks_of.sort_values("batch")
        keys = [unpack_keys(k) for k in blocks_of["keys"]]
        counts = [from_planes(c, np.uint32) for c in blocks_of["counts"]]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.concatenate(counts).astype(np.int64)
        total = np.bincount(inverse, every, len(distinct)).astype(np.int64)
        owned = np.zeros(len(inverse), np.uint8)
        seen = np.flatnonzero(every)
        owned[seen[np.unique(inverse[seen], return_index=True)[1]]] = 1
        stats = [int(total.sum()), int((total > 0).sum())] + [int((total == r).sum()) for r in range(1, CUTOFF + 2)]
        rows = [(-1, b"", b"", stats)]
        at = 0
        for batch, k in zip(blocks_of["batch"], keys):
            part = slice(at, at + len(k))
            rows.append((batch, planes(total[inverse[part]].astype(np.uint64)), owned[part].tobytes(), None))
            at += len(k)
        out = pd.DataFrame(rows, columns=["batch", "counts", "owned", "n_of"])
        out.insert(1, "shard", int(blocks_of["shard"].iloc[0]))
        return out

    return asked.groupBy("shard").applyInPandas(merge, _ANSWER)


def statistics(answers: DataFrame) -> list[int]:
    """Sum of counts, keys, keys counted 1 to CUTOFF + 1 times, over all ranges."""
    columns = [F.coalesce(F.sum(F.col("n_of")[k]), F.lit(0)).alias(f"n{k}") for k in range(CUTOFF + 3)]
    return list(answers.where("batch = -1").agg(*columns).first())


def discounts(n_of: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0 to CUTOFF; a factor outside (0, 1) gives way to (r - 1/2) / r."""
    n = [0, *n_of]
    d = np.ones(CUTOFF + 1)
    for r in range(1, CUTOFF + 1):
        d[r] = (r - 0.5) / r
        if n[1] and n[r]:
            tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
            if tail < 1:
                turing = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
                if 0 < turing < 1:
                    d[r] = turing
    return d


def _gather(answers: pd.DataFrame, column: str, kind: type | None) -> np.ndarray:
    parts = answers.sort_values("shard")[column]
    read = (lambda x: from_planes(x, kind)) if kind is not np.uint8 else (lambda x: np.frombuffer(x, np.uint8))
    return np.concatenate([read(x) for x in parts]) if len(parts) else np.zeros(0, kind)


_PART = (
    "batch long, shard int, keys binary, once binary, mass binary, wanted binary, "
    "ids array<{}>, train binary, lengths binary, known binary, base binary, score binary, doc binary, at binary"
)


def _score_known(row, words: pd.DataFrame, pairs: pd.DataFrame, n: int, v: int, d: np.ndarray, ranges: int) -> list[dict]:
    """Everything of a batch but the backoff weights, and the sums that these need from it."""
    one = Batch(row)
    one.pairs()
    c1 = _gather(words, "counts", np.uint64).astype(np.int64)
    c2 = _gather(pairs, "counts", np.uint64).astype(np.int64)
    owned = _gather(pairs, "owned", np.uint8).astype(bool)
    docs = len(one.lengths)
    p1 = np.log10((c1 + 1) / (n + v + 1))
    total = c1[one.history]
    seen = c2 > 0
    # A history none of whose counts is discounted gets one more in its denominator; that is known with its sums.
    per_key = p1[one.head]
    r = c2[seen]
    per_key[seen] = np.log10(np.maximum(d[np.minimum(r, CUTOFF)] * (r <= CUTOFF) + (r > CUTOFF), 1e-300) * r)
    score = np.bincount(one.owner, per_key[one.pair], docs)
    del per_key, r
    base = np.bincount(one.owner, p1[one.tokens], docs)
    known = np.bincount(one.owner, c1[one.tokens] > 0, docs)
    # Per history: continuations counted r times (r to CUTOFF), and the summed counts + 1 of all continuations.
    mine = np.flatnonzero(owned)
    once = np.zeros((len(one.vocab), CUTOFF), np.int64)
    low = mine[c2[mine] <= CUTOFF]
    np.add.at(once, (one.history[low], c2[low] - 1), 1)
    mass = np.zeros(len(one.vocab), np.int64)
    np.add.at(mass, one.history[mine], c1[one.head[mine]] + 1)
    del mine, low, c2, owned
    # Wanted back: log10 of the denominator for seen pairs, of alpha for unseen ones, where the history was counted.
    history = one.history[one.pair]
    needs = total[one.pair] > 0
    doc, at, code = one.owner[needs], history[needs], seen[one.pair][needs]
    del history, needs, seen, total
    one.pair = one.history = one.head = one.keys = one.learned = None
    asked, slot = np.unique(at, return_inverse=True)
    del at
    slot *= 2
    slot += code
    slot += doc * np.int64(2 * len(asked))
    del doc, code
    tally, times = np.unique(slot, return_counts=True)
    del slot
    send = np.unique(np.concatenate([asked, np.flatnonzero(mass)]))
    wanted = np.isin(send, asked)
    keys, count_ = one.vocab[send], c1[send]
    cut = cuts(keys, ranges)
    rows = []
    for s in np.flatnonzero(np.diff(cut)).tolist():
        p = slice(cut[s], cut[s + 1])
        rows.append({
            "shard": s, "keys": pack_keys(keys[p]), "once": planes(once[send[p]].T.ravel().astype(np.uint32)),
            "mass": planes(mass[send[p]]), "wanted": planes(np.where(wanted[p], count_[p], 0)),
        })
    rows.append({
        "shard": -1, "ids": list(row.ids), "train": row.train, "lengths": row.lengths, "known": planes(known.astype(np.uint32)),
        "base": base.tobytes(), "score": score.tobytes(), "doc": planes(tally), "at": planes(times.astype(np.uint32)),
    })
    return [{"batch": row.batch, **r} for r in rows]


def _weights(blocks_of: pd.DataFrame, n: int, v: int, d: np.ndarray) -> pd.DataFrame:
    """Per batch: log10 of the denominator and of alpha for each wanted history of one hash range."""
    keys = [unpack_keys(k) for k in blocks_of["keys"]]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    once = np.zeros((CUTOFF, len(distinct)), np.int64)
    for r in range(CUTOFF):
        part = [from_planes(x, np.uint32).reshape(CUTOFF, -1)[r] for x in blocks_of["once"]]
        once[r] = np.bincount(inverse, np.concatenate(part), len(distinct)).astype(np.int64)
    mass = np.zeros(len(distinct), np.int64)
    np.add.at(mass, inverse, np.concatenate([from_planes(x, np.int64) for x in blocks_of["mass"]]))
    wanted = [from_planes(x, np.int64) for x in blocks_of["wanted"]]
    c = np.zeros(len(distinct), np.int64)
    np.maximum.at(c, inverse, np.concatenate(wanted))
    r = np.arange(1, CUTOFF + 1)
    left = ((1 - d[1:]) * r) @ once
    # Without discounted counts one more in the denominator leaves mass for unseen words.
    left, bottom = np.where(left > 0, left, 1.0), np.where(left > 0, c, c + 1.0)
    rest = (n + v + 1 - mass) / (n + v + 1)  # at least the unknown word's share
    alpha = np.log10(np.maximum(left, 1e-300) / np.maximum(bottom, 1) / rest)
    bottom = np.log10(np.maximum(bottom, 1))
    rows, at = [], 0
    for batch, k, w in zip(blocks_of["batch"], keys, wanted):
        own = inverse[at : at + len(k)][w > 0]
        at += len(k)
        rows.append((batch, int(blocks_of["shard"].iloc[0]), np.stack([alpha[own], bottom[own]], axis=1).tobytes()))
    return pd.DataFrame(rows, columns=["batch", "shard", "weights"])


def score(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    ``docs`` has doc_id, text and train (null: false). A null or empty text consists of the end token. Null ids and
    repeated rows are scored, and counted, like any other row. Without training rows all tokens are unknown.
    An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = stored(batches(docs), "token-batches")
    size = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    ranges = max(1, -(-size // RANGE_KEYS))
    word_counts = stored(count(ask(table, ranges, False)), "word-counts")
    n, v, *_ = statistics(word_counts)
    pair_counts = stored(count(ask(table, ranges, True)), "pair-counts")
    d = discounts(statistics(pair_counts)[2:])

    given = word_counts.withColumn("pairs", F.lit(False)).unionAll(pair_counts.withColumn("pairs", F.lit(True)))
    answers = given.where("batch >= 0").select("batch", "shard", "counts", "owned", "pairs")

    def known_part(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = ["batch", "shard", "keys", "once", "mass", "wanted", "ids", "train", "lengths", "known", "base", "score", "doc", "at"]
        rows: list[dict] = []
        for row in own.itertuples():
            mine = got[got["batch"] == row.batch]
            rows += _score_known(row, mine[~mine["pairs"]], mine[mine["pairs"]], n, v, d, ranges)
        return pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    parts = stored(
        table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(known_part, _PART.format(kind)), "known-parts"
    )
    sums = parts.where("shard >= 0").select("batch", "shard", "keys", "once", "mass", "wanted")
    weights = sums.groupBy("shard").applyInPandas(
        lambda x: _weights(x, n, v, d), "batch long, shard int, weights binary"
    )
    own = parts.where("shard = -1").select("batch", "ids", "train", "lengths", "known", "base", "score", "doc", "at")

    def finish(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            found = got.sort_values("shard")["weights"]
            w = np.frombuffer(b"".join(found), np.float64).reshape(-1, 2)
            tally, times = from_planes(row.doc, np.int64), from_planes(row.at, np.uint32)
            total = np.frombuffer(row.score, np.float64).copy()
            if len(tally):
                doc, rest = np.divmod(tally, 2 * len(w))
                slot, code = np.divmod(rest, 2)
                total += np.bincount(doc, times * np.where(code == 1, -w[slot, 1], w[slot, 0]), len(total))
            out.append(pd.DataFrame({
                "doc_id": row.ids, "train": np.frombuffer(row.train, np.uint8).astype(bool),
                "n_tokens": from_planes(row.lengths, np.uint32).astype(np.int64),
                "n_known": from_planes(row.known, np.uint32).astype(np.int64), "train_tokens": n,
                "base_score": np.frombuffer(row.base, np.float64), "score": total,
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return own.groupBy("batch").cogroup(weights.groupBy("batch")).applyInPandas(
        finish,
        f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
