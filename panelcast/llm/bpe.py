"""Byte-level BPE by corpus-level merge replay.

A block of texts is one small corpus: its distinct pre-tokens are laid out in one array of byte tokens,
an inverted index leads from each mergeable pair to its positions, and the merges are replayed over the
whole array in rank order. A merge only touches the two pairs beside it.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import blocks

#: Texts are worked on in blocks of about so many characters; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Known pre-tokens that a worker keeps between blocks.
CACHE_WORDS = 720_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def replay_merges(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of each word after every merge, lowest rank first and leftmost first within a word."""
    single = [bytes([b]) for b in range(256)]
    wall = b"\xff" * 9  # between words; never part of a token, so no pair reaches across it
    pieces: list[bytes | None] = [wall]
    ends: list[int] = []
    for word in words:
        if word in ranks:
            pieces.append(word)
        else:
            pieces += [single[b] for b in word]
        ends.append(len(pieces))
        pieces.append(wall)
    n = len(pieces)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_of = ranks.get
    index: dict[int, list[int]] = {}
    for p, rank in enumerate(map(rank_of, map(bytes.__add__, pieces, pieces[1:]))):
        if rank is not None:
            if rank in index:
                index[rank].append(p)
            else:
                index[rank] = [p]
    queue = list(index)
    heapq.heapify(queue)

    def note(rank: int, position: int) -> None:
        if rank in index:
            index[rank].append(position)
        else:
            index[rank] = [position]
            heapq.heappush(queue, rank)

    while queue:
        rank = heapq.heappop(queue)
        positions = index.pop(rank)
        positions.sort()
        waiting = -1  # end of a word in which a lower rank has come up meanwhile
        for p in positions:
            left = pieces[p]
            if left is None:
                continue
            q = after[p]
            merged = left + pieces[q]
            if rank_of(merged) != rank:
                continue
            if p < waiting:
                note(rank, p)
                continue
            pieces[p], pieces[q] = merged, None
            r, o = after[q], before[p]
            after[p], before[r] = r, p
            lower = False
            new = rank_of(merged + pieces[r])
            if new is not None:
                note(new, p)
                lower = new < rank
            new = rank_of(pieces[o] + merged)
            if new is not None:
                note(new, o)
                lower = lower or new < rank
            if lower:
                while pieces[r] is not wall:
                    r = after[r]
                waiting = r
    out, start = [], 1
    for end in ends:
        out.append([ranks[x] for x in pieces[start:end] if x is not None])
        start = end + 1
    return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker, so that later tasks find the words of earlier ones."""
    return Encoder(path, pattern)


class Encoder:
    """Encodes blocks of texts to packed little-endian ids; keeps a bounded memory of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, block: list[str]) -> list[bytes]:
        found = [self.find(text) for text in block]
        distinct = set().union(*found)
        fresh = [w for w in distinct if w not in self.known]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = list(distinct)
        ids = replay_merges([w.encode("utf-8", "replace") for w in fresh], self.ranks)
        self.known.update((w, array("I", x).tobytes()) for w, x in zip(fresh, ids))
        packed = self.known.__getitem__
        return [b"".join(map(packed, tokens)) for tokens in found]


def encode(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per input row: ``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit ids).

    Null and empty texts give no ids. Null ids and repeated rows are kept as they are, other columns are
    dropped; rows stand alone, nothing is shuffled. ``path``: ranks file; ``pattern``: pre-token pattern.
    """
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_block = encoder(path, pattern).encode
        for batch in batches:
            done = 0
            for block in blocks((x.as_py() for x in batch.column(1)), BLOCK_CHARS):
                ids = batch.column(0).slice(done, len(block))
                done += len(block)
                packed = pa.array(encode_block(block), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, packed], names=["doc_id", "ids"])

    return picked.mapInArrow(run, f"doc_id {id_type}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that ``ids`` stand for. Null ids give null."""
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b""] * (max(load_ranks(path).values()) + 1)
        for piece, rank in load_ranks(path).items():
            table[rank] = piece
        piece = table.__getitem__
        for batch in batches:
            out = [
                None if x is None else b"".join(map(piece, array("I", x)))
                for x in (v.as_py() for v in batch.column(at))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
