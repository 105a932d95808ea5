"""SentencePiece encoding for merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs.

The agenda of a chunk holds every adjacent pair whose join is a piece; the best score leaves it first, the leftmost
of equal scores before the others, and a merge only adds the two pairs beside it. No piece of such a vocabulary
reaches from a letter over a following space mark, so a text is the row of its chunks (space marks and the letters
behind them) and equal chunks have equal ids. Every chunk that the agenda works out is compared with the
sentencepiece library, all new chunks of an Arrow batch in one call; a difference is an error.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from panelcast.llm.common import blocks

#: Texts are worked on in blocks of about so many characters; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
#: Characters of chunks that a worker remembers between blocks; longer chunks than LONG_CHUNK are not remembered.
KNOWN_CHARS, LONG_CHUNK = 8_000_000, 60
#: Chunks of so many characters share a matrix of so many rows; a longer one has a heap of its own.
SHORT_CHUNK, MATRIX_ROWS = 24, 8192
MARK = "▁"
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LEFT = (1 << 32) - 1
_SYMBOL_BITS = 24


@lru_cache(maxsize=2)
def library(path: str) -> SentencePieceProcessor:
    return SentencePieceProcessor(model_file=path)


class Agenda:
    """Encoder of one model file."""

    def __init__(self, path: str):
        self.library = library(path)
        size = self.library.get_piece_size()
        special = {
            i for i in range(size) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)
        }
        plain = {self.library.id_to_piece(i): i for i in range(size) if i not in special}
        if any(self.library.is_unused(i) for i in plain.values()):
            raise ValueError("unused pieces are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in plain):
            raise ValueError("pieces that reach over a space mark are not supported")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(self.library.is_byte, self.bytes)):
            raise ValueError("a piece for every byte is needed")
        scores = {i: self.library.get_score(i) for i in plain.values()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ids = plain
        self.rank = {piece: place[scores[i]] for piece, i in plain.items()}
        self.no_rank, self.size = len(place), size
        self.symbol_of = np.arange(size, size + 0x110000)  # characters without a piece come behind the pieces
        for piece, i in plain.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        joins = sorted(
            (self.symbol(piece[:k]) << _SYMBOL_BITS | self.symbol(piece[k:]), self.rank[piece], i)
            for piece, i in plain.items()
            for k in range(1, len(piece))
            if (k == 1 or piece[:k] in plain) and (k == len(piece) - 1 or piece[k:] in plain)
        )
        self.pair_keys, self.pair_ranks, self.pair_joins = np.array([*joins, (1 << 62, 0, 0)], dtype=np.int64).T.copy()
        self.prefixed = self.library.normalize("a").startswith(MARK)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_chars = 0

    def symbol(self, text: str) -> int:
        return self.ids[text] if text in self.ids else self.size + ord(text)

    def short_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Symbols of many chunks after all merges: one agenda per row of a matrix, the best pair of every row at once."""
        width = max(map(len, chunks)) + 2  # a wall on either side of the symbols
        rows = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)
        first = np.cumsum([0, *(len(c) for c in chunks)])[:-1]
        at = rows * width + 1 + np.arange(len(points)) - first[rows]
        symbols = np.full(len(chunks) * width, -1, dtype=np.int64)
        symbols[at] = self.symbol_of[points]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        agenda, joined = self.pairs(symbols, np.concatenate([symbols[1:], [-1]]))
        table = agenda.reshape(len(chunks), width)
        open_rows = np.arange(len(chunks))
        while len(open_rows):
            column = table[open_rows].argmin(axis=1)  # the leftmost of equal ranks
            left = open_rows * width + column
            going = agenda[left] < self.no_rank
            open_rows, left = open_rows[going], left[going]
            right = after[left]
            beyond, ahead = after[right], before[left]
            merged = joined[left]
            symbols[left], symbols[right], agenda[right] = merged, -1, self.no_rank
            after[left], before[beyond] = beyond, left
            agenda[left], joined[left] = self.pairs(merged, symbols[beyond])
            agenda[ahead], joined[ahead] = self.pairs(symbols[ahead], merged)
        kept = symbols >= 0
        ends = np.cumsum(np.bincount(np.flatnonzero(kept) // width, minlength=len(chunks))).tolist()
        flat = symbols[kept].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of the join of each two symbols; ``no_rank`` where it is no piece or one is a wall."""
        keys = np.where((left < 0) | (right < 0), -1, left << _SYMBOL_BITS | right)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], self.no_rank), self.pair_joins[at]

    def long_chunk(self, chunk: str) -> list[str]:
        """Symbols of one chunk, with a heap as agenda; entries whose pair has changed are passed over."""
        rank_of, n = self.rank.get, len(chunk)
        symbols: list[str | None] = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r << 32 | i for i, r in enumerate(map(rank_of, map(add, chunk, chunk[1:]))) if r is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & _LEFT
            left, j = symbols[i], after[i]
            if left is None or j >= n:
                continue
            merged = left + symbols[j]
            if rank_of(merged) != entry >> 32:
                continue  # one of the two has grown since
            symbols[i], symbols[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank_of(merged + symbols[k])
                if r is not None:
                    heappush(agenda, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank_of(symbols[h] + merged)
                if r is not None:
                    heappush(agenda, r << 32 | h)
        return [x for x in symbols if x is not None]

    def chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks of normalised text; a character without a piece gives its bytes."""
        order = sorted(range(len(chunks)), key=lambda k: len(chunks[k]))
        out: list[list[int]] = [[]] * len(chunks)
        short = bisect_right(order, SHORT_CHUNK, key=lambda k: len(chunks[k]))
        for start in range(0, short, MATRIX_ROWS):
            part = order[start : min(start + MATRIX_ROWS, short)]
            for k, symbols in zip(part, self.short_chunks([chunks[k] for k in part])):
                out[k] = symbols
        for k in order[short:]:
            out[k] = [self.ids.get(x, self.size + ord(x[0])) for x in self.long_chunk(chunks[k])]
        for k, ids in enumerate(out):
            if max(ids) >= self.size:
                out[k] = [i for x in ids for i in ([x] if x < self.size else self.byte_ids(chr(x - self.size)))]
        return out

    def byte_ids(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()]

    def check(self, chunks: list[str], ids: list[list[int]]) -> None:
        """Raises if the library has other ids for one of the chunks."""
        skip = int(self.prefixed)
        given = self.library.encode([c[skip:].replace(MARK, " ") for c in chunks], num_threads=1)
        for chunk, own, other in zip(chunks, ids, given):
            # the mark of a prefix alone has no text that would encode to it
            if own != other and chunk != MARK:
                raise ValueError(f"the sentencepiece library encodes {chunk!r} as {other}, the agenda as {own}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text; an empty text has none."""
        found = [_CHUNKS.findall(x) if x else [] for x in map(self.library.normalize, texts)]
        distinct = set().union(*found)
        now = {c: x for c in distinct if (x := self.young.get(c) or self.old.get(c))}
        fresh = [c for c in distinct if c not in now]
        ids = self.chunks(fresh)
        self.check(fresh, ids)
        now.update((c, array("I", x).tobytes()) for c, x in zip(fresh, ids))
        self.remember({c: x for c, x in now.items() if len(c) <= LONG_CHUNK and c not in self.young})
        get = now.__getitem__
        return [b"".join(map(get, chunks)) for chunks in found]

    def remember(self, chunks: dict[str, bytes]) -> None:
        """Keeps two generations of chunks: what was not met again while the young one filled up is forgotten."""
        added = sum(map(len, chunks))
        if added > KNOWN_CHARS // 2:
            return
        if self.young_chars + added > KNOWN_CHARS // 2:
            self.old, self.young, self.young_chars = self.young, {}, 0
        self.young.update(chunks)
        self.young_chars += added


@lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    """One encoder per worker, so that later tasks find the chunks of earlier ones."""
    return Agenda(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per input row: ``doc_id`` and ``ids`` (array of int), as the library encodes without begin, end or sampling.

    Null and empty texts give an empty array. Null ids and repeated rows are kept as they are, other columns are
    dropped; rows stand alone, nothing is shuffled. ``path``: a BPE model with byte fallback.
    """
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_block = agenda(path).encode
        for batch in batches:
            done = 0
            for block in blocks((x.as_py() for x in batch.column(1)), BLOCK_CHARS):
                packed = encode_block(block)
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                values = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(block)), pa.ListArray.from_arrays(ends, values)],
                    names=["doc_id", "ids"],
                )
                done += len(block)

    return picked.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (string): the text that the library gives for ``ids``. Null ids give null."""
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = library(path).decode
        for batch in batches:
            column = batch.column(at)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            out = [
                decode_ids(values[a:b].tolist()) if valid else None
                for a, b, valid in zip(ends, ends[1:], column.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")
