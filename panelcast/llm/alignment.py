"""Alignment of two tokenizations of the same bytes.

Tokens of both sides that cover the same stretch of bytes form a group; groups end where a token of either side ends.
They are found by divide and conquer: an interval's candidates are the ends of its A tokens, a shared end near the
middle is located by bisecting the ends of either side in turn, and both halves are searched again; an interval in
which no shared end is left is a leaf, one group. All intervals of a block of texts are halved together.

Every A token of a group is linked with every B token of it. How many texts hold an id pair linked is counted over the
whole corpus: blocks of texts bring their distinct pairs, which are counted, joined back and handed to their block.
What a block knows of its texts goes round as one compressed value, so that Spark's rows stay small.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import blocks, stored
from panelcast.llm.subwords import MARK, library

#: Texts share their distinct pairs in blocks of about so many characters; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: So many characters of a block are tokenized and linked at once.
PART_CHARS = 250_000
#: A group with more links is reduced to distinct ids and their counts before its links are formed.
WIDE_GROUP = 4096


@dataclass
class Side:
    """One tokenization: ids of texts and the bytes that each id stands for."""

    token: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(t) for t in self.token], dtype=np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError

    def spells(self, text: str, ids: np.ndarray) -> bool:
        """Whether the tokens of a text are the bytes of space + text."""
        return b"".join(map(self.token.__getitem__, ids.tolist())) == b" " + text.encode()


class ByteSide(Side):
    """A byte-level BPE vocabulary of the tokenizers library whose ids are in merge order, encoded through its ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as lines:
            model = json.load(lines)["model"]
        # Byte-level vocabularies write a byte as a printable character: itself, or the next one from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        rank = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [model["vocab"]["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("ids are not in merge order")
        ranks = {t: i for t, i in rank.items() if i < 256 + len(merges)}
        token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            token[i] = t
        super().__init__(token)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]

    def spells(self, text: str, ids: np.ndarray) -> bool:
        # tokens are consecutive stretches of the text, so only what no pattern matches can be missing
        return int(self.sizes[ids].sum()) == 1 + len(text.encode())


class PieceSide(Side):
    """A SentencePiece vocabulary; its prefix stands for the space before the text."""

    def __init__(self, path: str):
        self.library = library(path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        super().__init__([
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.library.encode(t), dtype=np.int64) for t in texts]

    def spells(self, text: str, ids: np.ndarray) -> bool:
        # with a piece or bytes for every character the tokens are the normalised text
        return self.library.normalize(text).replace(MARK, " ") == " " + text


@lru_cache(maxsize=2)
def sides(byte_path: str, pattern: str, piece_path: str) -> tuple[Side, Side]:
    return ByteSide(byte_path, pattern), PieceSide(piece_path)


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sorted byte offsets at which groups end.

    ``ends_a``, ``ends_b``: increasing ends of all tokens; ``first``, ``last``: index of each text's first and last A
    token. Both sides end together at a text's end, so every text has its last end as a cut.
    """
    # An interval ends with the A token ``top``; its shared ends are still to be sought among [low, high).
    low, high, top = first, last, last
    leaves = []
    while len(low):
        done = low >= high
        leaves.append(top[done])
        low, high, top = low[~done], high[~done], top[~done]
        middle = (low + high) // 2
        at, found = middle.copy(), np.zeros(len(low), dtype=bool)
        seeking = np.arange(len(low))
        while len(seeking):
            end = ends_a[at[seeking]]
            other = ends_b[np.searchsorted(ends_b, end)]
            found[seeking] = other == end
            seeking, other = seeking[other != end], other[other != end]
            at[seeking] = np.searchsorted(ends_a, other)
            seeking = seeking[at[seeking] < high[seeking]]
        # Between the middle and the found end (or the range's end) nothing is shared.
        halves = np.stack((np.ones_like(found), found), axis=1)
        low, high, top = (
            np.stack(pair, axis=1)[halves]  # left and right side by side, so that places stay in order
            for pair in ((low, at + 1), (middle, high), (np.where(found, at, top), top))
        )
    cuts = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
    cuts.sort()
    return ends_a[cuts]


@dataclass
class Aligned:
    """Groups of a block of texts; tokens of all texts in one row, groups given by the index behind their last token."""

    a: np.ndarray
    b: np.ndarray
    text: np.ndarray  # of each group
    to_a: np.ndarray
    to_b: np.ndarray
    n_a: np.ndarray  # per text
    n_b: np.ndarray

    @property
    def from_a(self) -> np.ndarray:
        return np.concatenate(([0], self.to_a[:-1]))

    @property
    def from_b(self) -> np.ndarray:
        return np.concatenate(([0], self.to_b[:-1]))

    @property
    def links(self) -> np.ndarray:
        """Links per group."""
        return (self.to_a - self.from_a) * (self.to_b - self.from_b)


def align(texts: list[str], side_a: Side, side_b: Side) -> Aligned:
    """Tokens and groups of texts; an empty text, or one whose tokens do not spell space + text, has none."""
    ids_a, ids_b = side_a.ids(texts), side_b.ids(texts)
    for k, text in enumerate(texts):
        if not (text and side_a.spells(text, ids_a[k]) and side_b.spells(text, ids_b[k])):
            ids_a[k] = ids_b[k] = np.zeros(0, np.int64)
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(side_a.sizes[a]), np.cumsum(side_b.sizes[b])
    last = np.cumsum(n_a)[n_a > 0] - 1
    cuts = shared_groups(ends_a, ends_b, last + 1 - n_a[n_a > 0], last)
    to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
    return Aligned(a, b, np.searchsorted(np.cumsum(n_a), to_a), to_a, to_b, n_a, n_b)


def spellings(found: Aligned, names: Names) -> list[bytes]:
    """Groups of each text as `a1,a2|b1;a3|b2,b3`; no trailing `;`."""
    if not len(found.to_a):
        return [b""] * len(found.n_a)
    a_ids, b_ids = names.shift
    group_a = np.repeat(np.arange(len(found.to_a)), found.to_a - found.from_a)
    group_b = np.repeat(np.arange(len(found.to_b)), found.to_b - found.from_b)
    place = np.zeros(len(found.a) + len(found.b), dtype=np.int64)
    a, b = found.a.copy(), found.b + 2 * a_ids
    a[found.to_a - 1] += a_ids
    b[found.to_b - 1] += b_ids
    place[np.arange(len(a)) + found.from_b[group_a]] = a
    place[np.arange(len(b)) + found.to_a[group_b]] = b
    letters = names.text[place].view(np.uint8)
    joined = letters[letters != 0].tobytes()
    tokens = np.cumsum(found.n_a + found.n_b)
    ends = np.concatenate(([0], np.cumsum(names.sizes[place])))[np.concatenate(([0], tokens))].tolist()
    return [joined[start : max(start, end - 1)] for start, end in zip(ends, ends[1:])]


class Names:
    """Decimal ids of both sides: A's followed by `,` and again by `|`, then B's followed by `,` and again by `;`."""

    def __init__(self, n_a: int, n_b: int):
        self.shift = (n_a, n_b)
        listed = [f"{i}{c}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for c in ends for i in range(n)]
        self.text = np.array(listed, dtype=np.bytes_)
        self.sizes = np.array([len(x) for x in listed], dtype=np.int64)


def linked_pairs(found: Aligned, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, a * width + b) with its number of links, by text and pair."""
    links = found.links
    wide = np.flatnonzero(links > WIDE_GROUP)
    narrow = np.flatnonzero(links <= WIDE_GROUP)
    group = np.repeat(narrow, links[narrow])
    step = np.arange(len(group)) - np.repeat(np.cumsum(links[narrow]) - links[narrow], links[narrow])
    wide_b = (found.to_b - found.from_b)[group]
    code = found.a[found.from_a[group] + step // wide_b] * width + found.b[found.from_b[group] + step % wide_b]
    text, code, times = [found.text[group]], [code], [np.ones(len(group), np.int64)]
    for g in wide:
        a, n_a = np.unique(found.a[found.from_a[g] : found.to_a[g]], return_counts=True)
        b, n_b = np.unique(found.b[found.from_b[g] : found.to_b[g]], return_counts=True)
        code.append((a[:, None] * width + b[None, :]).ravel())
        times.append((n_a[:, None] * n_b[None, :]).ravel())
        text.append(np.full(len(code[-1]), found.text[g]))
    text, code, times = np.concatenate(text), np.concatenate(code), np.concatenate(times)
    by = np.lexsort((code, text))
    text, code, times = text[by], code[by], times[by]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (code[1:] != code[:-1])))[: len(text)]
    starts = np.flatnonzero(new)
    return text[starts], code[starts], np.add.reduceat(times, starts) if len(starts) else times


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _linked(texts: list[str], side_a: Side, side_b: Side, names: Names) -> tuple[dict, np.ndarray, np.ndarray]:
    """Counts, digest and number of distinct pairs ``n`` of each text; pair and links of each of these, text by text."""
    found = align(texts, side_a, side_b)
    text, code, times = linked_pairs(found, len(side_b.token))
    links = np.zeros(len(texts), np.int64)
    np.add.at(links, found.text, found.links)
    digests = [hashlib.sha256(x).hexdigest() if x else "" for x in spellings(found, names)]
    known = {
        "n_a": found.n_a,
        "n_b": found.n_b,
        "n_groups": np.bincount(found.text, minlength=len(texts)),
        "n_links": links,
        "groups_sha256": np.array(digests, dtype=object),
        "n": np.bincount(text, minlength=len(texts)),
    }
    return known, code, times


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _align_blocks(docs: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """One row per block of texts: its distinct pairs with how many texts hold them; packed, per text its id, counts,
    digest and pairs (index among the block's pairs) with links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(byte_path, pattern, piece_path)
        width = len(side_b.token)
        names = Names(len(side_a.token), width)
        block_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for texts in blocks((x.as_py() for x in batch.column(1)), BLOCK_CHARS):
                parts = [_linked(part, side_a, side_b, names) for part in blocks(texts, PART_CHARS)]
                known = {name: np.concatenate([p[0][name] for p in parts]) for name in parts[0][0]}
                pairs, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
                ends = pa.array(np.concatenate(([0], np.cumsum(known.pop("n")))), pa.int32())
                body = {
                    "doc_id": batch.column(0).slice(done, len(texts)),
                    **{name: pa.array(x) for name, x in known.items()},
                    "pair": pa.ListArray.from_arrays(ends, at.astype(np.int32)),
                    "times": pa.ListArray.from_arrays(ends, np.concatenate([p[2] for p in parts])),
                }
                done += len(texts)
                lists = {
                    "a": (pairs // width).astype(np.int32),
                    "b": (pairs % width).astype(np.int32),
                    "holders": np.bincount(at, minlength=len(pairs)).astype(np.int32),
                }
                columns = [pa.ListArray.from_arrays([0, len(x)], x) for x in lists.values()]
                packed = _packed(pa.RecordBatch.from_pydict(body))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block_id], pa.int64()), pa.array([packed], pa.binary()), *columns],
                    names=["block_id", "body", *lists],
                )
                block_id += 1

    return docs.select("doc_id", "text").mapInArrow(
        run, "block_id bigint, body binary, a array<int>, b array<int>, holders array<int>"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Id pairs with ``count``, how many texts hold them linked, and ``best``: it is the highest of its A id.

    The highest counts are one row per id of A's vocabulary, which bounds what is broadcast.
    """
    pairs = aligned.select(F.inline(F.arrays_zip("a", "b", "holders")))
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("holders").alias("count")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_counts(docs: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """Per input row: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the
    highest count of its A id, ties included), ``count_sum`` (counts over links) and ``groups_sha256``.

    A side: byte-level BPE of space + text; B side: SentencePiece of the text, which adds the space itself. Null and
    empty texts, and texts whose tokens of either side do not spell space + text, have no tokens: zeros and an empty
    digest. Null ids and repeated rows are kept, each row counts as a text of its own; other columns are dropped.

    Blocks of texts are written once. Their distinct pairs are counted by pair, joined back by pair and gathered by
    block: a frequent pair is one row per block, and a block gathers at most its own pairs. Spark sorts these rows by
    block, which can go to disk; only a worker holds a block's pairs together, one block at a time.
    """
    aligned = stored(_align_blocks(docs, byte_path, pattern, piece_path), "aligned")
    asked = aligned.select("block_id", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select(
        "block_id", "at", "p.a", "p.b"
    )
    answers = asked.join(pair_counts(aligned), ["a", "b"]).select("block_id", "at", "count", "best")
    gathered = aligned.select("block_id", "body").unionByName(answers, allowMissingColumns=True)

    def scored(block: pa.Table) -> pa.RecordBatch:
        with pa.ipc.open_stream(block.column("body").drop_null()[0].as_buffer()) as stream:
            rows = stream.read_next_batch()
        at, count, best = (block.column(c).drop_null().to_numpy() for c in ("at", "count", "best"))
        counts, bests = np.zeros((2, len(at)), dtype=np.int64)
        counts[at], bests[at] = count, best
        pair, times = (rows.column(c).values.to_numpy() for c in ("pair", "times"))
        ends = rows.column("pair").offsets.to_numpy()
        sums = (np.concatenate(([0], np.cumsum(times * of[pair])))[ends] for of in (bests, counts))
        return pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in ("doc_id", *_COUNTS)), *(pa.array(np.diff(s)) for s in sums), rows.column("groups_sha256")],
            names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(ids, prepend=ids[:1])).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(ids)]):
                if block and start < end and block[0].column(0)[0].as_py() != ids[start]:
                    yield scored(pa.Table.from_batches(block))
                    block = []
                if start < end:
                    block.append(batch.slice(start, end - start))
        if block:
            yield scored(pa.Table.from_batches(block))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in (*_COUNTS, "n_best", "count_sum"))
    return (
        gathered.repartition("block_id")
        .sortWithinPartitions("block_id")
        .mapInArrow(run, f"doc_id {id_type}, {counts}, groups_sha256 string")
    )
