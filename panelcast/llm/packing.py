"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Texts become token pieces of at most one sequence; pieces are dealt evenly into blocks. For every block
several islands evolve packings whose genes are whole bins: crossover injects well-filled bins of one
parent into the other, drops the bins that hold one of their pieces and best-fits the displaced pieces.
After the first round each island's elite migrates to the next island. Bins that a block leaves poorly
filled are opened again and packed together with those of other blocks.
"""

from __future__ import annotations

import json
import random
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import blocks, stored

CAPACITY = 2048
#: Id that closes every document.
END = 0
BLOCK_PIECES = 8192
ISLANDS = 2
POPULATION = 4
GENERATIONS = 12
#: Bins filled less than this share are opened again and packed across blocks.
WELL_FILLED = 0.995
#: A level that leaves more than this share of its pieces in poor bins will not be bettered by another one.
STALLED = 0.75
#: Levels that the sign-free bits of a sequence_id can tell apart; the last one keeps all its bins.
LEVELS = 31
BLOCK_CHARS = 2_000_000
#: Words that a worker remembers, at most twice as many: those of late and those of before.
CACHE_WORDS = 200_000


#: How the vocabulary file splits texts, and what that comes to for words of printable ASCII and accented Latin letters,
#: which lower-casing alone normalises.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-z\u00e0-\u00f6\u00f8-\u00ff"
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall
_LATIN = re.compile(f"[\x21-\x7e{_LETTERS}]+").fullmatch
#: Longer parts of words are merged by the library.
PART_BYTES = 24
#: Parts that are merged together.
ROWS = 4096
#: Bytes as the characters by which byte-level vocabularies write them: printable ones stand for themselves.
_PRINTED = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
_WRITTEN = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The ASCII-lower-cased words of all texts, dictionary-encoded, and how many each text has.

    A full stop or comma that closes a plain word is a word of its own.
    """
    joined = np.frombuffer(b"".join([t + b" " for t in texts]).lower(), np.uint8)
    space = _IS_SPACE[joined]
    stop = np.flatnonzero((joined[1:-1] == 44) | (joined[1:-1] == 46)) + 1
    before = joined[stop - 1]
    stop = stop[(before >= 97) & (before <= 122) & space[stop + 1]]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    first[stop] = last[stop - 1] = True
    starts = np.flatnonzero(first)
    offsets = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined[~space])]
    )
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, ends), prepend=0)


class Merges:
    """The merges of a byte-level vocabulary file, applied to many parts of words at once as rows of a matrix."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[vocab[left] << 32 | vocab[right]] = rank, vocab[left + right]
        self.pairs = np.array(sorted(ranks), np.int64)
        found = np.array([ranks[k] for k in self.pairs.tolist()], np.int32).reshape(-1, 2)
        self.ranks, self.made = found[:, 0], np.zeros(len(model["merges"]), np.int32)
        self.made[self.ranks] = found[:, 1]
        written = [chr(_WRITTEN.get(b, b)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in written], np.int32)
        self.last = np.array([vocab[c + end] for c in written], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.NONE)

    def apply(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after another, and how many each has. In each round every part does its first merge."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        width = int(sizes.max(initial=0)) + 1
        out = np.full((len(parts), width), -1, np.int32)
        out[np.arange(width) < sizes[:, None]] = self.inner[data]
        out[np.arange(len(parts)), sizes - 1] = self.last[data[np.cumsum(sizes) - 1]]
        order = np.argsort(sizes)
        for some in range(0, len(order), ROWS):
            who = order[some : some + ROWS]
            self._merge(out[:, : int(sizes[who[-1]]) + 1], who)
        return out[out >= 0], (out >= 0).sum(axis=1)

    def _merge(self, out: np.ndarray, who: np.ndarray) -> None:
        rows = out[who]
        # A pair is known by the place of its left member; the last place of a row is empty.
        ranks = np.full(rows.shape, self.NONE)
        ranks[:, :-1] = self.rank(rows[:, :-1], rows[:, 1:])
        place = np.arange(rows.shape[1] - 1)
        while len(who):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(who)), at]
            more = best < self.NONE
            out[who[~more]] = rows[~more]
            rows, ranks, who, at, best = rows[more], ranks[more], who[more], at[more], best[more]
            k, behind = np.arange(len(who)), place > at[:, None]
            for table, empty in ((rows, -1), (ranks, self.NONE)):
                np.copyto(table[:, :-1], table[:, 1:].copy(), where=behind)
                table[:, -1] = empty
            rows[k, at] = self.made[best]
            ranks[k, at] = self.rank(rows[k, at], rows[k, at + 1])
            before = np.flatnonzero(at)
            ranks[before, at[before] - 1] = self.rank(rows[before, at[before] - 1], rows[before, at[before]])


class WordTokenizer:
    """Encodes texts with a file of the ``tokenizers`` library, remembering what stands between white space.

    The vocabulary drops white space before its merges, so the ids of a text are those of its
    parts between ASCII white space, one after another. If the file splits as expected, words of Latin letters and
    ASCII signs go straight to the merges, all other words through the library's whole chain.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, steps = given["model"], (given.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in odd)
        plain = plain and steps[0].get("pattern") == {"Regex": _SPLIT} and model["merges"]
        plain = plain and all(chr(_WRITTEN.get(b, b)) + x in model["vocab"] for b in range(256) for x in ("", model["end_of_word_suffix"]))
        self.merges = Merges(model) if plain else None
        #: Strings that the library looks for before anything else.
        added = [re.escape(t["content"].lower()) for t in given["added_tokens"]]
        self.added = re.compile("|".join(added)).search if added else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def parts(self, word: bytes) -> list[bytes]:
        """What the merges work on, or nothing where that is left to the library."""
        if word.isalpha():
            return [word] if len(word) <= PART_BYTES else []
        low = word.decode().lower()
        if not _LATIN(low) or self.added and self.added(low):
            return []
        found = [part.encode() for part in _PARTS(low)]
        return found if max(map(len, found)) <= PART_BYTES else []

    def learn(self, words: list[bytes]) -> None:
        split = [self.parts(w) if self.merges else [] for w in words]
        merged = [w for w, found in zip(words, split) if found]
        other = [w for w, found in zip(words, split) if not found]
        if merged:
            ids, n = self.merges.apply([part for found in split for part in found])
            data, ends = ids.tobytes(), np.cumsum(4 * n)[np.cumsum([len(found) for found in split if found]) - 1].tolist()
            self.known.update((w, data[a:b]) for w, a, b in zip(merged, [0, *ends], ends))
        for k in range(0, len(other), 2_000):
            part = other[k : k + 2_000]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, encoded))

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. Words not met for long are forgotten."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        missed = [k for k, ids in enumerate(found) if ids is None]
        again = {w: ids for w in map(words.__getitem__, missed) if (ids := self.older.get(w)) is not None}
        self.known.update(again)
        self.learn([words[k] for k in missed if words[k] not in again])
        for k in missed:
            found[k] = self.known[words[k]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words, counts = split_words([t.encode("utf-8", "replace") for t in texts])
        number = words.indices.to_numpy()
        found = self.look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # The ids of all words, one after another: each word's stretch of the distinct words' ids.
        n = size[number]
        ends = np.cumsum(n)
        shift = (np.cumsum(size) - size)[number] - (ends - n)
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(n.sum()) + np.repeat(shift, n)].tobytes()
        cut = 4 * np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker, so that later tasks find the words of earlier ones."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces: ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (binary, little-endian 32-bit).

    A document's ids end with END; only documents longer than ``capacity`` are cut. Null and empty texts
    consist of END alone. Null ids and repeated rows are packed like any other row; other columns are dropped.
    """
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = array("I", [END]).tobytes()
        for batch in batches:
            done = 0
            for texts in blocks((x.as_py() for x in batch.column(1)), BLOCK_CHARS):
                owner, piece, start, length, parts = [], [], [], [], []
                for k, ids in enumerate(word_tokenizer(path).encode(texts)):
                    ids += end
                    for n, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        owner.append(done + k), piece.append(n), start.append(a // 4)
                        length.append(len(part) // 4), parts.append(part)
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(parts, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


Bins = list[list[int]]


def best_fit(bins: Bins, loads: list[int], items: list[int], lengths: list[int], capacity: int) -> None:
    """Puts each item into the fullest bin that takes it, or into a new one."""
    room: dict[int, list[int]] = {}
    for k, load in enumerate(loads):
        room.setdefault(capacity - load, []).append(k)
    order = sorted(room)
    for item in items:
        need = lengths[item]
        at = bisect_left(order, need)
        if at < len(order):
            left = order[at]
            k = room[left].pop()
            if not room[left]:
                del room[left], order[at]
            bins[k].append(item)
        else:
            k, left = len(bins), capacity
            bins.append([item])
            loads.append(0)
        loads[k] += need
        left -= need
        if left in room:
            room[left].append(k)
        else:
            room[left] = [k]
            insort(order, left)


def fitness(loads: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean squared fill."""
    return -len(loads), sum((x / capacity) ** 2 for x in loads) / max(len(loads), 1)


def crossover(a: Bins, b: Bins, lengths: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """Child of two packings: whole bins of ``b`` among the bins of ``a``."""
    load = lambda bin_: sum(lengths[i] for i in bin_)
    ranked = sorted(b, key=load, reverse=True)
    full = ranked[: max(1, len(ranked) // 2)]
    injected = [list(x) for x in full if rng.random() < 0.5]
    inside = {i for x in injected for i in x}
    child, displaced = injected, []
    for bin_ in a:
        if inside.isdisjoint(bin_):
            child.append(list(bin_))
        else:
            displaced += [i for i in bin_ if i not in inside]
    # The emptiest bin of what was kept is opened too, so that it can dissolve.
    if len(child) > 1:
        worst = min(range(len(child)), key=lambda k: load(child[k]))
        displaced += child.pop(worst)
    displaced.sort(key=lambda i: (-lengths[i], rng.random()))
    loads = [load(x) for x in child]
    best_fit(child, loads, displaced, lengths, capacity)
    return child, loads


def evolve(
    lengths: list[int], capacity: int, seed: int, guests: list[Bins] = (), generations: int = GENERATIONS
) -> Bins:
    """Best packing an island finds; it stops early at the bound of total length over capacity."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    people: list[tuple[tuple[int, float], Bins]] = []

    def add(bins: Bins, loads: list[int]) -> bool:
        people.append((fitness(loads, capacity), bins))
        people.sort(key=lambda p: p[0], reverse=True)
        del people[POPULATION:]
        return len(loads) <= least

    for bins in guests:
        if add(bins, [sum(lengths[i] for i in x) for x in bins]):
            return people[0][1]
    for k in range(POPULATION):
        noise = 0.0 if k == 0 else 0.05 * k
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 - noise * rng.random()))
        bins: Bins = []
        loads: list[int] = []
        best_fit(bins, loads, order, lengths, capacity)
        if add(bins, loads):
            return people[0][1]
    for _ in range(generations):
        for _ in range(POPULATION):
            (_, a), (_, b) = rng.sample(people, 2) if len(people) > 1 else (people[0], people[0])
            if add(*crossover(a, b, lengths, capacity, rng)):
                return people[0][1]
    return people[0][1]


def _pack_level(items: DataFrame, capacity: int, islands: int) -> DataFrame:
    """(block, item, bin, offset, load, emptiest) for ``items`` (block, item, length), items unique per table.

    ``emptiest`` marks the pieces of one bin per block, the one with the least load.
    """
    dealt = items.select("block", "item", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elite = "block int, island int, bins int, spread double, place binary"

    def ordered(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(["length", "item"], ascending=[False, True])

    def as_row(block: int, island: int, bins: Bins, lengths: list[int]) -> pd.DataFrame:
        place = np.zeros(len(lengths), dtype="<i4")
        for k, members in enumerate(bins):
            place[members] = k
        score = fitness([sum(lengths[i] for i in x) for x in bins], capacity)
        return pd.DataFrame({"block": [block], "island": [island], "bins": [len(bins)], "spread": [score[1]], "place": [place.tobytes()]})

    def as_bins(place: bytes) -> Bins:
        at = np.frombuffer(place, "<i4")
        bins: Bins = [[] for _ in range(int(at.max()) + 1 if len(at) else 0)]
        for i, k in enumerate(at.tolist()):
            bins[k].append(i)
        return bins

    def settle(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        lengths = ordered(own)["length"].tolist()
        return as_row(*key, evolve(lengths, capacity, int(key[1])), lengths)

    def meet(key: tuple, own: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        lengths = ordered(own)["length"].tolist()
        known = [as_bins(p) for p in guests.sort_values("island")["place"]]
        return as_row(*key, evolve(lengths, capacity, int(key[1]) + islands, known), lengths)

    def lay_out(key: tuple, own: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        own = ordered(own)
        own["bin"] = np.frombuffer(best["place"].iloc[0], "<i4")
        own = own.sort_values(["bin", "length", "item"], ascending=[True, False, True])
        sums = own.groupby("bin")["length"]
        own["offset"] = sums.cumsum() - own["length"]
        own["load"] = sums.transform("sum")
        own["emptiest"] = own["bin"] == own["bin"].iloc[int(own["load"].to_numpy().argmin())]
        return own[["block", "item", "bin", "offset", "load", "emptiest"]]

    first = stored(dealt.groupBy("block", "island").applyInPandas(settle, elite), "elites")
    moved = first.withColumn("island", (F.col("island") + 1) % islands)
    second = dealt.groupBy("block", "island").cogroup(
        first.unionByName(moved).withColumn("home", F.col("island")).groupBy("block", "island")
    ).applyInPandas(meet, elite)
    best = second.groupBy("block").agg(
        F.min_by("place", F.struct("bins", -F.col("spread"), "island")).alias("place")
    )
    return items.select("block", "item", "length").groupBy("block").cogroup(best.groupBy("block")).applyInPandas(
        lay_out, "block int, item long, bin int, offset long, load long, emptiest boolean"
    )


def pack(
    rows: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0) to every piece (column ``length``, at most ``capacity``).

    Full pieces are sequences of their own. Blocks hold about ``block_pieces`` pieces, dealt by row number,
    so no id or length can make one block large. Bins that stay poor whatever they are mixed with are sequences too:
    a level that leaves most of its pieces in such bins keeps them, and only the emptiest of each block is packed
    again. An empty table gives an empty result.
    """
    table = stored(rows.withColumn("item", F.monotonically_increasing_id()), "pieces")
    columns = [F.col(c) for c in rows.columns]
    full = table.where(F.col("length") >= capacity).select(
        *columns, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    left = table.where(F.col("length") < capacity).select("item", "length")
    done: list[DataFrame] = []
    level = 1
    while True:
        count, total = left.agg(F.count("*"), F.sum("length")).first()
        if not count:
            break
        # Blocks of tiny pieces still get the tokens of several sequences.
        parts = max(1, min(round(count / block_pieces), total // (4 * capacity)))
        deal = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(parts)).cast("int")
        placed = stored(_pack_level(left.withColumn("block", deal), capacity, islands), "packed")
        last = parts == 1 or level == LEVELS
        opened = F.lit(False) if last else F.col("load") < WELL_FILLED * capacity
        # Where poor bins hold most pieces, mixing blocks again gains little: their bins stay, but for the last of each block.
        if not last and placed.where(opened).count() > STALLED * count:
            opened = opened & F.col("emptiest")
        number = F.lit(level << 58) + F.col("block").cast("long") * (1 << 26) + F.col("bin")
        done.append(placed.where(~opened).select("item", number.alias("sequence_id"), "offset"))
        if last:
            break
        left = stored(left.join(placed.where(opened).select("item"), "item", "left_semi"), "left-over")
        level += 1
    if not done:
        return full
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionAll(part)
    return full.unionAll(table.join(placed, "item").select(*columns, "sequence_id", "offset"))
