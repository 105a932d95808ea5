"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a text are ranked by doubling, which works on only those words whose window still occurs twice. The
longest common prefixes (LCP) of neighbours in that order are the edges: by decreasing LCP they unite classes of
suffixes in a union-find whose classes carry their positions in order. Two positions that become neighbours in a
class at a distance within the LCP begin a stretch that repeats itself with that distance as period; such seeds are
the runs. Work on a block of texts is arrays of its words; only windows that recur reach the union-find.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import blocks

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts are worked on in blocks of about so many characters; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000


def suffix_order(words: np.ndarray, text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions whose ``depth``-word window (a power of two) occurs again in their text, in suffix order, and the
    ranks of all positions by windows of ``depth``, 2 ``depth``, ... words.

    ``words`` are numbers; every text ends in a wall, a number that no other text or word has. The rank of a position
    is the first place of its class of equal windows, so a class of one keeps its rank from then on.
    """
    n = len(words)
    key = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int32)
    rank[order] = _class_starts(key[order][1:] != key[order][:-1])
    order = order[_shared(rank[order])]
    levels = []
    width = 1
    while len(order):
        if width >= depth:
            if width == depth:
                members = order
            levels.append((width, rank))
        # members of one class, ordered by the class of what follows their window
        begin, follow = rank[order], rank[order + width]
        by = np.lexsort((follow, begin))
        order, begin, follow = order[by], begin[by], follow[by]
        class_at = _class_starts(begin[1:] != begin[:-1])
        inner = _class_starts((begin[1:] != begin[:-1]) | (follow[1:] != follow[:-1]))
        rank = rank.copy()
        rank[order] = begin + (inner - class_at)
        order = order[_shared(rank[order])]
        width *= 2
    if not levels:
        return order, levels
    return members[np.argsort(rank[members], kind="stable")], levels


def _class_starts(new: np.ndarray) -> np.ndarray:
    """Index of the first member of each row's class; ``new`` tells rows that differ from the one before."""
    starts = np.concatenate(([0], np.flatnonzero(new) + 1))
    return np.repeat(starts, np.diff(np.concatenate((starts, [len(new) + 1])))).astype(np.int32)


def _shared(ranks: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ranks`` stand more than once."""
    same = ranks[1:] == ranks[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same))


def common_prefixes(words: np.ndarray, left: np.ndarray, right: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Number of equal words from each two positions on; only values from the least level on are complete."""
    length = np.zeros(len(left), dtype=np.int64)
    for width, rank in reversed(levels):
        # a window that reaches over its text's wall is unlike all others, so places stay inside
        length += width * (rank[left + length] == rank[right + length])
    equal = length >= levels[0][0]
    for _ in range(levels[0][0]):
        equal = equal & (words[np.where(equal, left + length, 0)] == words[np.where(equal, right + length, 0)])
        if not equal.any():
            break
        length += equal
    return length


def seeds(left: list[int], right: list[int], length: list[int]) -> Iterator[tuple[int, int, int]]:
    """(position, distance, LCP) of positions that become neighbours in a class at a distance within the LCP.

    The edges come by decreasing LCP. Classes carry sorted positions; the smaller class goes into the larger one.
    """
    leader: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        root = leader.setdefault(x, x)
        while leader[root] != root:
            root = leader[root]
        while leader[x] != root:
            leader[x], x = root, leader[x]
        return root

    for a, b, lcp in zip(left, right, length):
        a, b = find(a), find(b)
        small, large = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(small) > len(large):
            small, large, a, b = large, small, b, a
        leader[a] = b
        places = [bisect_left(large, x) for x in small]
        for k, (x, at) in enumerate(zip(small, places)):
            if at and (not k or places[k - 1] < at) and x - large[at - 1] <= lcp:
                yield large[at - 1], x - large[at - 1], lcp
            if at < len(large) and (k + 1 == len(small) or places[k + 1] > at) and large[at] - x <= lcp:
                yield x, large[at] - x, lcp
        if len(small) == 1:
            large.insert(places[0], small[0])
        else:
            large += small
            large.sort()  # two sorted rows: one merge
        members[b] = large


def find_runs(
    texts: list[list], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> list[list[tuple[int, int, int]]]:
    """Per text (a list of words) its runs (start, length, period), by start and period.

    A run is a stretch with smallest period q, of at least ``least_words`` words and ``least_periods`` (two or more)
    times q, that no neighbouring word extends.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    joined = [w for t in texts for w in (*t, None)]
    codes = pa.array(joined, pa.binary() if any(isinstance(w, bytes) for w in joined) else pa.string()).dictionary_encode()
    words = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    walls = first + sizes - 1
    words[walls] = len(codes.dictionary) + np.arange(len(texts))
    # length + distance >= least_words and distance <= length / (least_periods - 1)
    least_lcp = max(1, -(-least_words * (least_periods - 1) // least_periods))
    depth = 1 << (least_lcp.bit_length() - 1)
    order, levels = suffix_order(words, text, depth)
    if not len(order):
        return found
    left, right = order[:-1], order[1:]
    inside = text[left] == text[right]
    left, right = left[inside], right[inside]
    length = common_prefixes(words, left, right, levels)
    enough = length >= least_lcp
    left, right, length = left[enough], right[enough], length[enough]
    by = np.argsort(-length, kind="stable")
    runs: dict[tuple[int, int], int] = {}
    for at, period, lcp in seeds(left[by].tolist(), right[by].tolist(), length[by].tolist()):
        total = lcp + period
        if total < least_words or total < least_periods * period:
            continue
        begin = int(first[text[at]])
        if at > begin and words[at - 1] == words[at - 1 + period]:
            continue  # the same stretch begins further left, where it has a seed too
        # Neighbours for a moment within one LCP give a multiple of the period of the same stretch.
        if runs.get((at, total), period) >= period:
            runs[at, total] = period
    for (at, total), period in runs.items():
        found[text[at]].append((at - int(first[text[at]]), total, period))
    for each in found:
        each.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def detect(
    docs: DataFrame, edit: Callable[[object, list[bytes]], list[bytes]] | None = None, id_column: str = "doc_id",
    text_column: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """Per input row: ``doc_id``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed``
    (the words that no run holds after its first period, joined by one space).

    Null, empty and blank texts have no words, no run and an empty ``collapsed``. Null ids and repeated rows are kept
    as they are, other columns are dropped; rows stand alone, nothing is shuffled. ``edit`` may change the words (UTF-8
    bytes) of a row, given with its id, before the search.
    """
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in blocks((x.as_py() for x in batch.column(1)), BLOCK_CHARS):
                ids = batch.column(0).slice(done, len(block))
                done += len(block)
                # bytes split at space and tab to carriage return, and at nothing else
                texts = [t.encode().split() for t in block]
                if edit:
                    texts = [edit(i, w) for i, w in zip(ids.to_pylist(), texts)]
                runs = find_runs(texts, least_words, least_periods)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in each] for each in runs]
                kept = [b" ".join(collapse(w, r)) for w, r in zip(texts, runs)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(rows, pa.list_(triple)), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    return picked.mapInArrow(
        run, f"doc_id {id_type}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
