"""Near duplicates by SimHash fingerprints, searched with BK-trees.

Equal fingerprints collapse first. The distinct ones are dealt to shards by the pigeonhole rule: of six
blocks of bits at most four can differ between fingerprints within the radius, so any linked pair agrees
on two whole blocks and meets in the shard of those two. Each shard is one BK-tree: children are keyed by
their Hamming distance to the parent, and a search follows only edges within the radius. Shard trees
travel with their shard's rows through the shuffle instead of by broadcast, because the set of all
fingerprints has no size bound. A shard returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import stored
from panelcast.llm.graph import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
#: Nodes of a subtree that are kept as one leaf.
LEAF = 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the four-word shingles (repeats count); 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        at = [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(at, at[SHINGLE:])]
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per input row: ``doc_id``, ``fp`` (the fingerprint as a signed 64-bit number).

    Null texts count as empty and, like empty ones, get 0. Null ids and repeated rows are kept, other
    columns are dropped.
    """
    picked = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((fingerprint(x.as_py()) for x in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """BK-tree over distinct fingerprints, built and searched for many queries at once."""

    def __init__(self, points: np.ndarray, at: np.ndarray | None = None):
        self.at = np.arange(len(points)) if at is None else at
        self.points = points
        self.children: list[tuple[int, BKTree]] = []
        if len(self.at) > LEAF:
            rest = self.at[1:]
            far = np.bitwise_count(points[rest] ^ points[self.at[0]])
            self.at = self.at[:1]
            for d in np.unique(far):
                self.children.append((int(d), BKTree(points, rest[far == d])))

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, queries within the radius) for every node that a query reaches; both index ``points``."""
        for k in self.at:
            far = np.bitwise_count(self.points[queries] ^ self.points[k])
            near = queries[far <= radius]
            if len(near) > 1:
                yield int(k), near
        if self.children:
            far = far.astype(np.int16)
            for d, child in self.children:
                down = queries[np.abs(far - d) <= radius]
                if len(down):
                    yield from child.links(down, radius)


def spanning_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what lies within the radius, one less than the members of each group."""
    label = np.arange(len(points))
    bits = points.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    for k, near in BKTree(bits).links(np.arange(len(points)), radius):
        seen = np.unique(label[near])
        if len(seen) > 1 or seen[0] != label[k]:
            seen = np.union1d(seen, label[k : k + 1])
            label[np.isin(label, seen)] = seen[0]
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def shard_links(distinct: DataFrame, radius: int = RADIUS, parts: int = BLOCKS) -> DataFrame:
    """Links (u, v) that span all pairs of ``distinct.fp`` within the radius. Exact for parts > radius."""
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))).alias("k"))
        for t, c in enumerate(combinations(range(parts), parts - radius))
    ]
    dealt = (
        distinct.select("fp", F.explode(F.array(*keys)).alias("s"))
        .select("s.t", "s.k", "fp")
        .repartition("t", "k")
        .sortWithinPartitions("t", "k", "fp")
    )

    def links_of(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(t)]])
        found = [spanning_links(fp[a:b], radius) for a, b in zip(starts, stops) if b - a > 1]
        u = np.concatenate([x for x, _ in found]) if found else fp[:0]
        v = np.concatenate([x for _, x in found]) if found else fp[:0]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            rest = [np.concatenate(x) for x in zip(rest, now)] if rest else now
            t, k, fp = rest
            if not len(t):
                continue
            last = int(np.flatnonzero((t == t[-1]) & (k == k[-1]))[0])
            if last:
                yield links_of(t[:last], k[:last], fp[:last])
                rest = [t[last:], k[last:], fp[last:]]
        if rest and len(rest[0]):
            yield links_of(*rest)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per input row: ``doc_id``, ``fp``, ``component_id`` (the least doc_id that links reach, its own included).

    Equal fingerprints link, texts without words (null, empty) among each other too. A row without doc_id
    gets the least id of its component, or null. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = stored(components(shard_links(distinct, radius)), "roots")
    linked = distinct.join(roots, F.col("fp") == F.col("node"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.select("fp", "root").join(ids, "root").select("fp", "component_id")
    # Stored, so that the last join stands alone and a very frequent fingerprint can be split over many tasks.
    named = stored(
        distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named"
    )
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (all columns) with one document of each near-duplicate group: the least doc_id.

    Rows that repeat a doc_id count once. Rows without doc_id cannot stand for a group: they are kept.
    """
    known = docs.where("doc_id IS NOT NULL")
    keep = near_duplicates(known, radius).where("doc_id = component_id").select("doc_id").distinct()
    return known.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionAll(
        docs.where("doc_id IS NULL")
    )
