"""Operators of the training-data subpackage: brute force, round trips, held-out accuracy and odd inputs."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panelcast.llm import (
    bpe, katz, linededup, packing, quality, queries, rules, simhash, spotsigs, toxicity, warc,
)
from panelcast.llm.graph import components

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
CLASHES = "score fp key row gone line_no tokens item block sequence_id n_lines u v node root".split()
EDGES = [
    (1, LINE), (2, None), (3, ""), (None, LINE), (None, None), (4, LINE), (4, LINE), (5, LONG), (6, " \t\n\x0b\r "),
    (7, "word"), (8, LINE + "\n" + LINE + "\nThe end."), (9, "é ñ <|endoftext|> 'S don't\n\n\n" * 3), (10, LINE.upper()),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    extra = [f"'x' AS `{c}`" for c in CLASHES]
    frame = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'l' AS lang", "'s' AS source", "1L AS n_chars", *extra)
    return frame.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_rules_match_brute_force(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in rules.ledger(docs).collect()}
    assert len(rules.ledger(docs).collect()) == len(EDGES) and rules.ledger(empty).count() == 0
    for doc_id, text in EDGES:
        w = words(text)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        row = got[doc_id, len(w)]
        assert (row.n_repeat_words, row.n_dup_lines) == (len(covered), len(lines) - len(set(lines)))
        assert row.word_chars == sum(map(len, w))


def test_rule_ablation(spark):
    entries = rules.ledger(corpus(spark)).cache()
    kept = rules.apply_policy(entries, "v2")
    masks = [r.fail_mask for r in entries.collect()]
    full = rules.policy_mask("v2")
    for row in rules.ablation(entries, "v2").collect():
        bit = next(1 << r.bit for r in rules.RULES if r.name == row.rule)
        assert row.rejected == sum(bool(m & bit) for m in masks)
        assert row.rejected_alone == sum((m & full) == bit for m in masks)
        assert row.kept_without == sum(not m & (full - bit) for m in masks)
    assert kept.where("kept").count() == sum(not m & full for m in masks)


def test_bpe_equals_tiktoken_and_round_trips(docs, empty):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabcdeèéñ \n\t12'st.,!ß") for _ in range(rng.randint(0, 90))) for _ in range(500)]
    packed = bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(texts + [LONG, "a" * 5000])
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [encoding.encode_ordinary(t) for t in texts + [LONG, "a" * 5000]]
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t in EDGES)
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_merges_that_unlock_lower_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258, b"abcab": 259}
    encoding = tiktoken.Encoding("odd", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    assert bpe.replay_merges([t.encode() for t in texts], ranks) == [encoding.encode_ordinary(t) for t in texts]


def test_simhash_components_match_brute_force(spark, docs, empty):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 40)
    points = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False))) for b in base for _ in range(12)]
    points = np.unique(np.array(points, dtype=np.int64))
    frame = spark.createDataFrame([(int(p),) for p in points], "fp long")
    root = {r.node: r.root for r in components(simhash.shard_links(frame)).collect()}
    expected = list(range(len(points)))
    near = np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None, :]) <= 4
    for _ in range(len(points)):
        new = [min(expected[j] for j in np.flatnonzero(near[i])) for i in range(len(points))]
        if new == expected:
            break
        expected = new
    assert [root.get(int(p), int(p)) for p in points] == [int(points[e]) for e in expected]
    rows = simhash.near_duplicates(docs).collect()
    ids = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert len(rows) == len(EDGES) and {k[1]: v for k, v in ids.items()}[0] == 2
    assert all(v == 1 for k, v in ids.items() if k[0] in (1, 4, 10))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert found == [1, 2, 5, 7, 9] or found == [1, 2, 5, 7, 8, 9]
    assert simhash.deduplicate(empty).count() == 0


def test_bk_tree_follows_every_link():
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**63, 3)
    points = np.unique(np.array([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in center for a, b in rng.integers(0, 62, (60, 2))], dtype=np.int64))
    tree = simhash.BKTree(points.view(np.uint64))
    links = {(k, int(q)) for k, near in tree.links(np.arange(len(points)), 4) for q in near}
    near = np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None, :]) <= 4
    assert {(i, j) for i, j in links if i != j} == {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i != j}


def test_packing_is_gapless_and_tokens_match(docs, empty):
    rows = packing.pack(packing.pieces(docs, WORDS)).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    expected = sorted(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, t in EDGES)
    texts = collections.defaultdict(list)
    for r in rows:
        assert r.length <= packing.CAPACITY
    whole = [r for r in rows if r.piece == 0 and r.length < packing.CAPACITY]
    assert all(bytes(r.ids) in expected for r in whole) and len(whole) == len(EDGES) - 1
    for r in rows:
        texts[r.sequence_id].append((r.offset, r.length))
    for at in texts.values():
        at.sort()
        assert [a for a, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
        assert sum(n for _, n in at) <= packing.CAPACITY
    assert packing.pack(packing.pieces(empty, WORDS)).count() == 0


def test_genetic_search_beats_its_start():
    rng = random.Random(9)
    lengths = []
    for _ in range(60):  # bins of three that fill exactly
        a = rng.randint(300, 1100)
        b = rng.randint(200, 2048 - a - 150)
        lengths += [a, b, 2048 - a - b]
    lengths.sort(reverse=True)
    start, loads = [], []
    packing.best_fit(start, loads, list(range(len(lengths))), lengths, 2048)
    best = packing.evolve(lengths, 2048, 1, generations=40)
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in best) and len(best) <= len(start)
    child, _ = packing.crossover(start, best, lengths, 2048, rng)
    assert sorted(i for b in child for i in b) == list(range(len(lengths)))


def test_small_blocks_pack_across_blocks(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 900)) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, length long")
    got = packing.pack(frame, block_pieces=100).collect()
    assert sorted((r.doc_id, r.length) for r in got) == rows
    least = -(-sum(n for _, n in rows) // 2048)
    assert len({r.sequence_id for r in got}) <= least + 2


def test_bins_that_stay_poor_are_kept(spark):
    rng = random.Random(5)
    long = [(i, rng.randint(1100, 2000)) for i in range(600)]
    short = [(i, 1500) for i in range(500)] + [(i, rng.randint(300, 548)) for i in range(500, 600)]
    tiny = [(i, 1) for i in range(600)]
    least = (600, 500, 1)
    for rows, bins in zip((long, short, tiny), least):
        frame = spark.createDataFrame(rows, "doc_id long, length long")
        got = packing.pack(frame, block_pieces=200).collect()
        assert sorted((r.doc_id, r.length) for r in got) == rows
        at = collections.defaultdict(list)
        for r in got:
            at[r.sequence_id].append((r.offset, r.length))
        for placed in at.values():
            placed.sort()
            assert [a for a, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))]
            assert sum(n for _, n in placed) <= packing.CAPACITY
        assert bins <= len(at) <= bins + 2


def test_warc_round_trip_and_salvage(spark, tmp_path):
    body = "<p>" + "x" * 2000
    pages = spark.createDataFrame(
        [(1, "http://a/ b\r\n", body), (2, None, body), (3, "u", None), (None, "u", body), (4, "u", "short"), (5, "u", "short"), (2, "u", body)],
        "page_id long, url string, html string",
    ).withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write(pages, path)
    rows = warc.read(spark, path).collect()
    assert len(rows) == 7 and all(r.reason is None for r in rows)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert kinds == {(1, "revisit", 2): 1, (2, "response", None): 2, (3, "response", None): 1, (None, "revisit", 2): 1, (4, "response", None): 1, (5, "response", None): 1}
    assert {r.payload_bytes for r in rows if r.page_id in (1, 2)} == {len(body)}
    warc.write(pages.where("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_salvage_logs_gaps_and_recovers():
    import hashlib

    def one(k, packed=True):
        text = f"page {k} ".encode() * 50
        data = warc.record(k, "u", text, None, hashlib.sha1(text).hexdigest())
        return warc.member(data) if packed else data

    parts = [one(k, k % 3 != 0) for k in range(12)]
    data = b"".join(parts)
    assert [warc._number(r.fields["warc-record-id"]) for r in warc.salvage(data)] == list(range(12))
    rng = random.Random(6)
    starts = [sum(map(len, parts[:k])) for k in range(13)]
    for hurt in (2, 3, 7):
        broken = bytearray(data)
        middle = starts[hurt] + len(parts[hurt]) // 2
        for k in range(middle, middle + 9):
            broken[k] = (broken[k] + 1 + rng.randrange(200)) % 256
        found = list(warc.salvage(bytes(broken)))
        good = [warc._number(r.fields["warc-record-id"]) for r in found if isinstance(r, warc.Record)]
        gaps = [g for g in found if not isinstance(g, warc.Record)]
        assert good == [k for k in range(12) if k != hurt]
        assert [(a, b) for a, b, _ in gaps] == [(starts[hurt], starts[hurt + 1])]
    cut = list(warc.salvage(data[: starts[11] + 20]))
    assert len([r for r in cut if isinstance(r, warc.Record)]) == 11 and cut[-1][:2] == (starts[11], starts[11] + 20)
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk")) == [(0, 4, "neither a member nor a version line")]


def test_salvage_inside_members():
    import hashlib

    rng = random.Random(7)
    texts = [bytes(rng.randrange(32, 127) for _ in range(3000)) for _ in range(60)]
    parts = [warc.record(k, "u", t, None, hashlib.sha1(t).hexdigest()) for k, t in enumerate(texts)]
    last = warc.member(warc.record(60, "u", b"last", None, hashlib.sha1(b"last").hexdigest()))

    def good(data):
        found = list(warc.salvage(data))
        gaps = [x for x in found if not isinstance(x, warc.Record)]
        return [warc._number(r.fields["warc-record-id"]) for r in found if isinstance(r, warc.Record)], gaps

    bad = list(parts)
    for k in (0, 7, 8, 59):
        bad[k] = bad[k].replace(texts[k][:5], b"#####")
    whole = warc.member(b"".join(bad))
    ids, gaps = good(whole + last)
    assert ids == [k for k in range(61) if k not in (0, 7, 8, 59)]
    assert len(gaps) == 3 and all(g[:2] == (0, len(whole)) and "wrong block digest" in g[2] for g in gaps)
    packed = warc.member(b"".join(parts))
    assert good(packed + last) == (list(range(61)), [])
    cut = len(packed) // 2
    ids, gaps = good(packed[:cut])
    assert ids == list(range(len(ids))) and 25 <= len(ids) <= 30
    assert len(gaps) == 1 and gaps[0][0] < gaps[0][1] == cut and gaps[0][2] == "unfinished member"
    broken = packed[:cut] + b"\xff" * 300 + packed[cut + 300 :]
    ids, gaps = good(broken + last)
    first = [k for k in ids if k < 30]
    assert first == list(range(len(first))) and len(first) >= 25 and ids == sorted(set(ids)) and ids[-1] == 60
    assert gaps and gaps[-1][1:] == (len(packed), "damaged member")


def brute_lines(rows):
    """Removed lines of (doc_id, text) rows, by comparing all pairs of lines."""
    sets, gone = [], set()
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            w = words(line)
            s = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in sets):
                gone.add((doc_id, k))
            if s:
                sets.append(s)
    return gone


def test_line_dedup_matches_brute_force(spark, docs, empty):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)]
    lines = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    rows = []
    for doc_id in range(60):
        text = []
        for _ in range(3):
            line = list(rng.choice(lines))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            text.append(rng.choice(("", " ", "\t")) + rng.choice((" ", "  ")).join(line))
        rows.append((doc_id, "\n".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.deduplicate(frame).collect()}
    gone = brute_lines(rows)
    for doc_id, text in rows:
        kept = [x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone]
        assert got[doc_id].text == "\n".join(kept) and got[doc_id].n_removed == 3 - len(kept)
    assert 0 < len(gone) < 180
    cleaned = linededup.deduplicate(docs)
    texts = collections.defaultdict(list)
    for r in cleaned.collect():
        texts[r.doc_id].append(r.text)
    assert cleaned.count() == len(EDGES) and set(docs.columns) <= set(cleaned.columns)
    assert sorted(texts[None]) == ["", LINE] and texts[1] == [""] and texts[4] == ["", ""] and texts[8] == ["The end."]
    assert texts[10] == [LINE.upper()] and texts[3] == [""]
    assert linededup.deduplicate(empty).count() == 0


def test_near_copies_of_a_line_without_doc_id(spark):
    first = [f"t{i}" for i in range(30)]
    second = first[:-1] + ["other"]
    third = [f"u{i}" for i in range(25)]
    rows = [(None, " ".join(first)), (5, " ".join(second) + "\n" + " ".join(third)), (6, " ".join(third[:-1]) + " end\n" + " ".join(first[1:]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in linededup.deduplicate(frame).collect()}
    gone = brute_lines(rows)
    assert gone == {(5, 0), (6, 0), (6, 1)}
    for doc_id, text in rows:
        assert got[doc_id].text == "\n".join(x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone)


def test_short_lines_without_a_new_word(spark):
    rows = [
        (1, "Read more\n\nTop"), (2, " Read\tmore \n\n \nread more"), (3, "Top \u2028\nRead more now please"),
        (4, "Read more now  please\nTop\u2028\nmore Read"), (5, "a b c d e\na b c d"), (6, "a b c d\r\na b c d e\n"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in linededup.deduplicate(frame).collect()}
    gone = brute_lines(rows)
    assert gone == {(2, 0), (4, 0), (6, 0), (6, 1)}
    for doc_id, text in rows:
        assert got[doc_id].text == "\n".join(x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone)


def test_spot_signatures(spark, docs, empty):
    found = {(r.doc_id, r.text): r for r in spotsigs.with_next(docs).collect()}
    assert len(spotsigs.with_next(docs).collect()) == len(EDGES)
    assert found[10, LINE.upper()].next_text == (EDGES[11][1])[: len(LINE) // 2]
    assert found[1, LINE].next_text == LINE.upper()[: len(LINE) // 2] and found[None, LINE].next_text == ""
    assert spotsigs.with_next(empty).count() == 0
    only = spark.createDataFrame([(1, "the quick brown fox")], "doc_id long, text string")
    assert spotsigs.with_next(only).first().next_text == "the quick brown fox"[:9]


def test_spot_signature_pairs_match_brute_force(spark):
    rng = random.Random(3)
    bases = [[rng.choice(["the", "is", "was"] * 40 + [f"k{i}" for i in range(400)]) for _ in range(300)] for _ in range(6)]
    rows = []
    for doc_id in range(60):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 1, 3, 20))):
            w[rng.randrange(len(w))] = f"k{rng.randrange(400)}"
        rows.append((doc_id, " ".join(w)))
    frame = spark.createDataFrame(rows + [(99, None), (98, "")], "doc_id long, text string")
    member, links = spotsigs.near_duplicates(frame)
    of = {r.doc_id: r.set_id for r in member.collect()}
    sigs = {r.s: set(r.sigs) for r in frame.select(F.xxhash64(spotsigs.signatures(F.col("text"))).alias("s"), spotsigs.signatures(F.col("text")).alias("sigs")).collect()}
    expected = {(a, b) for a in sigs for b in sigs if a < b and 5 * len(sigs[a] & sigs[b]) >= 4 * len(sigs[a] | sigs[b])}
    assert {(r.a, r.b) for r in links.collect()} == expected and expected and of[98] == of[99]


def katz_brute(rows):
    low = {i: i + 32 for i in range(65, 91)}
    tokens = [words((t or "").translate(low)) + ["\n"] for _, t, _ in rows]
    one, two = collections.Counter(), collections.Counter()
    for w, (_, _, train) in zip(tokens, rows):
        if train:
            one.update(w)
            two.update(zip(["\n"] + w[:-1], w))
    n, v = sum(one.values()), len(one)
    kinds = collections.Counter(two.values())
    d = katz.discounts([kinds[r] for r in range(1, katz.CUTOFF + 2)])
    after = collections.defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c
    p1 = lambda w: (one[w] + 1) / (n + v + 1)

    def p(w, h):
        if not one[h]:
            return p1(w)
        left = sum((1 - d[c]) * c for c in after[h].values() if c <= katz.CUTOFF)
        bottom = one[h] if left > 0 else one[h] + 1
        left = left if left > 0 else 1.0
        c = two[h, w]
        if c:
            return (d[c] if c <= katz.CUTOFF else 1) * c / bottom
        return left / bottom / (1 - sum(map(p1, after[h]))) * p1(w)

    for h in list(after)[:30]:
        assert abs(sum(p(w, h) for w in one) + p("never seen", h) - 1) < 1e-9
    return [sum(math.log10(p(w, h)) for w, h in zip(x, ["\n"] + x[:-1])) for x in tokens], n


def test_katz_pairs_of_a_batch_take_bounded_memory():
    import tracemalloc
    from types import SimpleNamespace

    rng = np.random.default_rng(3)
    end = np.uint64(katz.xxhash.xxh64_intdigest(katz.END))
    vocab = np.unique(np.append(rng.integers(0, 2**64, 5000, dtype=np.uint64), end))
    tokens = rng.integers(0, len(vocab), 400_000).astype(np.uint32)
    row = SimpleNamespace(
        lengths=katz.planes(np.full(400, 1000, np.uint32)), train=np.ones(400, np.uint8).tobytes(),
        vocab=katz.pack_keys(vocab), tokens=katz.planes(tokens),
    )
    tracemalloc.start()
    try:
        one = katz.Batch(row)
        one.pairs()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70 * len(tokens)
    at = int(np.searchsorted(vocab, end))
    before = np.append(at, tokens[:-1])
    assert (one.history[one.pair] == before).all() and (one.head[one.pair] == tokens).all()
    assert (one.keys == np.unique(katz.mix(katz.mix(vocab[before]) + vocab[tokens]))).all()


def test_katz_matches_brute_force(spark, docs, empty):
    rng = random.Random(2)
    vocabulary = ["a", "B", "b"] + [f"v{i}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(vocabulary, [30, 9, 9] + [1] * 20, k=rng.randint(0, 40))), i % 4 > 0) for i in range(80)]
    rows += [(i or 1000 + k, t, k % 2 == 0) for k, (i, t) in enumerate(EDGES)]
    frame = spark.createDataFrame([(k, t, x) for k, (_, t, x) in enumerate(rows)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in katz.score(frame.repartition(3)).collect()}
    expected, n = katz_brute(rows)
    assert len(got) == len(rows) and {r.train_tokens for r in got.values()} == {n}
    for k, value in enumerate(expected):
        assert got[k].score == pytest.approx(value, rel=1e-9, abs=1e-9)
    odd = katz.score(docs.withColumn("train", F.lit(None).cast("boolean"))).collect()
    assert len(odd) == len(EDGES) and all(r.score == 0 and r.n_known == 0 for r in odd)
    assert katz.score(empty.withColumn("train", F.lit(True))).count() == 0


def test_quality_and_toxicity_on_held_out_rows(spark, docs, empty):
    folder = "/root/testdata/sf0.1"
    all_docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op1_quality_classifier(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert (good["predicted"] == 1).mean() > 0.98 and (bad["predicted"] == 0).mean() > 0.9
    model = toxicity.fit(toxicity.training_rows(all_docs, labels.where("doc_id % 4 <> 0")))
    rows = toxicity.score(all_docs, model).join(labels, "doc_id").where("doc_id % 4 = 0").toPandas()
    toxic = rows["p_toxic"] >= queries.TOXIC_CUT
    # Junk texts keep the label of the text they were made from, so toxic ones are counted among good texts.
    assert toxic[rows["toxic"] == 0].mean() < 0.01 and toxic[(rows["toxic"] == 1) & (rows["quality"] == 1)].mean() > 0.85
    assert (np.diff(model.thresholds) > 0).all()
    assert rows["severity"].between(0, toxicity.GRADES).all()
    assert toxicity.score(docs, model).count() == len(EDGES) == toxicity.keep_clean(docs, model, 1.1).count()
    assert toxicity.score(empty, model).count() == 0 == toxicity.keep_clean(empty, model, 0.5).count()


def test_classifiers_without_labels(spark, docs, empty):
    none = spark.createDataFrame([(None, 1, 1), (1, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(quality.training_rows(docs, none, "quality"))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.keep_good(docs, model, 0.3).collect() == docs.collect()
    assert quality.score(empty, model).count() == 0
    harmless = toxicity.fit(toxicity.training_rows(docs, none))
    assert toxicity.keep_clean(docs, harmless, 0.3).count() == len(EDGES)


def test_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(9)
    toxic, good = "vile gurk zonk awful", LINE
    texts = ["", toxic, good, " ", good, toxic + "\n", "x", "", *(" ".join(rng.choice([*toxic.split(), *good.split()], 9)) for _ in range(60))]
    weights = rng.normal(size=quality.BUCKETS).astype(np.float32)
    keys = np.unique(np.concatenate([h for h, _ in toxicity.features([toxic])]))
    model = toxicity.Model(keys, rng.normal(size=len(keys)), np.array([1.0, 2.0, 3.0]))
    alone = np.concatenate([quality.probability([t], weights, 0.25) for t in texts])
    alone_toxic = np.concatenate([model.predict([t]) for t in texts])
    for _ in range(20):
        order = rng.permutation(len(texts))
        shuffled = [texts[k] for k in order]
        assert (quality.probability(shuffled, weights, 0.25) == alone[order]).all()
        assert (model.predict(shuffled) == alone_toxic[order]).all()
    assert alone[0] == alone[3] == alone[7] == 1 / (1 + np.exp(-0.25))
    # the first word of a text has its leading edge like any other
    assert quality.probability(["word word"], weights, 0.0) == quality.probability([" word word "], weights, 0.0)


def test_repeated_ids_give_one_training_row(spark):
    rows = [(1, f"copy {i % 3} of the text") for i in range(300)] + [(2, "good text"), (3, None), (3, None), (4, "no label"), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for train in (lambda d: quality.training_rows(d, labels, "quality"), lambda d: toxicity.training_rows(d, labels)):
        got = sorted(train(frame.repartition(5)).collect())
        again = sorted(train(frame.orderBy(F.desc("text")).repartition(2)).collect())
        assert [(r.label, r.doc_id) for r in got] == [(0, 2), (0, 3), (1, 1)]
        assert got == again


def test_pipeline_stages_keep_columns(spark, tmp_path):
    docs = corpus(spark)
    columns = docs.columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        assert k == 4 or docs.columns == columns
        if k == 2:
            expected = brute_lines(sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "1")).collect()))
            before = sum(len(r.text.split("\n")) for r in spark.read.parquet(str(tmp_path / "1")).collect())
            after = sum(len(r.text.split("\n")) for r in docs.collect() if r.text)
            assert after == before - len(expected)
    assert counts[0] > 150 and counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]


def test_pipeline_run_stores_every_stage(spark, monkeypatch):
    seen = []

    def watched(stage):
        def run(spark, docs, sf_dir):
            seen.append((docs.inputFiles(), docs.count()))
            return stage(spark, docs, sf_dir)
        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(s)) for n, s in corpus_pipeline.STAGES])
    placed = corpus_pipeline.run(spark, SF)
    names = [n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES]
    assert all("/documents.parquet" in f for f in seen[0][0])
    for name, (files, _) in zip(names, seen[1:]):
        assert files and all(f"/{name}-" in f for f in files)
    assert placed.where("piece = 0").count() == seen[-1][1] > 0


def test_line_dedup_leaves_no_shuffle_files(spark):
    """Shuffles of the intermediate tables end with them; repeated words and shingles keep their sets."""
    import pathlib

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {p.name for d in manager.localDirs() for p in pathlib.Path(d.getPath()).rglob("shuffle_*")}

    rng = random.Random(9)
    rows = []
    for doc_id in range(80):
        word = lambda: rng.choice("abcd") + str(rng.randrange(1 + doc_id % 3))
        again = ["x"] * rng.randint(5, 30) + ["y"] * rng.randint(0, 2)
        line = [word() for _ in range(rng.randint(5, 12))] * rng.randint(1, 4)
        rows.append((doc_id, " ".join(again) + "\n" + " ".join(line) + "\n" + " ".join(line[1:] + ["z"])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before = files()
    cleaned = linededup.deduplicate(frame)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    got = {r.doc_id: r.text for r in cleaned.collect()}
    gone = brute_lines(rows)
    assert 20 < len(gone) < 230
    for doc_id, text in rows:
        assert got[doc_id] == "\n".join(x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone)
