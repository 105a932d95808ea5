"""SentencePiece agenda, cross-tokenizer alignment and periodic runs against the libraries and brute force."""

import bisect
import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelcast.llm import alignment, packing, periods, queries, subwords

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RUN = " ".join(["alpha beta gamma delta"] * 9)
EDGES = [
    (1, "one two three"), (2, None), (3, ""), (None, "one two three"), (None, None), (1, "one two three"), (4, RUN),
    (5, " ".join(f"w{i % 977}" for i in range(20_000))), (6, " \t\n\x0b\r "), (7, "word"), (8, "a▁b  c ▁ <s></s>"),
    (9, "é ñ <|endoftext|> <0x0A> 'S don't\n\n\n" * 3), (10, "梦🙂ﬁ　\x00​" * 4), (11, "a" * 3000), (12, RUN + " z " + RUN),
]
CLASHES = "ids decoded runs collapsed words block_id a b n pair times holders at count best answers".split()


@pytest.fixture(scope="module")
def docs(spark):
    extra = [f"'x' AS `{c}`" for c in CLASHES]
    return spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", *extra).repartition(3).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    return sorted(map(repr, rows))


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = "aabcde \n\t▁é梦  <0x>s/ﬁ　\x00​🙂12"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# --- SentencePiece -----------------------------------------------------------------------------------------------


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_agenda_equals_library_on_odd_texts():
    texts = [*odd_texts(3000, 1), "a" * 5000, " " * 3000, "▁" * 99, "<s></s><unk> <0x0A>", "x" * 24, "x" * 25, ""]
    got = subwords.Agenda(PIECES).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library().encode(texts)


def test_both_agendas_agree():
    own = subwords.Agenda(PIECES)
    chunks = ["▁" + t.replace(" ", "").replace("▁", "")[:23] for t in odd_texts(500, 2)]
    joined = [[own.ids.get(x, own.size + ord(x[0])) for x in own.long_chunk(c)] for c in chunks]
    assert own.short_chunks(chunks) == joined


def test_a_difference_from_the_library_is_an_error():
    own = subwords.Agenda(PIECES)
    with pytest.raises(ValueError, match="library"):
        own.check(["▁word"], [[5]])


def test_forgotten_chunks_are_worked_out_again(monkeypatch):
    monkeypatch.setattr(subwords, "KNOWN_CHARS", 400)
    own, texts = subwords.Agenda(PIECES), odd_texts(400, 3)
    for k in range(0, 400, 20):
        got = own.encode(texts[k : k + 20])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == library().encode(texts[k : k + 20])
    assert sum(map(len, own.young)) <= 400


def test_encode_and_decode_rows(spark, docs):
    encoded = subwords.encode(docs, PIECES)
    assert encoded.columns == ["doc_id", "ids"]
    got = subwords.decode(encoded, PIECES).collect()
    sp = library()
    want = [(i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in EDGES]
    assert ordered((r.doc_id, r.ids, r.decoded) for r in got) == ordered(want)
    assert subwords.decode(subwords.encode(docs.where("false"), PIECES), PIECES).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")
    assert subwords.decode(null, PIECES).first().decoded is None


def test_op11_on_a_table(spark):
    sp = library()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    got = queries.op11_sentencepiece(spark, SF).collect()
    assert ordered(tuple(r) for r in got) == ordered(want)


# --- alignment ---------------------------------------------------------------------------------------------------


def brute_alignment(rows):
    """Columns of the operator for (id, text) rows, by plain loops over the libraries' tokens."""
    tok, sp = Tokenizer.from_file(BYTES), library()
    tok.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(b): b for b in printable}
    decode |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    all_links, out = [], []
    for _, text in rows:
        given = (" " + (text or "")).encode()
        enc = tok.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(decode[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = []
        for i in sp.encode(text or ""):
            piece = sp.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != given or b"".join(x for _, x in b) != given:
            a = b = []
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        cuts = sorted(ends[0] & ends[1])
        groups, place = [([], []) for _ in cuts], 0
        for side in (0, 1):
            place = 0
            for i, x in (a, b)[side]:
                place += len(x)
                groups[bisect.bisect_left(cuts, place)][side].append(i)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        all_links.append(links)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sha(spelled) if a else ""))
    count = collections.Counter(p for links in all_links for p in set(links))
    highest = collections.defaultdict(int)
    for (x, _), c in count.items():
        highest[x] = max(highest[x], c)
    return [
        (i, *o[:4], sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), o[4])
        for (i, _), o, links in zip(rows, out, all_links)
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_matches_brute_force(spark, docs, monkeypatch):
    got = alignment.link_counts(docs, BYTES, public_tokenizers.PATTERN, PIECES)
    assert got.columns == COLUMNS
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute_alignment(EDGES))
    assert alignment.link_counts(docs.where("false"), BYTES, public_tokenizers.PATTERN, PIECES).count() == 0


def test_short_checks_of_spelling_equal_the_joined_tokens():
    sides = alignment.sides(BYTES, public_tokenizers.PATTERN, PIECES)
    texts = [t for t in odd_texts(2000, 8) if t]
    for side in sides:
        for text, ids in zip(texts, side.ids(texts)):
            assert side.spells(text, ids) == alignment.Side.spells(side, text, ids)
    assert any(not sides[1].spells(t, i) for t, i in zip(texts, sides[1].ids(texts)))


def test_wide_groups_give_the_same_pairs(monkeypatch):
    side_a, side_b = alignment.sides(BYTES, public_tokenizers.PATTERN, PIECES)
    found = alignment.align([*odd_texts(300, 5), "梦🙂" * 50], side_a, side_b)
    plain = alignment.linked_pairs(found, len(side_b.token))
    monkeypatch.setattr(alignment, "WIDE_GROUP", 2)
    for x, y in zip(plain, alignment.linked_pairs(found, len(side_b.token))):
        assert x.tolist() == y.tolist()


def test_shared_groups_are_the_common_ends():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b, first, last, base = [], [], [], [], 0
        for _ in range(rng.integers(1, 5)):
            size = int(rng.integers(1, 60))
            inner = [np.flatnonzero(rng.random(size - 1) < rng.choice([0.05, 0.3, 0.9])) + 1 for _ in "ab"]
            first.append(len(a))
            a += [*(base + inner[0]), base + size]
            b += [*(base + inner[1]), base + size]
            last.append(len(a) - 1)
            base += size
        cuts = alignment.shared_groups(*map(np.array, (a, b, first, last)))
        assert cuts.tolist() == sorted(set(a) & set(b))


def test_fast_byte_encoder_equals_the_tokenizers_library():
    side, _ = alignment.sides(BYTES, public_tokenizers.PATTERN, PIECES)
    tok = Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    texts = [*odd_texts(3000, 6), " " * 900_000 + "x", "\n" * 20_000, "a" * 200_000, "<|endoftext|>"]
    assert [x.tolist() for x in side.ids(texts)] == [tok.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_op12_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op12_alignment(spark, SF)
    assert got.columns == COLUMNS
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute_alignment(rows))


def test_blocks_of_texts_are_small_rows_and_no_row_holds_a_block_of_answers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chars = docs.selectExpr("sum(length(text))").first()[0]
    rows = alignment._align_blocks(docs, BYTES, public_tokenizers.PATTERN, PIECES).toArrow()
    assert 0 < rows.nbytes < chars  # a pair of a text with its links took 12 bytes before, here over a byte per character
    plan = alignment.link_counts(docs, BYTES, public_tokenizers.PATTERN, PIECES)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_blocks_across_batches_are_scored_whole(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = alignment.link_counts(docs, BYTES, public_tokenizers.PATTERN, PIECES).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered(tuple(r) for r in got) == ordered(brute_alignment(EDGES))


# --- periodic runs -----------------------------------------------------------------------------------------------


def brute_runs(w, least_words=24, least_periods=3):
    best = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least_words, least_periods * q):
                best.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [(24, 3), (6, 2), (4, 2), (9, 3), (1, 4)])
def test_runs_match_brute_force(least):
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        t, n = [], rng.randint(0, 120)
        while len(t) < n:
            t += [rng.choice("abc") for _ in range(rng.randint(1, 7))] * rng.choice([1, 1, 2, 3, 5, 9])
        texts.append([x.encode() for x in t])
    assert periods.find_runs(texts, *least) == [brute_runs(t, *least) for t in texts]


def test_runs_of_edge_lists():
    assert periods.find_runs([]) == [] and periods.find_runs([[], []]) == [[], []]
    assert periods.find_runs([["x"] * 23, ["x"] * 24, [b"x"] * 0]) == [[], [(0, 24, 1)], []]
    # a stretch of runs within a run: both periods are reported
    inner = (["a"] * 24 + ["b"]) * 3
    assert periods.find_runs([inner]) == [brute_runs(inner)]


def brute_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_detect_rows(docs):
    got = periods.detect(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    rows = got.collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGES) and periods.detect(docs.where("false")).count() == 0
    assert [tuple(x) for x in by_id[4].runs] == [(0, 36, 4)] and by_id[4].collapsed == "alpha beta gamma delta"
    assert [tuple(x) for x in by_id[12].runs] == [(0, 36, 4), (37, 36, 4)]
    assert [tuple(x) for x in by_id[5].runs] == [(0, 20_000, 977)] and len(by_id[5].collapsed.split()) == 977
    assert by_id[2].runs == by_id[3].runs == by_id[6].runs == [] and by_id[6].collapsed == by_id[2].collapsed == ""


def test_op13_on_a_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 20000 OR text IS NULL").collect()
    want = {repr(brute_digest(r.doc_id, r.text)) for r in rows}
    got = {repr(tuple(r)) for r in queries.op13_periods(spark, SF).collect()}
    assert want <= got and len(want) > 100


def test_words_are_merged_as_by_the_library_and_late_ones_stay_known(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = random.Random(5)
    texts = ["", ".", "a.", "a., b.", "it's ''s don't,", "\x0bA.\tx.\n", "<|endoftext|>.", "caf\u00e9, Stra\u00dfe 9.", "\u2019s \u212a.", "x" * 90 + "."]
    texts += ["".join(rng.choice("abcdeorst .,\n\t\u00c9\u00e9'19<|\u65e5\x1c\xa0") for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert [(t, g) for t, g, w in zip(texts, got, want) if g != w and "<|endoftext|>" not in t] == []
    assert own.merges is not None and own.parts(b"word") == [b"word"]

    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    small = packing.WordTokenizer(path)
    learned = []
    monkeypatch.setattr(small, "learn", lambda words, real=small.learn: (learned.extend(words), real(words)))
    for k in range(40):
        small.encode([f"often seen {' '.join(f'w{k}x{i}' for i in range(20))}"])
    assert learned.count(b"often") == 1
    assert len(small.known) + len(small.older) < 200
