"""Registered queries of this subpackage: thin digests over the operators' own results."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import alignment, bpe, katz, linededup, packing, periods, quality, rules, simhash, spotsigs, subwords, toxicity, warc
from panelcast.llm.common import read, scratch_path


#: From this probability of label 1 on a text counts as good.
QUALITY_CUT = 0.3


def _crc(column: str, modulus: int):
    """Remainder of the CRC-32 of a number's text; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text; learns from labels outside the held-out fifth only."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality").where(_crc("doc_id", 5) != 0)
    model = quality.train(quality.training_rows(docs, labels, "quality"))
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(_crc("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


#: From this probability of a grade above 0 on a text counts as toxic.
TOXIC_CUT = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every whole text of documents; learns from a bounded sample of labels.toxic."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id", "severity", "p_toxic", (F.col("p_toxic") >= TOXIC_CUT).alias("toxic")
    )


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text; a seventh of the documents is not learned from."""
    held_out = F.coalesce(_crc("doc_id", 7) == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("train", ~held_out)
    return katz.score(docs).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of every whole text under the newest policy."""
    entries = rules.ledger(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.col("fail_mask").bitwiseAND(F.lit(rules.policy_mask("base"))) != 0
    return rules.apply_policy(entries, "v2").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_mask",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page and reads the archives back."""
    path = scratch_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    found = warc.read(spark, path, with_payload=False).where("reason IS NULL")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    found = spotsigs.with_next(read(spark, sf_dir, "documents", "doc_id", "text"))
    found = found.withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text")))
    found = found.withColumn("edited_sigs", spotsigs.signatures(F.col("edited")))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text; digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(
        read(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN
    )
    return bpe.decode(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places every token piece of every document in sequences of 2048 tokens."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that have an earlier near duplicate."""
    return linededup.deduplicate(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text; digests of the ids and of the decoded text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = subwords.encode(read(spark, sf_dir, "documents", "doc_id", "text"), path)
    return subwords.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links the tokens of two tokenizers in every whole text and counts their id pairs over all documents."""
    return alignment.link_counts(
        read(spark, sf_dir, "documents", "doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def repeated(doc_id: int | None, words: list) -> list:
    """The words of every tenth document, from a place on, as repetitions of the first few of them (no id: as they are)."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return [words[i if i < start else start + (i - start) % period] for i in range(n)]


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words (every tenth one edited), the strongest run and digests."""
    found = periods.detect(read(spark, sf_dir, "documents", "doc_id", "text"), repeated)
    # runs come by start and period, so the first of equal exponents stays
    best = F.expr(
        "aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (b, r) -> "
        "if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"
    )
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = (
    op1_quality_classifier,
    op2_toxicity,
    op3_katz,
    op4_quality_rules,
    op5_warc,
    op6_simhash,
    op7_spotsigs,
    op8_byte_bpe,
    op9_packing,
    op10_line_dedup,
    op11_sentencepiece,
    op12_alignment,
    op13_periods,
)


def registry() -> dict:
    return {q.__name__: q for q in QUERIES}


_OP4 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
      FROM d),
win AS (SELECT r, i, list_slice(w, i, i + 4) AS s
        FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM p WHERE len(w) >= 5)),
twin AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM twin) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(text) - len(regexp_extract_all(text, '[\\x20\\x09-\\x0D]')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(regexp_extract_all(text, '\\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_exclamations
      FROM p LEFT JOIN cover USING (r)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 3 * n_exclamations > n_words THEN 64 ELSE 0 END AS fail_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_mask & 3) <> 0 AS base_failed,
       fail_mask = 0 AS kept, cast(fail_mask AS int) AS fail_mask FROM f
"""


_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept THEN kept END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""


_OP10 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, regexp_extract_all(l[i], '[^\\x20\\x09-\\x0D]+') AS w FROM x),
s AS (SELECT DISTINCT doc_id, i, list_slice(w, k, k + 4) AS s
      FROM (SELECT doc_id, i, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) >= 1)),
n AS (SELECT doc_id, i, count(*) AS n FROM s GROUP BY 1, 2),
c AS (SELECT b.doc_id, b.i, a.doc_id AS doc_a, a.i AS i_a, count(*) AS c
      FROM s a JOIN s b ON a.s = b.s AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i)) GROUP BY 1, 2, 3, 4),
g AS (SELECT DISTINCT c.doc_id, c.i FROM c JOIN n p ON p.doc_id = c.doc_id AND p.i = c.i
      JOIN n q ON q.doc_id = c.doc_a AND q.i = c.i_a WHERE 5 * c.c >= 4 * (p.n + q.n - c.c))
SELECT x.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
       coalesce(string_agg(CASE WHEN g.i IS NULL THEN l[x.i] END, chr(10) ORDER BY x.i), '') AS text
FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": _OP4, "op5_warc": _OP5, "op10_line_dedup": _OP10}
