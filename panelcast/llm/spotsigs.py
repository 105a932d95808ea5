"""Document fingerprints by spot signatures.

A spot signature is a common-word anchor with the chain of the next two content words behind it. The
fingerprint of a text is the set of its signatures, written as their sorted hexadecimal hashes. Two
fingerprints are alike by the Jaccard similarity of the sets. Near duplicates are found among sets of
similar length only: sets are partitioned by length, joined on a prefix, pruned by their
sizes and verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import let, stored

#: Common words that start no chain and are skipped inside one (fixed choice, four languages).
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or than that the this to was with "
    "de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "auf aus das dem den der die ein eine er für im ist mit nicht sich sie und von zu "
    "al como con del el es las lo los no más o por su una y"
).split()
#: Common words whose following chain becomes a signature.
ANCHORS = "the is was that be le les est une der die das ist los el las por".split()
CHAIN = 2
_MARK = "\u0001"


def signatures(text: Column) -> Column:
    """Sorted distinct 64-bit signatures of a text (null: empty).

    A text without a complete chain has one signature over all its words, so equal texts always have
    equal sets and different short texts do not pass for alike. Words are runs of letters and digits,
    lower-cased.
    """
    words = F.concat(F.lit("^ "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # Each common word is hung on the content word before it; one replacement per word, so no run is too long.
    hung = F.regexp_replace(words, " (" + "|".join(STOP_WORDS) + ")(?= )", _MARK + "$1")

    def chains(parts: Column) -> Column:
        heads = F.transform(parts, lambda p: F.substring_index(p, _MARK, 1))
        return let(heads, lambda h: F.flatten(F.transform(
            parts,
            lambda p, j: F.when(
                F.contains(p, F.lit(_MARK)) & (j + CHAIN < F.size(h)),
                F.transform(
                    F.filter(F.split(p, _MARK), lambda a, k: (k > 0) & a.isin(ANCHORS)),
                    lambda a: F.xxhash64(a, *[F.get(h, j + n) for n in range(1, CHAIN + 1)]),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )))

    found = let(F.split(F.trim(hung), " "), chains)
    return let(found, lambda s: F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(F.array(F.xxhash64(words))))


def fingerprint(signature_set: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature_set, lambda s: F.hex(s)), "-"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``sigs`` with ``next_text`` and ``next_sigs`` of the next document, descending doc_id.

    After the smallest id comes the largest. ``next_text`` holds only as many characters as half of the longest text
    of this doc_id. Rows that share a doc_id all get the same next document, and of such a next document the least
    text counts. Rows without doc_id have no place in the order: their next text is empty, without signatures.
    The order is found on ids alone; texts are shuffled by id, never gathered.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    parts = F.spark_partition_id()
    ids = stored(lengths.repartitionByRange("doc_id").select("doc_id", "n", parts.alias("part")), "ids")
    # Within a range the order is a window; between ranges only their last ids matter, one row per range.
    edges = ids.groupBy("part").agg(F.max("doc_id").alias("top"), F.max_by("n", "doc_id").alias("top_n"))
    after = ids.selectExpr(
        "doc_id AS giver", "n", "part",
        "lead(doc_id) OVER (PARTITION BY part ORDER BY doc_id) AS taker",
        "lead(n) OVER (PARTITION BY part ORDER BY doc_id) AS taker_n",
    )
    # The id above the largest of a range is the smallest of the next range; above the last one, the very first.
    lows = ids.groupBy("part").agg(F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("low_n"))
    ring = lows.join(edges.select("part", "top"), "part").selectExpr(
        "top AS giver_top",
        "coalesce(lead(low) OVER (ORDER BY part), first(low) OVER (ORDER BY part)) AS low",
        "coalesce(lead(low_n) OVER (ORDER BY part), first(low_n) OVER (ORDER BY part)) AS low_n",
    )
    pairs = after.join(ring, (F.col("giver") == F.col("giver_top")) & F.col("taker").isNull(), "left").select(
        "giver", F.coalesce("taker", "low").alias("taker"), F.coalesce("taker_n", "low_n").alias("taker_n")
    )
    signed = base.withColumn("sigs", signatures(F.col("text")))
    # One exchange serves both sides: documents as they are, and documents as givers.
    known = signed.where("doc_id IS NOT NULL").repartition("doc_id")
    least = known.selectExpr(
        "doc_id", "text", "sigs", "row_number() OVER (PARTITION BY doc_id ORDER BY text) AS at"
    ).where("at = 1")
    given = least.join(pairs, F.col("doc_id") == F.col("giver")).select(
        "taker", F.expr("left(text, cast(taker_n div 2 AS int))").alias("next_text"), F.col("sigs").alias("next_sigs")
    )
    none = F.array().cast("array<bigint>")
    return known.join(given, F.col("doc_id") == F.col("taker"), "left").select(
        "doc_id", "text", "sigs", F.coalesce("next_text", F.lit("")).alias("next_text"),
        F.coalesce("next_sigs", none).alias("next_sigs"),
    ).unionAll(
        signed.where("doc_id IS NULL").select("*", F.lit("").alias("next_text"), none.alias("next_sigs"))
    )


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``other``, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(other, half))


def near_duplicates(docs: DataFrame, numerator: int = 4, denominator: int = 5) -> tuple[DataFrame, DataFrame]:
    """(membership, links): ``doc_id, set_id`` per row, and links ``a < b`` between sets at the similarity or above.

    Rows with equal sets share a set_id, so copies are never paired. Sets are dealt to partitions by length such
    that similar ones lie in the same or the next partition, and joined on prefix signatures, rare ones first by
    count. Null texts are empty texts; rows without doc_id are members like any other.
    """
    rows = stored(docs.select("doc_id", signatures(F.col("text")).alias("sigs")), "signatures")
    member = rows.select("doc_id", F.xxhash64("sigs").alias("set_id"))
    sets = rows.select(F.xxhash64("sigs").alias("set_id"), "sigs").dropDuplicates(["set_id"])
    flat = sets.select("set_id", F.size("sigs").alias("n"), F.explode("sigs").alias("s"))
    counts = flat.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(denominator / numerator)) + 1e-9).cast("int")
    ranked = flat.join(counts, "s", "left").selectExpr(
        "set_id", "n", "s", "df", "row_number() OVER (PARTITION BY set_id ORDER BY coalesce(df, 1), s) AS at"
    )
    prefix = ranked.where(
        (F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(numerator) / denominator) + 1) & F.col("df").isNotNull()
    ).withColumn("level", level)
    a = prefix.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), "s", F.explode(F.array("level", F.col("level") + 1)).alias("level"))
    b = prefix.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), "s", "level")
    close = (F.col("n_a") * numerator <= F.col("n_b") * denominator) & (F.col("n_b") * numerator <= F.col("n_a") * denominator)
    pairs = a.join(b, ["s", "level"]).where(close & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    left = sets.select(F.col("set_id").alias("a"), F.col("sigs").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("sigs").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    links = pairs.join(left, "a").join(right, "b").where(
        shared * denominator >= (F.size("x") + F.size("y") - shared) * numerator
    )
    return member, links.select("a", "b")
