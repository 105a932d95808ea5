"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its five-word shingles (64-bit hashes; case and punctuation count), a line of one to four words
the set of one shingle, all its words. It is removed if an earlier line has a Jaccard similarity of at least 0.8; so
a short line goes if an earlier one has the same words. Blank lines are always kept. Earlier means by doc_id (nulls
first), then by a hash of the text (for rows that share a doc_id), then by place in the text; matches count whether
or not the earlier line is itself removed.

1. Shingles get one total order by rarity, the frequency of their first word: words are counted in 8,192 hash buckets
   over all texts, rare buckets first.
2. Lines of equal words collapse into one class at their first place, so copies never meet in a join.
3. A class keeps its rarest shingles, at least its prefix, among which any match must share one. Shingles of one class
   only drop out; the sets of the other classes are made from the texts. Of a shingle's classes that pass the length
   and positional filters with another one, the earliest is its leader.
4. A class is first compared with the leader that most of its prefix has. Most copies are settled here.
5. Only classes without a match are joined with all earlier classes on the prefix, under length, positional and
   bitmap filters, and verified. Similarity is an existence test, so no group expands into its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import let, stored

SHINGLE = 5
#: Similarity as a fraction, so that all bounds are whole-number arithmetic.
NUMERATOR, DENOMINATOR = 4, 5
BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS


def _plain(text: Column) -> Column:
    """The text with one space between the words of a line and none around them."""
    odd = F.lit(False)
    for sign in ("\t", "\r", "\x0b", "\x0c", "  ", " \n", "\n "):
        odd = odd | F.contains(text, F.lit(sign))
    odd = odd | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    single = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")
    return F.when(odd, F.regexp_replace(single, r"^ | \z|(?<=\n) | (?=\n)", "")).otherwise(text)


def _bucket(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - BUCKET_BITS).cast("int")


def rarity(texts: DataFrame) -> Column:
    """Array literal: the rank of every bucket of words by how often its words occur, rarest first.

    All words of all texts are counted. The number of buckets is fixed, so this is all that reaches the
    driver at any size.
    """
    # One character splits without a regular expression.
    words = texts.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(F.split("line", " ")).alias("w"))
    counts = words.groupBy(_bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")).unionAll(
        texts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))
    )
    ordered = counts.groupBy("b").agg(F.sum("n").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("n", "b"))).alias("s")
    )
    back = F.array_sort(F.transform("s", lambda x, i: F.struct(x["b"].alias("b"), i.alias("r"))))
    ranks = ordered.select(F.transform(back, lambda x: x["r"]).alias("ranks")).first()["ranks"]
    high = [(r - BUCKETS // 2) << (64 - BUCKET_BITS) for r in ranks]
    return F.split(F.lit(",".join(map(str, high))), ",").cast("array<bigint>")


def _with_words(lines: DataFrame, ranks: Column) -> DataFrame:
    """``lines`` with w, the words of ``line``, r, their ranks, and m, how many five-word shingles there are, repeats included."""
    w = lines.select("*", F.explode(F.array(F.split("line", " "))).alias("w"))
    # Sorting longs runs compiled if there can be no null.
    rank = F.transform("w", lambda x: F.coalesce(F.get(ranks, _bucket(x)), F.lit(0)))
    # Behind a generator the optimizer cannot copy an expression into functions that run once per word.
    return w.select("*", F.explode(F.array(rank)).alias("r"), F.greatest(F.size("w") - (SHINGLE - 1), F.lit(0)).alias("m"))


def _tokens(places: Column) -> Column:
    """Distinct tokens of the shingles that begin at these places of w, rarest first.

    A token is the rank of the shingle's first word, which no shingle can be more frequent than, before the
    high bits of the shingle's 64-bit hash.
    """

    def token(i: Column) -> Column:
        mixed = F.xxhash64(*[F.get("w", i + k) for k in range(SHINGLE)])
        return F.coalesce(F.get("r", i).bitwiseOR(F.shiftrightunsigned(mixed, BUCKET_BITS)), F.lit(0))

    return F.sort_array(F.array_distinct(F.transform(places, token)))


def _places() -> Column:
    return F.when(F.col("m") > 0, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array().cast("array<int>"))


def _prefix(words: DataFrame) -> DataFrame:
    """``words`` with prefix: the rarest tokens of the line, never fewer than its set's prefix.

    Shingles of different ranks differ. So the first words up to the rank that is the p-th distinct one, p as long
    as a prefix of m can be, begin p different shingles or more, and they are the first of the whole sorted set.
    """
    longest = F.col("m") - _least(F.col("m"))
    sorted_ranks = F.sort_array(F.array_distinct(F.slice("r", F.lit(1), F.col("m"))))
    last = F.coalesce(F.get(sorted_ranks, longest), F.lit((1 << 63) - 1))
    places = let(last, lambda t: F.filter(_places(), lambda i: F.get("r", i) <= t))
    return words.withColumn("prefix", _tokens(places))


def _least(n: Column) -> Column:
    """ceil(0.8 n)."""
    return F.ceil(n * F.lit(NUMERATOR) / DENOMINATOR).cast("int")


def _overlap(n: Column, m: Column) -> Column:
    """Shared shingles that two sets of n and m need: ceil(0.8 / 1.8 * (n + m))."""
    total = (n + m) * NUMERATOR
    return F.floor((total + (NUMERATOR + DENOMINATOR - 1)) / (NUMERATOR + DENOMINATOR)).cast("int")


def _similar(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared * DENOMINATOR >= (F.size(a) + F.size(b) - shared) * NUMERATOR


def _bitmap(tokens: Column, word: int) -> Column:
    """Parity bitmap of a quarter of the tokens; differing bits never exceed differing tokens."""
    mine = F.filter(tokens, lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(3)) == word)
    return F.aggregate(
        mine, F.lit(0).cast("long"),
        lambda acc, t: acc.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
        ),
    )


PLACE = ["doc_id", "key", "line_no"]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line: its place and the line."""
    return docs.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``stored``, after which Spark removes the shuffle files of this write instead of at some later collection."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _line_prefixes(docs: DataFrame, ranks: Column) -> DataFrame:
    """(place, cls, m, prefix) of every line with a word. ``cls`` stands for the line's words."""
    words = _prefix(_with_words(_lines(docs).where("line <> ''"), ranks))
    return _kept(words.select(*PLACE, F.xxhash64("line").alias("cls"), "m", "prefix"), "lines")


def _classes(lines: DataFrame) -> DataFrame:
    """One row per distinct line: its first place and how often it comes."""
    first = F.min(F.struct(*PLACE)).alias("place")
    grouped = lines.groupBy("cls", "m").agg(first, F.first("prefix").alias("prefix"), F.count("*").alias("copies"))
    return _kept(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")


def _meeting(classes: DataFrame) -> DataFrame:
    """(id, m, at, token): prefix shingles that two or more classes share, and their place in the class's sorted set.

    The first shingle that a similar pair shares lies in the first ninth of the smaller set, so one class at
    least has it there.
    """
    prefixes = classes.where("m > 0").select("id", "m", F.posexplode("prefix").alias("at", "token"))
    # One exchange serves the counts and the rows themselves, as both need all columns.
    prefixes = prefixes.repartition("token")
    early = F.min(F.col("at") + _overlap(F.col("m"), F.col("m")) - F.col("m"))
    shared = prefixes.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("b"), early.alias("early"))
    shared = shared.where("a <> b AND early <= 0").select("token")
    meeting = prefixes.join(shared.hint("shuffle_hash"), "token", "left_semi")
    return _kept(meeting, "meeting")


def _sets(docs: DataFrame, classes: DataFrame, meeting: DataFrame, ranks: Column) -> DataFrame:
    """(id, place, n, tokens) of the classes in ``meeting``, from the texts again."""
    wanted = classes.select("id", "place").join(meeting.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    by_doc = wanted.groupBy("place.doc_id", "place.key").agg(F.collect_list(F.struct("id", "place")).alias("wanted"))
    by_doc = by_doc.withColumnRenamed("key", "k").hint("shuffle_hash")
    mine = docs.select("key", F.col("doc_id").alias("d"), "text").join(
        by_doc, (F.col("key") == F.col("k")) & F.col("d").eqNullSafe(F.col("doc_id"))
    )
    found = mine.select(F.explode("wanted").alias("w"), F.split("text", "\n").alias("lines"))
    found = found.select("w.*", F.get("lines", F.col("w.place.line_no")).alias("line"))
    # Rows equal in doc_id and text give a class twice.
    words = _with_words(found.dropDuplicates(["id"]), ranks)
    tokens = words.select("id", "place", _tokens(_places()).alias("tokens"))
    return _kept(tokens.select("id", "place", F.size("tokens").alias("n"), "tokens"), "sets")


def _fits(n: Column, at: Column, m: Column, bt: Column) -> Column:
    """Length and positional filter of two sets of n and m that share the shingles at places at and bt."""
    left = F.least(n - at, m - bt) + F.least(at, bt)
    return (n >= _least(m)) & (m >= _least(n)) & (left >= _overlap(n, m))


def _entries(meeting: DataFrame, sets: DataFrame) -> DataFrame:
    """Shared prefix shingles that pass the filters with some other class, their class and the token's leader.

    The leader is the earliest of these classes.
    """
    known = meeting.drop("m").join(sets.select("id", "place", "n"), "id").where(F.col("at") <= F.col("n") - _least(F.col("n")))
    other = known.select(F.col("token").alias("o_token"), *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "at")])
    entries = _kept(known.join(
        other,
        (F.col("token") == F.col("o_token")) & (F.col("id") != F.col("o_id"))
        & _fits(F.col("n"), F.col("at"), F.col("o_n"), F.col("o_at")),
        "left_semi",
    ), "fitting")
    leaders = entries.groupBy("token").agg(F.min(F.struct("place", "id")).alias("leader"))
    return _kept(entries.join(leaders.select("token", F.col("leader.id").alias("leader")), "token"), "entries")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (id, other), the classes with a similar partner."""
    a = sets.select("id", F.col("tokens").alias("a"))
    b = sets.select(F.col("id").alias("other"), F.col("tokens").alias("b"))
    similar = pairs.join(a, "id").join(b, "other").where(_similar(F.col("a"), F.col("b")))
    return _kept(similar.select("id").distinct(), "verified")


def _to_leaders(entries: DataFrame) -> DataFrame:
    """(id, other): per class the leader that most of its prefix shingles have."""
    common = entries.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    return common.groupBy("id").agg(F.max(F.struct("n", "leader")).alias("m")).select("id", F.col("m.leader").alias("other"))


def _to_earlier(entries: DataFrame, settled: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a class that is not settled and an earlier one that pass all filters."""
    maps = sets.select("id", *[_bitmap(F.col("tokens"), k).alias(f"m{k}") for k in range(4)])
    names = ("id", "place", "n", "at", "m0", "m1", "m2", "m3")
    open_ = _kept(entries.where("id <> leader").join(settled, "id", "left_anti").drop("leader").join(maps, "id"), "open")
    later = open_.select(F.col("token").alias("q_token"), *[F.col(c).alias(f"q_{c}") for c in names])
    # Only shingles that an open class has are looked at again.
    index = entries.drop("leader").join(open_.select("token").distinct(), "token", "left_semi").join(maps, "id")
    need = _overlap(F.col("n"), F.col("q_n"))
    differing = sum((F.bit_count(F.col(f"m{k}").bitwiseXOR(F.col(f"q_m{k}"))) for k in range(4)), F.lit(0))
    return index.join(
        later,
        (F.col("token") == F.col("q_token")) & (F.col("place") < F.col("q_place"))
        & _fits(F.col("n"), F.col("at"), F.col("q_n"), F.col("q_at")) & (F.col("n") + F.col("q_n") - differing >= 2 * need),
    ).select(F.col("q_id").alias("id"), F.col("id").alias("other")).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line_no) of every line that has an earlier match; ``docs``: doc_id, key, text."""
    docs = docs.withColumn("text", _plain(F.col("text")))
    ranks = rarity(docs)
    lines = _line_prefixes(docs, ranks)
    classes = _classes(lines)
    meeting = _meeting(classes)
    sets = _sets(docs, classes, meeting, ranks)
    entries = _entries(meeting, sets)
    settled = _verified(_to_leaders(entries), sets)
    rest = _verified(_to_earlier(entries, settled, sets), sets)
    gone = settled.unionAll(rest).withColumn("gone", F.lit(True))
    hit = classes.select("id", "cls", "place", "copies").join(gone, "id", "left").where("copies > 1 OR gone").select(
        "cls", "place", F.coalesce("gone", F.lit(False)).alias("gone")
    )
    return _kept(
        lines.select("cls", F.struct(*PLACE).alias("here")).join(hit, "cls")
        .where("gone OR here <> place").select("here.*"),
        "removed",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and rows, the text without removed lines, and ``n_lines``, ``n_removed``.

    Null texts count as empty (one empty line, always kept) and come back empty. Rows without doc_id take part
    and come first; rows equal in doc_id and text count as one document and lose the same lines. An empty table
    gives an empty result. Columns of docs named n_lines or n_removed are replaced; others may have any name.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    other = [c for c in columns if c not in ("doc_id", "text")]
    carried = [F.struct(*[F.col(f"`{c}`") for c in other]).alias("row")] if other else []
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carried)
    base = base.withColumn("key", F.xxhash64("doc_id", "text"))
    gone = removed_lines(base.select("doc_id", "key", "text")).groupBy("doc_id", "key").agg(
        F.collect_set("line_no").alias("gone")
    )
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "gone")
    joined = base.join(gone, (F.col("key") == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    lines = F.split("text", "\n")
    kept = let(lines, lambda a: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone")), lambda i: F.get(a, i)), "\n"
    ))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text")
    own = {"doc_id": F.col("doc_id"), "text": text}
    return joined.select(
        *[own.get(c, F.col("row").getField(c).alias(c) if c in other else None) for c in columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
