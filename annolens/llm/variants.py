"""Spelling variants by asymmetric q-chunks, by DataFrame expressions only.

Two words are near if one inserted, deleted or replaced character makes one of
the other.  Of such a pair the shorter word x (of equal ones each in turn) of m
characters gives two disjoint chunks of q = m / 2 characters, at 0 and at q; the
other word y, of m or m + 1 characters, gives its grams of q characters by
position.  One edit leaves one of the two chunks whole: the first in its place
(the edit is behind it), or the second in its place or, behind an insertion,
shifted by one.  So a join of chunks and grams on length, chunk number and
characters meets every near pair; grams at other places cannot hold a whole
chunk and are not made.  A candidate pair is verified, and taken only by the
first chunk that shows it, so no pair comes twice.

Crowded chunks.  A chunk that more than ``CROWD`` grams of one length
share is not joined as it is.  Its words are told apart by the rest:
equally long words by the rest with one character masked (a group has at most
one word for each character of the alphabet), the others by x's rest and y's
rest without one character.  Equality then is the verification, and all links
are kept in space linear in the words.

Defined results: a null text has no words; a null id alters none of its words;
words are told apart by their characters alone; repeated rows are each counted;
a word with no near word is its own root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm.common import drop_written, written

#: Most grams of words of one length that are joined by the chunk alone.
CROWD = 32
#: Characters of a word, and those that are lower-cased: fixed values of the contract.
WORD = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stand in a rest for the chunk and for a masked character; no word has them.
CUT, MASK = "|", "?"


def lowered_runs(text: Column) -> Column:
    """Maximal runs of word characters, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_counts(runs: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """Counts (word, n) of the column ``word``; counted within tasks before any shuffle."""
    kept = runs.where(F.length("word") >= least_length)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _chunks(words: DataFrame) -> DataFrame:
    """Both chunks of every word: x, m (length), side, chunk and what stands before and after it."""
    q = "(m div 2)"
    sides = F.expr(f"""explode(array(
        struct(0 as side, substring(x, 1, {q}) as chunk, '' as before, substring(x, {q} + 1) as after),
        struct(1 as side, substring(x, {q} + 1, {q}) as chunk, substring(x, 1, {q}) as before, substring(x, 2 * {q} + 1) as after)))""")
    return words.select(F.col("word").alias("x"), F.length("word").alias("m")).withColumn("s", sides).select("x", "m", "s.*")


def _grams(words: DataFrame) -> DataFrame:
    """Grams of every word that can meet a chunk: y, m (length of the other), more (own length - m), side, chunk, before, after."""
    def gram(q: str, side: int, shift: int) -> str:
        at = str(shift) if side == 0 else f"({q} + {shift})"
        return f"struct({side} as side, substring(y, {at} + 1, {q}) as chunk, substring(y, 1, {at}) as before, substring(y, {at} + {q} + 1) as after)"

    own, less = "(l div 2)", "((l - 1) div 2)"
    same = ", ".join(f"struct(l as m, 0 as more, {gram(own, side, 0)} as g)" for side in (0, 1))
    longer = ", ".join(f"struct(l - 1 as m, 1 as more, {gram(less, side, side)} as g)" for side in (0, 1))
    every = words.select(F.col("word").alias("y"), F.length("word").alias("l")).withColumn("s", F.expr(f"explode(array({same}, {longer}))"))
    return every.where("s.m > 0").select("y", "s.m", "s.more", "s.g.*")


#: A pair that both chunks show is taken by the first one.
_FIRST = "side = 0 or not startswith(y, substring(x, 1, m div 2))"


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs (x, y) of different words one edit apart, each once; of equally long ones x < y."""
    chunks, grams = _chunks(words), _grams(words)
    key = ["m", "side", "chunk"]
    crowded = grams.groupBy(*key, "more").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CROWD)
    crowded = written(crowded.groupBy(*key).agg(F.lit(True).alias("crowded")), "variants-crowded")
    x = chunks.join(crowded, key, "left")
    y = grams.join(crowded, key, "left")
    first = F.expr(_FIRST)
    pairs = x.where("crowded is null").drop("crowded", "before", "after").join(y.where("crowded is null").drop("crowded", "before", "after"), key)
    pairs = pairs.where("more = 1 or x < y").where(first).where(F.levenshtein("x", "y", 1) == 1)

    # Within a crowded chunk equality of what is left of the rests shows the pair.
    def rest(place: str) -> str:
        return f"concat(substring(rest, 1, i - 1), '{place}', substring(rest, i + 1))"

    x = x.where("crowded").withColumn("rest", F.concat("before", F.lit(CUT), "after"))
    y = y.where("crowded").withColumn("rest", F.concat("before", F.lit(CUT), "after"))
    # Equally long words have their chunk at the same place, so both sides make the same masks.
    places = "filter(sequence(1, length(rest)), i -> substring(rest, i, 1) <> '|')"
    masked = x.select("x", *key, F.expr(f"explode(transform({places}, i -> {rest(MASK)}))").alias("rest"))
    same = masked.join(masked.withColumnRenamed("x", "y"), [*key, "rest"]).where("x < y")
    fewer = y.where("more = 1").select("y", *key, F.explode(F.array_distinct(F.expr(f"transform({places}, i -> {rest('')})"))).alias("rest"))
    longer = x.select("x", *key, "rest").join(fewer, [*key, "rest"])
    met = same.select("x", "y", "m", "side").union(longer.select("x", "y", "m", "side"))
    return pairs.select("x", "y").union(met.where(first).select("x", "y"))


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words (word, n), each word once.

    ``form``: the near word of largest n (ties: the first in code-point order) if
    that n is ``factor`` or more times the word's own, else null.  ``root``: where
    following forms from the word ends.  Forms grow by the factor each time, so
    a chain ends after few steps; pointers are doubled until none moves.
    """
    words = written(words.select("word", "n"), "variants-words")
    pairs = written(near_pairs(words), "variants-pairs")
    ends = pairs.select(F.col("x").alias("word"), F.col("y").alias("near")).union(pairs.select(F.col("y").alias("word"), F.col("x").alias("near")))
    sized = ends.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    taken = F.coalesce(-F.col("best.n") >= factor * F.col("n"), F.lit(False))
    formed = words.join(best, "word", "left").select(
        "word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, -F.col("best.n")).alias("form_n"))
    formed = written(formed, "variants-formed")
    drop_written(pairs)
    drop_written(words)
    # Only words with a form have a pointer; one whose target has none has arrived.
    pointers = written(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")), "variants-pointers")
    moving = not pointers.isEmpty()
    while moving:
        beyond = pointers.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        following = written(pointers.join(beyond, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "variants-pointers")
        drop_written(pointers)
        moving = not following.where("moved").isEmpty()
        pointers = following.select("word", "to")
    out = formed.join(pointers, "word", "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
