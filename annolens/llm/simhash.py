"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``max_bits + 2`` blocks.  Two fingerprints
that differ in at most ``max_bits`` bits agree in at least two of the blocks,
so each fingerprint is filed once under every pair of its blocks, fingerprints
under one key are joined, and the Hamming distance of each pair is verified.
Equal fingerprints are one entry from the start, so copies make no pairs.

A key that more than ``BUCKET`` different fingerprints share makes no pairs
either.  There, each fingerprint is filed under itself and under every value
one bit away from it outside the shared blocks.  Fingerprints in one such file
differ in at most two bits, and any two that differ in at most two bits have a
file in common: linking each to the first of its file keeps every link, with a
number of rows in proportion to the input.  A file holds at most one entry for
each bit, so it needs no limit.

Defined results: a null or empty text, or one of white space, has fingerprint
zero and is linked like any other; a text of fewer words than a shingle has
one shingle, the whole sequence.  Repeated rows give repeated rows.  A null id
is kept as an id; a component of null ids only has a null component_id.
Columns besides the id and the text are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolens.llm.common import written
from annolens.llm.components import components

#: Different fingerprints under one key up to which pairs are joined.
BUCKET = 16
#: Bytes of a text whose words are held at a time.
SLICE = 1 << 20
#: Seed of XXH64: fixed value of the fingerprint.
SEED = 42

_hash = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def _word_runs(text: bytes, k: int) -> Iterator[list[bytes]]:
    """The words in runs of one slice; a run begins with the last k - 1 words of the one before."""
    if len(text) <= SLICE:
        yield text.lower().split()
        return
    carry, tail = [], b""
    for at in range(0, len(text), SLICE):
        data = tail + text[at : at + SLICE].lower()
        words, tail = data.split(), b""
        if at + SLICE < len(text) and words and not data[-1:].isspace():
            tail = words.pop()
        words = carry + words
        if len(words) >= k or at + SLICE >= len(text):
            yield words
            carry = words[len(words) - (k - 1) :] if k > 1 else []
        else:
            carry = words


def fingerprint(text: bytes, k: int = 3) -> int:
    """The fingerprint of one text: ASCII lower case, k-word shingles with repeats."""
    ones, n, first = np.zeros(64, np.int64), 0, True
    for words in _word_runs(text, k):
        if len(words) >= k:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
            count = len(words) - k + 1
        elif words and first:
            shingles, count = [b" ".join(words)], 1
        else:
            continue
        first = False
        h = np.fromiter(map(_hash, shingles), np.uint64, count)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += count
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed long."""
    source = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py() or b"", words) for x in b.column("body")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(fp.view(np.int64))], names=["key", "fp"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("fp", T.LongType())])
    return source.mapInArrow(run, schema)


def _masks(max_bits: int) -> list[int]:
    """Masks of every pair of blocks, as signed longs."""
    parts = max_bits + 2
    edge = [64 * i // parts for i in range(parts + 1)]
    block = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(parts)]
    return [int(np.uint64(a | b).view(np.int64)) for a, b in itertools.combinations(block, 2)]


def links(distinct_fp: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between different fingerprints at most ``max_bits`` (0 to 2) bits apart.

    Every two such fingerprints are linked, directly or through others that are
    themselves that close; every edge given is that close.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    masks = _masks(max_bits)
    table = F.array(*(F.struct(F.lit(i).alias("tag"), F.lit(m).alias("mask")) for i, m in enumerate(masks)))
    filed = distinct_fp.select("fp", F.explode(table).alias("m")).select("fp", F.col("m.tag").alias("tag"), F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("block"))
    sizes = filed.groupBy("tag", "block").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(filed.join(sizes, ["tag", "block"]), "simhash-blocks")

    few = shared.where(F.col("n") <= BUCKET)
    other = few.select("tag", "block", F.col("fp").alias("b"))
    pairs = few.select("tag", "block", F.col("fp").alias("a")).join(other, ["tag", "block"]).where("a < b").select("a", "b")

    flips = [0, *(int(np.uint64(1 << i).view(np.int64)) for i in range(64))]
    many = shared.where(F.col("n") > BUCKET).select("tag", "mask", "fp", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    many = many.where(F.col("flip").bitwiseAND(F.col("mask")) == 0)
    files = many.groupBy("tag", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    if max_bits == 2:
        starred = files.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b"))
    else:  # the file's members may be two bits apart: all pairs of its few members
        starred = files.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b")).where("a < b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.union(starred).where((F.col("a") != F.col("b")) & near).distinct()


def _components_of(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) for the fingerprints of rows: the least fingerprint reachable over links."""
    distinct_fp = rows.select("fp").distinct()
    roots = components(links(distinct_fp, max_bits), "simhash")
    return distinct_fp.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """Of every group of near-duplicate rows exactly one: that of the smallest id (null ids last), then fingerprint.

    Decided row by row: a row of an id goes or stays whatever happens to other
    rows of that id.  Of rows that agree in id and text the smallest in the
    other columns stays.
    """
    def free(name: str) -> str:
        while name in df.columns:
            name += "_"
        return name

    # 128 bits stand for a text
    one, two = free("text_hash"), free("text_hash_2")
    marked = df.withColumn(one, F.xxhash64(text)).withColumn(two, F.xxhash64(F.lit(1), text))
    source = marked.select(F.col(key).alias("key"), F.col(one).alias("one"), F.col(two).alias("two"), F.col(text).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py() or b"", words) for x in b.column("body")], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps.view(np.int64))], names=["key", "one", "two", "fp"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("one", "two", "fp"))])
    rows = written(source.mapInArrow(run, schema), "simhash-rows")
    rooted = rows.groupBy("key", "one", "two", "fp").agg(F.count("*").alias("n")).join(_components_of(rows, max_bits), "fp")
    rooted = written(rooted, "simhash-rooted")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "fp", "one", "two")
    best = rooted.groupBy("root").agg(F.min(place).alias("best"))
    judged = rooted.join(best, "root").select("key", "one", "two", "n", (place == F.col("best")).alias("stays"))
    judged = written(judged, "simhash-judged")

    def among(left: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("key").alias("__key"), F.col("one").alias("__one"), F.col("two").alias("__two"))
        return left.join(some, left[key].eqNullSafe(some["__key"]) & (left[one] == some["__one"]) & (left[two] == some["__two"]), how)

    stay = among(marked, judged.where("not stays"), "left_anti")
    repeated = judged.where("stays and n > 1")
    if not repeated.isEmpty():
        least = among(stay, repeated, "left_semi").groupBy(key, one, two).agg(F.min(F.struct(*df.columns)).alias("row"))
        stay = among(stay, repeated, "left_anti").select(df.columns).unionByName(least.select("row.*"))
    return stay.select(df.columns)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(key, fingerprint, component_id) for every row: the smallest id reachable over links."""
    rows = written(fingerprints(df, key, text, words), "simhash-fingerprints")
    first = rows.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(links(first.select("fp"), max_bits), "simhash")
    rooted = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(F.col("key").alias(key), hexed.alias("fingerprint"), "component_id")
