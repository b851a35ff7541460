"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from annolens.session import scratch_path

#: Bytes of text that one numpy pass works on; temporaries are a few dozen times this.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting by which a statement's shuffle files go when it ends, not when the driver next collects its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Statements run inside leave no shuffle files behind."""
    old = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, but compressed and by column; the files
    survive the loss of any executor.  Shuffle files of the steps before are
    not needed any more then and go at once; broadcasts go with the plans that
    the driver has let go, which a collection there makes Spark notice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_let_go(spark):
        df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a frame made by ``written`` once nothing will read it again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def byte_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the row offsets (n + 1); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) of at most ``limit`` bytes; a longer row is a run of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + len), one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def sha256_hex(data) -> str:
    return hashlib.sha256(data).hexdigest()


# Words of the byte-level operators: fixed values of their contract.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(64, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (multiply, shift, xor)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_bytes(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(low: np.ndarray, offsets: np.ndarray, member: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of member bytes; runs never cross a row."""
    mask = member[low]
    inner = offsets[1:-1]
    edge = np.zeros(len(low) + 1, bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[inner] = True
    edge[0] = edge[-1] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = mask[starts] if len(starts) and len(low) else np.zeros(0, bool)
    return (starts[keep], ends[keep]) if len(low) else (np.empty(0, np.int64), np.empty(0, np.int64))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial in its bytes, mixed with its length."""
    global _POWERS
    lens = ends - starts
    if not len(lens):
        return np.empty(0, np.uint64)
    longest = int(lens.max())
    if longest > len(_POWERS):
        step = np.full(longest, _PRIME)
        step[0] = 1
        _POWERS = np.multiply.accumulate(step)
    elif _POWERS[1] == 1:
        step = np.full(64, _PRIME)
        step[0] = 1
        _POWERS = np.multiply.accumulate(step)
    at = ragged(starts, lens)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
    terms = (low[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    sums = np.add.reduceat(terms, np.cumsum(lens) - lens)
    return mix64(sums + mix64(lens.astype(np.uint64)))
