"""Benchmark decontamination by suffix arrays over the training documents.

The words of a block of documents (a shard) become ranks in the benchmark's
sorted vocabulary; words outside it are breaks.  The shard's suffix array is
the order of its suffixes by their first ``window`` ranks, kept for the
positions that can matter: a whole window stands there without a break, and
its first word begins some benchmark suffix.  Every benchmark suffix is looked
up in it by binary search; the range found gives the places of a match, and
places on one diagonal (document position less item position) are chained
into the longest verbatim match (``locations``).  To judge a document its
covered words and the items met are enough: every place counts once, however
many items hold its words (``find_contamination``).  An item of fewer words than a window is
looked up whole, in the array of its own length.

Shards are independent, so nothing is shuffled.  The benchmark is sent to the
tasks in blocks of a bounded size, one pass over the documents for each block:
one pass up to ``BLOCK_MB`` of benchmark text, and more passes beyond it, each
adding its matches to the rows.

Words are compared by 64-bit hashes first; a word whose hash is in the
vocabulary is then compared byte for byte.

Defined results: null and empty texts have no words and no hits; a benchmark
row without words matches nothing; repeated rows of the documents are judged
each; rows of the benchmark with one id are one item; the words of a row with
a null item id count as hits, but the row is not listed as an item.  Extra
columns are kept or left out as asked, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolens.llm.common import byte_column, drop_written, lower_bytes, ragged, row_blocks, word_hashes, word_spans, written

#: Benchmark text that one pass over the documents takes along, in MB.
BLOCK_MB = 16
#: Bytes of document text of one shard.
SHARD = 4 << 20
#: Pairs of a place and an item that are chained together at a time, about.
MATCHES = 1 << 20

_MATCH = ("item_word", "word_start", "n_words", "byte_start", "byte_end")
FOUND = "struct<n_words:long,n_hit:long,items:array<string>,ranges:array<struct<start:long,n:long>>>"


class Benchmark:
    """Words, vocabulary and suffixes of a block of benchmark items."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        buf, off = byte_column(pa.array(texts, pa.string()))
        low = lower_bytes(buf)
        starts, ends = word_spans(low, off)
        hashes = word_hashes(low, starts, ends)
        self.ids = ids
        self.vocab, first, rank = np.unique(hashes, return_index=True, return_inverse=True)
        self.word_len = (ends - starts)[first]
        self.word_at = np.cumsum(self.word_len) - self.word_len
        self.word_bytes = low[ragged(starts[first], self.word_len)]
        rank = rank.astype(np.int64) + 1  # 0 is a break
        n = np.bincount(np.searchsorted(off, starts, side="right") - 1, minlength=len(ids))
        first_of = np.cumsum(n) - n
        #: By length: distinct patterns in order, and where each occurs (item, first word), pattern by pattern.
        self.patterns: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(np.minimum(n[n > 0], window)).tolist():
            whole = np.flatnonzero(n == length) if length < window else np.flatnonzero(n >= window)
            count = n[whole] - length + 1
            at = ragged(first_of[whole], count)
            distinct, which, times = np.unique(_keys(rank, at, length), return_inverse=True, return_counts=True)
            order = np.argsort(which, kind="stable")
            owner = np.repeat(whole, count)
            self.patterns[length] = (distinct, times, owner[order], (at - first_of[owner])[order])

    def ranks(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank (from 1) of each word in the vocabulary, or 0."""
        out = np.zeros(len(starts), np.int64)
        if not len(self.vocab):
            return out
        hashes = word_hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        hit = np.flatnonzero((self.vocab[at] == hashes) & (self.word_len[at] == ends - starts))
        lens = self.word_len[at[hit]]
        same = low[ragged(starts[hit], lens)] == self.word_bytes[ragged(self.word_at[at[hit]], lens)]
        wrong = np.zeros(len(hit), bool)
        wrong[np.repeat(np.arange(len(hit)), lens)[~same]] = True
        out[hit[~wrong]] = at[hit[~wrong]] + 1
        return out


def _keys(rank: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` ranks from each position as byte strings in the order of the ranks."""
    if not len(at):
        return np.empty(0, f"S{4 * length}")
    rows = np.ascontiguousarray(rank[at[:, None] + np.arange(length)].astype(">u4"))
    return rows.view(f"S{4 * length}").ravel()


def _places(rank: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Positions from which ``length`` words follow without a break inside one document."""
    ok = rank > 0
    ends = np.flatnonzero(np.append(~ok[1:] | (doc[1:] != doc[:-1]), True) & ok) + 1 if len(ok) else np.empty(0, np.int64)
    begins = np.flatnonzero(np.append(True, ~ok[:-1] | (doc[1:] != doc[:-1])) & ok) if len(ok) else ends
    return ragged(begins, np.maximum(ends - begins - length + 1, 0))


def _looked_up(bench: Benchmark, rank: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
    """For every length of pattern: the places of a shard in suffix order, and the range of it that each pattern has."""
    for length, (patterns, times, owner, offset) in bench.patterns.items():
        heads = np.zeros(len(bench.vocab) + 1, bool)
        heads[patterns.view(">u4").reshape(-1, length)[:, 0].astype(np.int64)] = True
        at = _places(rank, doc, length)
        at = at[heads[rank[at]]]
        keys = _keys(rank, at, length)
        order = np.argsort(keys, kind="stable")  # the suffix array
        array = keys[order]
        lo, hi = (np.searchsorted(array, patterns, side=s) for s in ("left", "right"))
        if (hi > lo).any():
            yield length, at[order], lo, hi, times, owner, offset


def shard_cover(bench: Benchmark, rank: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a shard stand in a match, and the different pairs (document, item).

    Places count once, however many items hold their words.
    """
    step, pairs = np.zeros(len(rank) + 1, np.int64), [np.empty((2, 0), np.int64)]
    for length, places, lo, hi, times, owner, _ in _looked_up(bench, rank, doc):
        n = hi - lo
        where = places[ragged(lo[n > 0], n[n > 0])]
        np.add.at(step, where, 1)
        np.add.at(step, where + length, -1)
        which = np.repeat(np.flatnonzero(n > 0), n[n > 0])
        met = np.unique(doc[where] * len(times) + which)  # documents and patterns
        d, which = met // len(times), met % len(times)
        many = times[which]
        item = owner[ragged((np.cumsum(times) - times)[which], many)]
        both = np.unique(np.repeat(d, many) * len(bench.ids) + item)
        pairs.append(np.stack([both // len(bench.ids), both % len(bench.ids)]))
    return np.cumsum(step[:-1]) > 0, np.unique(np.concatenate(pairs, axis=1), axis=1)


def shard_matches(bench: Benchmark, rank: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
    """Longest verbatim matches of a shard: columns item, first word in the item, first word in the shard, words.

    Item by item, so that no more than about ``MATCHES`` pairs of a place and an item are in memory.
    """
    for length, places, lo, hi, times, owner, offset in _looked_up(bench, rank, doc):
        pattern = np.repeat(np.arange(len(times)), times)
        n = (hi - lo)[pattern]
        of_item = np.bincount(owner, weights=n, minlength=len(bench.ids))
        group = (np.cumsum(of_item) // MATCHES).astype(np.int64)[owner]
        for g in np.unique(group[n > 0]).tolist():
            take = np.flatnonzero((group == g) & (n > 0))
            where = places[ragged(lo[pattern[take]], n[take])]
            item, word = np.repeat(owner[take], n[take]), np.repeat(offset[take], n[take])
            by = np.lexsort((where, where - word, item))
            where, item, word = where[by], item[by], word[by]
            new = np.append(True, (item[1:] != item[:-1]) | (where[1:] != where[:-1] + 1) | (word[1:] != word[:-1] + 1))
            new[1:] |= doc[where[1:]] != doc[where[:-1]]
            first = np.flatnonzero(new)
            run = np.diff(np.append(first, len(where)))
            yield np.stack([item[first], word[first], where[first], run - 1 + length])


def _shards(batch: pa.RecordBatch, text: str, bench: Benchmark) -> Iterator[tuple]:
    """For each shard lo to hi: the words' ranks, documents, starts and ends, and every document's words and first byte."""
    buf, off = byte_column(batch.column(text))
    for lo, hi in row_blocks(off, SHARD):
        low = lower_bytes(buf[off[lo] : off[hi]])
        own = off[lo : hi + 1] - off[lo]
        starts, ends = word_spans(low, own)
        doc = np.searchsorted(own, starts, side="right") - 1
        yield lo, hi, bench.ranks(low, starts, ends), doc, starts, ends, np.bincount(doc, minlength=hi - lo), own[:-1]


def _ranges(cover: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Covered words of each document, and its covered ranges (start, n)."""
    inside = np.append(True, doc[1:] == doc[:-1])[: len(doc)]
    begins = cover & ~(np.append(False, cover[:-1])[: len(cover)] & inside)
    first = np.flatnonzero(begins)
    size = np.diff(np.append(np.cumsum(cover)[first] - 1, cover.sum())) if len(first) else first
    of = doc[first]
    items = pa.StructArray.from_arrays([pa.array(first - (np.cumsum(n) - n)[of], pa.int64()), pa.array(size, pa.int64())], names=["start", "n"])
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(n))))
    return np.bincount(doc[cover], minlength=len(n)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def _pass(docs: DataFrame, text: str, out: str, keep: list[str], sent, window: int) -> DataFrame:
    """One block of the benchmark against all documents; adds to what ``out`` already holds."""
    kept = [c for c in keep if c != out]
    schema = T.StructType([docs.schema[c] for c in kept]).add(out, T._parse_datatype_string(FOUND))
    before = out in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*sent.value, window)
        for b in batches:
            for lo, hi, rank, doc, _, _, n, _ in _shards(b, text, bench):
                cover, (d, i) = shard_cover(bench, rank, doc)
                items: list[set] = [set() for _ in range(hi - lo)]
                for k, item in zip(d.tolist(), i.tolist(), strict=True):
                    if bench.ids[item] is not None:
                        items[k].add(bench.ids[item])
                part = b.slice(lo, hi - lo)
                if before:
                    first = np.cumsum(n) - n
                    for k, old in enumerate(part.column(out).to_pylist()):
                        items[k].update(old["items"])
                        for r in old["ranges"]:
                            cover[first[k] + r["start"] : first[k] + r["start"] + r["n"]] = True
                hit, ranges = _ranges(cover, doc, n)
                found = pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), ranges], names=["n_words", "n_hit", "items", "ranges"])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def _items(benchmark: DataFrame, item: str, item_text: str) -> tuple[DataFrame, int]:
    """The different items with a text, and into how many blocks they are dealt."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("words")).where("words is not null").distinct()
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    return items, max(1, -(-size // (BLOCK_MB << 20)))


def _sent(items: DataFrame, blocks: int, k: int):
    """Block k of the items as a broadcast: its size is bounded."""
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
    rows = part.collect()
    return items.sparkSession.sparkContext.broadcast(([r["item"] for r in rows], [r["words"] for r in rows]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", out: str = "found",
                       keep: list[str] | None = None, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add to every document a struct ``out``: n_words, n_hit, items, ranges.

    ``items`` are the ids, as strings, of the items with a match, each once;
    ``ranges`` the runs of words (start, n) that stand in matches.  ``keep``
    are the columns kept (all, if not given).  With several blocks of the
    benchmark each pass is written before the next, and its block is let go.
    """
    keep = [c for c in docs.columns if c != out] if keep is None else keep
    source = docs.select(*dict.fromkeys([*keep, text]))
    items, blocks = _items(benchmark, item, item_text)
    for k in range(blocks - 1):
        sent = _sent(items, blocks, k)
        following = written(_pass(source, text, out, [*dict.fromkeys([*keep, text])], sent, window), "decontam-pass")
        sent.destroy()
        if k:
            drop_written(source)
        source = following
    return _pass(source, text, out, keep, _sent(items, blocks, blocks - 1), window)


def locations(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text",
              item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each longest verbatim match of a document with a benchmark item.

    key, item (as a string), the first word in the item and in the document,
    the words, and the byte range in the text's UTF-8 form.
    """
    source = docs.select(key, text)
    schema = T.StructType([docs.schema[key], T.StructField("item", T.StringType()), *(T.StructField(c, T.LongType()) for c in _MATCH)])
    items, blocks = _items(benchmark, item, item_text)

    def one_pass(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*sent.value, window)
            for b in batches:
                for lo, hi, rank, doc, starts, ends, n, begin in _shards(b, text, bench):
                    first = np.cumsum(n) - n
                    for i, word, where, length in shard_matches(bench, rank, doc):
                        d = doc[where]
                        table = (word, where - first[d], length, starts[where] - begin[d], ends[where + length - 1] - begin[d])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).slice(lo, hi - lo).take(pa.array(d)), pa.array([bench.ids[x] for x in i.tolist()], pa.string()), *(pa.array(x, pa.int64()) for x in table)], names=schema.names)

        return source.mapInArrow(run, schema)

    return reduce(DataFrame.union, [one_pass(_sent(items, blocks, k)) for k in range(blocks)])


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id") -> DataFrame:
    """One row per document: words, hit words, items, and whether it is contaminated."""
    found = find_contamination(docs, benchmark, window, out="found", keep=[key])
    items = F.col("found.items")
    return found.select(
        F.col(key), F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The documents that share no window with the benchmark, with all their columns."""
    flag = "found"
    while flag in docs.columns:
        flag += "_"
    return find_contamination(docs, benchmark, window, text=text, out=flag).where(F.col(flag)["n_hit"] == 0).drop(flag)
