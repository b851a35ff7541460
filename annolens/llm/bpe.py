"""Byte-level BPE encoding and decoding with length-bucketed padded matrices.

A text is cut by the pre-token pattern; the distinct pieces of a block are put
into padded matrices by length (4, 8, 16, 32, 64 bytes).  In each round every
row of a matrix merges its leftmost pair of least rank; rows without a pair
left are taken out (compaction).  The rank of a pair comes from an
open-addressing hash table held in numpy arrays.

A piece over 64 bytes has a one-row form: each round merges all occurrences of
the least rank, left to right without overlap.  The result is the same, since
a merged token only takes part in pairs of a greater rank.

Defined results: a null text is an empty one; an empty text has no ids; texts
are whole, of any length; repeated rows are each encoded; other columns of the
input are kept by ``encode``/``decode`` (a clashing output name is replaced).
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from annolens.llm.common import byte_column, ragged, row_blocks

#: Distinct pieces that a worker remembers before it starts anew.
CACHE_PIECES = 1 << 18
#: Widths of the padded matrices, in bytes; longer pieces are merged one by one.
WIDTHS = (4, 8, 16, 32, 64)
#: Bytes of text for one block of a worker.
BLOCK = 1 << 20

_NONE = np.int32(0x7FFFFFFF)


class Vocabulary:
    """Ranks of one vocabulary file, as lookup arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        names = [b""] * size
        for token, i in self.ranks.items():
            names[i] = token
        self.bytes_flat, self.bytes_len, self.bytes_at = _flat(names)
        self.text_flat, self.text_len, self.text_at = _flat([b"%d " % i for i in range(size)])
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, to = [], [], []
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(i)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self._build(keys, np.array(to, np.int32))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << bits, _NONE, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):  # one probe for all that are left; the first of a slot wins
            self.probes += 1
            free = self.values[slot[todo]] == _NONE
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE; a negative id (padding) has no pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        keys = np.where((left < 0) | (right < 0), np.uint64(0xFFFFFFFFFFFFFFFE), keys)
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.values[slot] != _NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = self.keys[slot[open_]] == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (self.values[slot[open_]] != _NONE)]
        return found

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > WIDTHS[-1]:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(next(w for w in WIDTHS if w >= len(piece)), []).append(i)
        for width, where in buckets.items():
            for lo in range(0, len(where), 1 << 14):
                part = where[lo : lo + (1 << 14)]
                for i, ids in zip(part, self._merge_matrix([pieces[j] for j in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.of_byte[raw], np.int32(-1))
        ids = np.concatenate([ids, np.full((len(ids), 2), -1, np.int32)], axis=1)
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        row, done = np.arange(len(ids)), [None] * len(pieces)
        place = np.arange(ids.shape[1])
        while len(row):
            at = rank.argmin(axis=1)  # the leftmost pair of least rank
            every = np.arange(len(row))
            least = rank[every, at]
            over = least == _NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[row[k]] = ids[k][ids[k] >= 0].copy()
                live = ~over
                ids, rank, row, at, least = ids[live], rank[live], row[live], at[live], least[live]
                every = np.arange(len(row))
                if not len(row):
                    break
            # close the gap behind the merged pair
            take = np.minimum(place + (place > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ids[every, at] = least
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, take[:, :-1].clip(max=rank.shape[1] - 1), axis=1)
            rank[:, -1] = _NONE
            rank[every, at] = self.pair_ranks(least, ids[every, at + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], least[left])
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        rank = self.pair_ranks(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != _NONE:
            at = np.flatnonzero(rank == least)
            # of pairs that overlap, every second one from the left
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) > 1
            run = np.maximum.accumulate(np.where(new, at, 0))
            at = at[(at - run) % 2 == 0]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            now = at - np.arange(len(at))  # where the merged tokens stand now
            rank = rank[keep[1:]]  # pair i goes with its right token; those beside a merge are looked up anew
            for k in (now[now < len(rank)], now[now > 0] - 1):
                rank[k] = self.pair_ranks(ids[k], ids[k + 1])
        return ids


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), lens, np.cumsum(lens) - lens


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes whole texts; remembers the ids of the distinct pieces it has met."""

    def __init__(self, path: str, pattern: str):
        self.vocab, self.pieces = vocabulary(path), regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.len = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of ids of each."""
        if len(self.known) > CACHE_PIECES:
            self._clear()
        known, new, cut = self.known, [], []
        for text in texts:
            parts = self.pieces(text)
            for p in set(parts).difference(known):
                known[p] = len(known)
                new.append(p)
            cut.append(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
        if new:
            ids = self.vocab.merge([p.encode() for p in new])
            lens = np.array([len(x) for x in ids], np.int64)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lens) - lens])
            self.len = np.concatenate([self.len, lens])
            self.flat = np.concatenate([self.flat, *ids])
        which = np.concatenate(cut) if cut else np.empty(0, np.int64)
        lens = self.len[which]
        ids = self.flat[ragged(self.at[which], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(ends)


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that the ids stand for."""
    return vocab.bytes_flat[ragged(vocab.bytes_at[ids], vocab.bytes_len[ids])]


def decimal_ids(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The decimal ids as bytes, each followed by one space."""
    return vocab.text_flat[ragged(vocab.text_at[ids], vocab.text_len[ids])]


def _encoded(batch: pa.RecordBatch, col: str, encoder: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    text = batch.column(col)
    _, off = byte_column(text)
    for lo, hi in row_blocks(off, BLOCK):
        ids, n = encoder.encode([t or "" for t in text.slice(lo, hi - lo).to_pylist()])
        yield lo, hi, ids, n


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each whole text as an array column."""
    keep = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for b in batches:
            for lo, hi, flat, n in _encoded(b, text, encoder):
                off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                part = b.slice(lo, hi - lo)
                cols = [part.column(c) for c in keep] + [pa.ListArray.from_arrays(off, pa.array(flat))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, ids])

    return df.mapInArrow(run, _with(df.schema, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of each id array as a binary column (null: empty)."""
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            lists = b.column(ids)
            data = [decode_ids(vocab, np.asarray(x.values if x.is_valid else [], np.int64)).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(data, pa.binary())], names=[*keep, out])

    return df.mapInArrow(run, _with(df.schema, out, T.BinaryType()))


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: key, n_tokens, ids_sha256, decoded_sha256.

    Holds one block of ids at a time, so that no id array crosses into Spark.
    """
    source = df.select(key, text)
    schema = T.StructType([source.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        vocab = encoder.vocab
        for b in batches:
            for lo, hi, ids, n in _encoded(b, text, encoder):
                ends = np.cumsum(n)
                shown, plain = [], []
                for i in range(hi - lo):
                    own = ids[ends[i] - n[i] : ends[i]]
                    first, second = hashlib.sha256(), hashlib.sha256()
                    for at in range(0, len(own), BLOCK):  # long texts piece by piece
                        part = own[at : at + BLOCK]
                        digits = decimal_ids(vocab, part)
                        first.update(digits[: len(digits) - (at + BLOCK >= len(own))].tobytes())
                        second.update(decode_ids(vocab, part).tobytes())
                    shown.append(first.hexdigest())
                    plain.append(second.hexdigest())
                cols = [b.column(key).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(shown), pa.array(plain)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)
