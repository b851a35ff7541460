"""Removal of repeated byte strings by longest previous factors.

A byte goes if it lies in a ``length``-byte string that also starts in a
document of a smaller id.  In a suffix array, the longest previous factor of a
suffix is its longer common prefix with the previous and the next suffix (in
suffix order) of a smaller position.  It reaches ``length`` exactly if one of
the two lies in the run of suffixes that agree in their first ``length``
bytes, that is, if the suffix is not of the smallest document of its run.  So
suffixes are sorted by their first ``length`` bytes, and the smallest document
of each run keeps its copy.

One suffix array over a corpus would be a single task, so the suffixes are
dealt out by content.  Of the ``GRAM``-byte strings in a window of ``length``
bytes the one of least hash is the window's anchor; equal windows have equal
anchors.  Consecutive windows with one anchor are a segment, with one window
for some twenty bytes of text.  Documents are dealt to parts of a bounded
size, and the steps are:

1. each part tells which anchors it has; anchors of two documents are shared;
2. each part tells the segments with shared anchors (by a 128-bit hash of the
   segment's bytes) and the smallest document of each; the smallest document
   of all owns the segment, and in all others every window of it goes;
3. where an anchor has several different segments, their owners send the
   bytes; all segments of one anchor meet, their windows are sorted as suffixes, and windows that start in a
   smaller document, too, are reported to the owner;
4. each part removes what was reported.

Parts read the documents from one shuffle.  What a part tells is distinct, so
a passage in very many documents arrives once from each part.  An anchor with
more than ``HOT`` documents does not meet in one task in step 3: its windows
are grouped by a 128-bit hash each instead, with a map-side minimum.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; rows of one id are one document and do not remove from each other;
rows without an id lose nothing and remove nothing; texts are whole, of any
length.  Columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm.common import byte_column, mix64, ragged, written

#: Bytes of text of a part, about.
PART_BYTES = 16 << 20
#: Bytes of the strings that anchors are chosen from.
GRAM = 16
#: Documents of an anchor beyond which its windows are grouped one by one.
HOT = 100_000
#: Bytes that one numpy pass takes, and the windows that a segment has at most (bits of a flag word).
STEP, WINDOWS = 1 << 17, 64
#: Segments whose windows are sorted together.
SORTED = 20_000

_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
_rnd = np.random.default_rng(2024)
_BASE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_TABLE = [_rnd.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in _BASE]
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of both bases, and of their inverses, for the positions of a pass."""
    if not _POWERS:
        for base in _BASE:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            for x in (base, inverse):
                row = np.full(2 * STEP, x)
                row[0] = 1
                _POWERS.append(np.multiply.accumulate(row))
    return _POWERS


class Segments:
    """Segments of the rows of one part, in order: anchor, start, windows, row, key (hash of the bytes)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, length: int):
        parts = [self._pass(buf, off, length, lo) for lo in range(0, max(1, len(buf)), STEP)]
        self.anchor, self.at, self.n, self.row, self.key = (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _pass(buf: np.ndarray, off: np.ndarray, length: int, lo: int) -> tuple[np.ndarray, ...]:
        chunk = buf[lo : lo + STEP + length - 1]
        if len(chunk) < length:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _KEY)
        x = chunk.astype(np.uint64)
        x = x[:-1] | x[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        x = x[:-4] | x[4:] << np.uint64(32)  # eight bytes from each position
        least = mix64(mix64(x[: -(GRAM - 8)]) + x[GRAM - 8 :])
        wide, size = length - GRAM + 1, 1  # sliding minimum over the strings of a window
        while 2 * size <= wide:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < wide:
            least = np.minimum(least[: size - wide], least[wide - size :])
        start = np.arange(len(least))
        r0, r1 = (int(x) for x in np.searchsorted(off, [lo, lo + len(least) - 1], side="right") - 1)
        row = np.repeat(np.arange(r0, r1 + 1), np.diff(np.clip(off[r0 : r1 + 2], lo, lo + len(least))))
        inside = lo + start + length <= off[row + 1]
        cut = np.ones(len(least) + 1, bool)
        cut[1:-1] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
        edge = np.flatnonzero(cut)
        first, count = edge[:-1], np.diff(edge)
        first, count = first[inside[first]], count[inside[first]]
        pieces = -(-count // WINDOWS)  # a long run (of equal strings) makes several
        order = ragged(np.zeros(len(pieces), np.int64), pieces)
        begin = np.repeat(first, pieces) + order * WINDOWS
        n = np.minimum(np.repeat(count, pieces) - order * WINDOWS, WINDOWS)
        key = np.empty(len(begin), _KEY)
        powers = _powers()
        for name, table, up, down in (("a", _TABLE[0], powers[0], powers[1]), ("b", _TABLE[1], powers[2], powers[3])):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[chunk] * up[: len(chunk)], dtype=np.uint64)])
            key[name] = mix64((total[begin + n + length - 1] - total[begin]) * down[begin] + n.astype(np.uint64))
        return least[begin], lo + begin, n, row[begin], key


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _in(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each key stands among the known keys, or -1."""
    if not len(known) or not len(key):
        return np.full(len(key), -1)
    order = np.lexsort((known["b"], known["a"]))
    have = known[order]
    lo = np.searchsorted(have["a"], key["a"], side="left")
    out = np.full(len(key), -1)
    open_ = np.flatnonzero(lo < len(have))
    while len(open_):  # keys that share their first half are next to each other
        at = lo[open_]
        same = have["a"][at] == key["a"][open_]
        open_, at = open_[same], at[same]
        hit = have["b"][at] == key["b"][open_]
        out[open_[hit]] = order[at[hit]]
        open_ = open_[~hit]
        lo[open_] += 1
        open_ = open_[lo[open_] < len(have)]
    return out


def _first_by_key(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one entry of the smallest document for each key, and for each entry that document."""
    order = np.lexsort((doc, key["b"], key["a"]))
    k = key[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.empty(0, bool)
    first = order[new]
    least = np.empty(len(key), np.int64)
    least[order] = doc[first][np.cumsum(new) - 1]
    return first, least


class Part:
    """The documents of one part, by id, and their segments."""

    def __init__(self, rows: pa.Table, length: int):
        ids = rows.column("doc").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.buf, self.off = byte_column(rows.column("body").take(pa.array(order)))
        self.docs = ids[order]
        self.seg = Segments(self.buf, self.off, length)
        self.doc = self.docs[self.seg.row]

    def slots(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and remainder of each segment's anchor; both together nearly identify it."""
        a = self.seg.anchor
        return ((a >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (a & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _message(part_or_bucket: list, other: list, data: list[bytes], names: tuple[str, str]) -> pa.Table:
    return pa.table({names[0]: pa.array(part_or_bucket, pa.int32()), names[1]: pa.array(other, pa.int32()), "data": pa.array(data, pa.binary())})


_ANCHOR = np.dtype([("rest", "<u4"), ("docs", "<u4")])
_OWNED = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("rest", "<u4"), ("hot", "u1")])
_ASKED = np.dtype([("a", "<u8"), ("b", "<u8"), ("hot", "u1")])
_FLAG = np.dtype([("a", "<u8"), ("b", "<u8"), ("bits", "<u8")])
_ALL, _OWN, _BITS = 1, 2, 3


def _split(bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    have, first = np.unique(bucket[order], return_index=True)
    yield from zip(have.tolist(), np.split(rows[order], first[1:]), strict=True)


def _anchors(rows: pa.Table, length: int, parts: int) -> pa.Table:
    """Step 1, of a part: its different anchors and in how many documents they are."""
    part = Part(rows, length)
    bucket, rest = part.slots(parts)
    # Segments lie in the order of documents, so a stable sort by anchor leaves equal documents side by side.
    slot = (bucket.astype(np.int64) << 32) | rest.astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, row = slot[order], part.seg.row[order]
    first = np.append(True, slot[1:] != slot[:-1])[: len(slot)]
    fresh = first | np.append(True, row[1:] != row[:-1])[: len(slot)]
    begins = np.flatnonzero(first)
    docs = np.add.reduceat(fresh.astype(np.int64), begins) if len(begins) else np.empty(0, np.int64)
    slot = slot[begins]
    rec = np.empty(len(slot), _ANCHOR)
    rec["rest"], rec["docs"] = slot & 0xFFFFFFFF, docs
    out = [(b, _bytes(x)) for b, x in _split(slot >> 32, rec)]
    me = rows.column("part")[0].as_py()
    return _message([b for b, _ in out], [me] * len(out), [x for _, x in out], ("bucket", "part"))


def _shared(rows: pa.Table, hot: int) -> pa.Table:
    """Step 1, of a bucket: the anchors of two documents, for each part that has them; ``docs`` is 1 for hot ones."""
    recs = [np.frombuffer(x.as_py(), _ANCHOR) for x in rows.column("data")]
    every = np.concatenate(recs)
    rest, back = np.unique(every["rest"], return_inverse=True)
    docs = np.bincount(back, weights=every["docs"])
    out, at = [], 0
    me = rows.column("bucket")[0].as_py()
    for part, rec in zip(rows.column("part").to_pylist(), recs, strict=True):
        own = docs[back[at : at + len(rec)]]
        at += len(rec)
        keep = rec[own >= 2].copy()
        keep["docs"] = own[own >= 2] > hot
        if len(keep):
            out.append((part, _bytes(keep), bool(keep["docs"].any())))
    told = _message([p for p, *_ in out], [me] * len(out), [x for _, x, _ in out], ("part", "bucket"))
    return told.append_column("hot", pa.array([h for *_, h in out], pa.bool_()))


def _candidates(part: Part, told: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments with a shared anchor, and which of these have a hot one."""
    bucket, rest = part.slots(parts)
    recs = [(b, np.frombuffer(x, _ANCHOR)) for b, x in zip(told.column("bucket").to_pylist(), told.column("data").to_pylist(), strict=True)]
    if not recs:
        return np.empty(0, np.int64), np.empty(0, bool)
    slot = np.concatenate([(b << 32) | r["rest"].astype(np.int64) for b, r in recs])
    hot = np.concatenate([r["docs"] for _, r in recs]) > 0
    order = np.argsort(slot)
    slot, hot = slot[order], hot[order]
    mine = (bucket << 32) | rest.astype(np.int64)
    at = np.minimum(np.searchsorted(slot, mine), len(slot) - 1)
    hit = np.flatnonzero(slot[at] == mine)
    return hit, hot[at[hit]]


def _segments(rows: pa.Table, told: pa.Table, length: int, parts: int) -> pa.Table:
    """Step 2, of a part: its different candidate segments and their smallest documents."""
    if not rows.num_rows:
        return _message([], [], [], ("bucket", "part"))
    part = Part(rows, length)
    pick, hot = _candidates(part, told, parts)
    first, _ = _first_by_key(part.seg.key[pick], part.doc[pick])
    pick, hot = pick[first], hot[first]
    bucket, rest = part.slots(parts)
    rec = np.empty(len(first), _OWNED)
    rec["a"], rec["b"], rec["doc"], rec["rest"], rec["hot"] = part.seg.key["a"][pick], part.seg.key["b"][pick], part.doc[pick], rest[pick], hot
    # the segments of an anchor meet, but for those of a hot one
    to = np.where(hot, (rec["b"] % np.uint64(parts)).astype(np.int64), bucket[pick])
    out = [(b, _bytes(x)) for b, x in _split(to, rec)]
    me = rows.column("part")[0].as_py()
    return _message([b for b, _ in out], [me] * len(out), [x for _, x in out], ("bucket", "part"))


def _owners(rows: pa.Table) -> pa.Table:
    """Step 2, of a bucket: who has a segment from a smaller document, and which owners are asked for its bytes.

    An anchor with one segment only has nothing to compare; that of a hot anchor
    cannot be told here.
    """
    recs = [np.frombuffer(x.as_py(), _OWNED) for x in rows.column("data")]
    every = np.concatenate(recs)
    key = np.empty(len(every), _KEY)
    key["a"], key["b"] = every["a"], every["b"]
    _, least = _first_by_key(key, every["doc"])
    own = every["doc"] == least
    order = np.lexsort((every["b"], every["a"], every["rest"]))
    rest, k = every["rest"][order], key[order]
    new = np.append(True, rest[1:] != rest[:-1])
    other = np.append(False, (k[1:] != k[:-1]) & ~new[1:])
    ask = np.empty(len(every), bool)
    ask[order] = np.logical_or.reduceat(other, np.flatnonzero(new))[np.cumsum(new) - 1]
    ask |= every["hot"] > 0
    asked = np.empty(len(every), _ASKED)
    asked["a"], asked["b"], asked["hot"] = every["a"], every["b"], every["hot"]
    parts, kinds, data, at = [], [], [], 0
    for part, rec in zip(rows.column("part").to_pylist(), recs, strict=True):
        here = slice(at, at + len(rec))
        for kind, what, pick in ((_ALL, key, ~own[here]), (_OWN, asked, own[here] & ask[here])):
            if pick.any():
                parts.append(part)
                kinds.append(kind)
                data.append(_bytes(what[here][pick]))
        at += len(rec)
    return _message(parts, kinds, data, ("part", "kind"))


def _keys_of(told: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    recs = [np.frombuffer(x, dtype) for k, x in zip(told.column("kind").to_pylist(), told.column("data").to_pylist(), strict=True) if k == kind]
    return np.concatenate(recs) if recs else np.empty(0, dtype)


_BODY = "anchor long, doc long, part int, a long, b long, hot boolean, body binary"


def _bodies(rows: pa.Table, told: pa.Table, length: int) -> pa.Table:
    """Step 3, of a part: the bytes that it is asked for."""
    out: dict[str, list] = {c: [] for c in ("anchor", "doc", "part", "a", "b", "hot", "body")}
    if rows.num_rows:
        part = Part(rows, length)
        seg = part.seg
        asked = _keys_of(told, _OWN, _ASKED)
        known = np.empty(len(asked), _KEY)
        known["a"], known["b"] = asked["a"], asked["b"]
        at = _in(seg.key, known)
        pick = np.flatnonzero(at >= 0)
        first, _ = _first_by_key(seg.key[pick], part.doc[pick])
        pick = pick[first]
        hot = asked["hot"][at[pick]] > 0
        data = part.buf.tobytes()
        ends = (seg.at + seg.n + length - 1)[pick].tolist()
        out = {
            "anchor": seg.anchor[pick].view(np.int64), "doc": part.doc[pick], "part": np.full(len(pick), rows.column("part")[0].as_py(), np.int32),
            "a": seg.key["a"][pick].copy().view(np.int64), "b": seg.key["b"][pick].copy().view(np.int64), "hot": hot, "body": [data[s:e] for s, e in zip(seg.at[pick].tolist(), ends, strict=True)],
        }
    kinds = {"part": pa.int32(), "hot": pa.bool_(), "body": pa.binary()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def _windows(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows as byte strings, the body of each and its number there."""
    n = np.diff(off) - length + 1
    at = ragged(off[:-1], n)
    view = np.lib.stride_tricks.sliding_window_view(buf, length)
    rows = np.ascontiguousarray(view[at]).view(f"S{length}").ravel() if len(at) else np.empty(0, f"S{length}")
    return rows, np.repeat(np.arange(len(n)), n), ragged(np.zeros(len(n), np.int64), n)


def _earlier(buf: np.ndarray, off: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each body the flag word of its windows that also start in a smaller document."""
    suffix, body, number = _windows(buf, off, length)
    order = np.argsort(suffix, kind="stable")  # the suffix order
    s = suffix[order]
    run = np.cumsum(np.append(True, s[1:] != s[:-1])) - 1 if len(s) else np.empty(0, np.int64)
    own = doc[body[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(np.append(True, run[1:] != run[:-1]))) if len(run) else own
    late = own > least[run]
    bits = np.zeros(len(doc), np.uint64)
    np.bitwise_or.at(bits, body[order][late], np.uint64(1) << number[order][late].astype(np.uint64))
    return bits


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Step 3: rows come sorted by anchor; whole anchors are compared together."""
    held: list[pa.RecordBatch] = []
    count = 0

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        buf, off = byte_column(rows.column("body"))
        bits = _earlier(buf, off, rows.column("doc").to_numpy(), length)
        rec = np.empty(len(bits), _FLAG)
        rec["a"], rec["b"], rec["bits"] = rows.column("a").to_numpy().view(np.uint64), rows.column("b").to_numpy().view(np.uint64), bits
        late = bits > 0
        out = [(p, _bytes(x)) for p, x in _split(rows.column("part").to_numpy()[late], rec[late])]
        yield from _message([p for p, _ in out], [_BITS] * len(out), [x for _, x in out], ("part", "kind")).to_batches()

    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= SORTED:
            rows = pa.Table.from_batches(held)
            anchors = rows.column("anchor").to_numpy()
            last = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if (anchors != anchors[-1]).any() else 0
            if last:
                yield from compared(rows.slice(0, last))
            held = rows.slice(last).to_batches()
            count = rows.num_rows - last
    if count:
        yield from compared(pa.Table.from_batches(held))


def _exploded(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows of hot anchors one by one: hash (two longs), document, and where the flag goes."""
    for b in batches:
        buf, off = byte_column(b.column("body"))
        rows, body, number = _windows(buf, off, length)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.ljust(length, b"\0")) for x in rows.tolist()), "<i8").reshape(-1, 2)
        at = pa.array(body)
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), *(b.column(c).take(at) for c in ("doc", "part", "a", "b")), pa.array(number, pa.int32())],
            names=["w1", "w2", "doc", "part", "a", "b", "number"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rec = np.empty(b.num_rows, _FLAG)
        for c in ("a", "b", "bits"):
            rec[c] = b.column(c).to_numpy().view(np.uint64)
        yield from _message(b.column("part").to_pylist(), [_BITS] * b.num_rows, [x.tobytes() for x in rec], ("part", "kind")).to_batches()


_RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _removed(rows: pa.Table, told: pa.Table, length: int) -> pa.Table:
    """Step 4: what each document loses."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = {"doc": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": span}
    out: dict[str, list] = {c: [] for c in names}
    if rows.num_rows:
        part = Part(rows, length)
        seg, buf, off = part.seg, part.buf, part.off
        _, least = _first_by_key(seg.key, part.doc)
        whole = (part.doc > least) | (_in(seg.key, _keys_of(told, _ALL, _KEY)) >= 0)
        step = np.zeros(len(buf) + 1, np.int32)
        np.add.at(step, seg.at[whole], 1)
        np.add.at(step, (seg.at + seg.n + length - 1)[whole], -1)
        flags = _keys_of(told, _BITS, _FLAG)
        if len(flags):
            known = np.empty(len(flags), _KEY)
            known["a"], known["b"] = flags["a"], flags["b"]
            rest = np.flatnonzero(~whole)
            hit = _in(seg.key[rest], known)
            rest, bits = rest[hit >= 0], flags["bits"][hit[hit >= 0]]
            for k in range(WINDOWS):
                at = seg.at[rest[(bits >> np.uint64(k)) & np.uint64(1) > 0]] + k
                np.add.at(step, at, 1)
                np.add.at(step, at + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = gone.astype(np.int8)
        edge = np.flatnonzero(np.append(edge, 0) != np.append(0, edge))
        edge = np.unique(np.concatenate([edge, off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(gone))]]))
        begins = edge[gone[np.minimum(edge, len(gone) - 1)] & (edge < len(gone))] if len(gone) else edge
        ends = edge[np.searchsorted(edge, begins) + 1] if len(begins) else begins
        at = np.searchsorted(begins, off)
        removed = np.append(0, np.cumsum(ends - begins))
        for i in range(len(off) - 1):
            lo, hi, a, b = off[i], off[i + 1], at[i], at[i + 1]
            mine = buf[lo:hi] if a == b else buf[lo:hi][~gone[lo:hi]]
            out["doc"].append(int(part.docs[i]))
            out["n_bytes"].append(int(hi - lo))
            out["n_removed"].append(int(removed[b] - removed[a]))
            out["n_spans"].append(int(b - a))
            out["kept_sha256"].append(hashlib.sha256(mine.tobytes()).hexdigest())
            out["spans"].append([{"start": x, "end": y} for x, y in zip((begins[a:b] - lo).tolist(), (ends[a:b] - lo).tolist(), strict=True)])
    return pa.table({c: pa.array(v, names[c]) for c, v in out.items()})


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges).

    ``length`` is at least 17 (one more than ``GRAM``); ids are whole numbers.
    """
    if length <= GRAM:
        raise ValueError(f"length is over {GRAM}")
    source = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    size = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts, hot = max(1, -(-size // PART_BYTES)), HOT
    docs = source.where("doc is not null").withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")).repartition(parts, "part")
    own = docs.groupBy("part")
    message, answer = "bucket int, part int, data binary", "part int, kind int, data binary"

    anchors = own.applyInArrow(lambda t: _anchors(t, length, parts), message)
    shared = anchors.groupBy("bucket").applyInArrow(lambda t: _shared(t, hot), "part int, bucket int, data binary, hot boolean")
    shared = written(shared, "lpf-shared")
    any_hot = not shared.where("hot").isEmpty()
    told = own.cogroup(shared.groupBy("part")).applyInArrow(lambda t, s: _segments(t, s, length, parts), message)
    owners = told.groupBy("bucket").applyInArrow(_owners, answer)
    asked, late_parts = owners.where(F.col("kind") == _OWN), owners.where(F.col("kind") == _ALL)
    bodies = own.cogroup(asked.groupBy("part")).applyInArrow(lambda t, s: _bodies(t, s, length), _BODY)
    met = bodies.repartition(parts, F.when(F.col("hot"), F.xxhash64("a", "b")).otherwise(F.col("anchor")))
    usual = met.where(~F.col("hot")).sortWithinPartitions("anchor").mapInArrow(lambda it: _compare(it, length), answer)
    reported = late_parts.union(usual)
    if any_hot:  # else the bytes would be asked for a second time, for nothing
        windows = met.where("hot").mapInArrow(lambda it: _exploded(it, length), "w1 long, w2 long, doc long, part int, a long, b long, number int")
        least = windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"))
        late = windows.join(least, ["w1", "w2"]).where("doc > least")
        flags = late.groupBy("part", "a", "b").agg(F.bit_or(F.expr("shiftleft(1L, number)")).alias("bits"))
        reported = reported.union(flags.mapInArrow(_packed, answer))
    result = own.cogroup(reported.groupBy("part")).applyInArrow(lambda t, s: _removed(t, s, length), _RESULT)

    alone = source.where("doc is null").select(
        "doc", F.octet_length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("body", 256).alias("kept_sha256"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
    )
    return result.union(alone).withColumnRenamed("doc", key)
