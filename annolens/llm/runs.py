"""Periodic runs of words by uniting suffix classes in the order of their common prefixes.

Suffixes of a document's words are sorted by doubling (ranks of 1, 2, 4, ...
words; a suffix leaves when its rank is its own), all documents of a block at
once; a rank never holds suffixes of two documents.  The longest common prefix
(LCP) of neighbours in suffix order follows from the same ranks, from the
largest power down.

Then, as Kruskal does with edges, neighbours are united by decreasing LCP.  A
class is the ordered set of the positions of its suffixes; the smaller of two
is put into the larger.  Two positions newly side by side at a distance d within
the LCP seed a run of period d: the words of both repeat each other from the
first position on for d + LCP words, and not beyond, since their LCP is just
that of the merge.  A run that the word before it would extend has its seed
further left.  d is the smallest period of the stretch: with a smaller one that
divides it, a position between the two would have a greater LCP with the first
and would have been united with it before, so the two would never be side by
side.  A run of at least twice its period has that one seed.

Only LCPs that can belong to a run of the asked length and number of periods
are united; all of that is per document, so nothing is shuffled.

Defined results: a null text has no words; a word is a maximal run of bytes
other than space and 0x09-0x0D; texts are whole, of any length; repeated rows
are each read; a clashing output name replaces the column of the input.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from annolens.llm.common import byte_column, row_blocks

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUN_ARROW = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def suffix_order(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share ``least`` or more symbols: left, right, LCP.

    Every stretch of ``key`` has to end with a symbol that stands nowhere else.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n, np.int64)
    rank = _group_starts(key[order])
    ranks[order] = rank
    active = order[_shared(rank)]
    h, levels = 1, []
    kept = None
    while len(active):
        levels.append((h, active, ranks[active]))
        if 2 * h > least and kept is None:
            kept = (active, ranks[active])  # all that share h <= least symbols with another
        # Ranks are the places of groups in suffix order, so a sort by both halves keeps the order of groups.
        pair = ranks[active] * np.int64(n + 1) + ranks[active + h]
        by = np.argsort(pair, kind="stable")
        active, pair = active[by], pair[by]
        own = ranks[active]
        place = own + (np.arange(len(own)) - _group_starts(own))
        first = _group_starts(pair)
        rank = place[first]
        ranks[active] = rank
        active = active[_shared(rank)]
        h *= 2
    if kept is None:
        none = np.empty(0, np.int64)
        return none, none, none
    who, group = kept
    by = np.argsort(ranks[who])
    who, group = who[by], group[by]
    same = group[1:] == group[:-1]
    left, right = who[:-1][same], who[1:][same]
    lcp = np.zeros(len(left), np.int64)
    scratch = -1 - np.arange(n)
    for h, at, rank in reversed(levels):
        scratch[at] = rank
        lcp += h * (scratch[left + lcp] == scratch[right + lcp])
        scratch[at] = -1 - at
    enough = lcp >= least
    return left[enough], right[enough], lcp[enough]


def _group_starts(x: np.ndarray) -> np.ndarray:
    """For every element of a sorted array the index of the first one equal to it."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _shared(x: np.ndarray) -> np.ndarray:
    """Which elements of a sorted array have an equal neighbour."""
    same = x[1:] == x[:-1]
    out = np.zeros(len(x), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def seeds(left: np.ndarray, right: np.ndarray, lcp: np.ndarray, times: int) -> tuple[list[int], list[int], list[int]]:
    """Unite neighbours by decreasing LCP: position, distance and LCP of all newly adjacent positions
    whose distance fits into the LCP ``times - 1`` times.
    """
    by = np.argsort(-lcp, kind="stable")
    klass: dict[int, list[int]] = {}
    at, apart, common = [], [], []
    fit = times - 1
    for u, v, l in zip(left[by].tolist(), right[by].tolist(), lcp[by].tolist(), strict=True):
        small, large = klass.get(u), klass.get(v)
        if small is None:
            small = [u]
            if large is None:
                large = klass[v] = [v]
        elif large is None:
            small, large = [v], small
        elif len(small) > len(large):
            small, large = large, small
        last, n = len(small) - 1, len(large)
        places = []
        for k, x in enumerate(small):
            i = bisect_left(large, x)
            places.append(i)
            if i and (not k or small[k - 1] < large[i - 1]):  # else the one before it is of its own class
                d = x - large[i - 1]
                if fit * d <= l:
                    at.append(x - d)
                    apart.append(d)
                    common.append(l)
            if i < n and (k == last or small[k + 1] > large[i]):
                d = large[i] - x
                if fit * d <= l:
                    at.append(x)
                    apart.append(d)
                    common.append(l)
            klass[x] = large
        if last * 16 < n:
            for i, x in zip(reversed(places), reversed(small), strict=True):
                large.insert(i, x)
        else:
            large.extend(small)
            large.sort()  # two ordered stretches: one merge
    return at, apart, common


def block_runs(codes: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all documents of a block: document, start, length, period, by document, start and period.

    ``codes`` are the words' codes end to end, document d at [offsets[d], offsets[d + 1]).
    """
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    width = int(codes.max(initial=0)) + 2
    key = np.empty(len(codes) + len(offsets) - 1, np.int64)
    key[np.arange(len(codes)) + docs] = docs * width + codes + 1
    key[offsets[1:] + np.arange(len(offsets) - 1)] = np.arange(len(offsets) - 1) * width  # ends a document
    # A run of length L and period q is seeded at LCP L - q; L >= times * q.
    shortest = max(-(-least * (times - 1) // times), 1)
    at, apart, common = (np.array(x, np.int64) for x in seeds(*suffix_order(key, shortest), times))
    first = np.ones(len(at), bool)
    inner = at > 0
    first[inner] = key[at[inner] - 1] != key[at[inner] - 1 + apart[inner]]
    keep = first & (apart + common >= least)
    at, apart, common = at[keep], apart[keep], common[keep]
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    doc = np.searchsorted(begins, at, side="right") - 1
    start = at - begins[doc]
    by = np.lexsort((apart, start, doc))
    return doc[by], start[by], (apart + common)[by], apart[by]


def periodic_runs(df: DataFrame, least: int = 6, times: int = 4, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add every text's runs and the text without their repetitions.

    ``runs``: array of (start, length, period) in words, by start, then period:
    all stretches of ``least`` or more words and ``times`` or more times their
    smallest period that no neighbouring word extends.  ``collapsed``: the words
    joined by one space, without those that a run contains after its first
    period.
    """
    source = df.select(*(c for c in df.columns if c not in (runs, collapsed)))
    schema = T.StructType([*source.schema, T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())])
    place = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = byte_column(b.column(place))
            for lo, hi in row_blocks(off):
                words = [buf[off[i] : off[i + 1]].tobytes().split() for i in range(lo, hi)]
                offsets = np.cumsum([0, *map(len, words)])
                flat = pa.array([w for own in words for w in own], pa.large_binary()).dictionary_encode()
                doc, start, length, period = block_runs(flat.indices.to_numpy().astype(np.int64), offsets, least, times)
                n_runs = np.bincount(doc, minlength=hi - lo)
                # Words to drop: those covered by [start + period, start + length) of a run.
                cover = np.zeros(offsets[-1] + 1, np.int64)
                np.add.at(cover, offsets[doc] + start + period, 1)
                np.add.at(cover, offsets[doc] + start + length, -1)
                dropped = np.cumsum(cover)[:-1] > 0
                for i in np.flatnonzero(n_runs).tolist():
                    words[i] = [w for w, gone in zip(words[i], dropped[offsets[i] : offsets[i + 1]].tolist(), strict=True) if not gone]
                items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN_ARROW))
                found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_runs)]).astype(np.int32)), items)
                kept = pa.array([b" ".join(own) for own in words], pa.binary()).cast(pa.string())
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, found, kept], names=schema.names)

    return source.mapInArrow(run, schema)
