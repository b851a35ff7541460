"""Token counts by a tokenizer compiled into deterministic finite-state transducers.

A tokenizer file (word-end BPE behind a splitting pattern) becomes two
transducers, run one after the other; no token is ever built.

*Splitter*.  The pattern (contractions, letter runs, single numbers, runs of
anything else) is an automaton of a few states over character classes.  Its
transitions emit where a piece begins, at once or a few characters late where a
contraction turns out to be none.  The characters of a block are cut into
chunks; the map from every state at a chunk's first character to the state
after its last is computed for all chunks at once, the maps are composed by a
parallel prefix scan, and with the states so known at every chunk's start a
second pass reads off the emissions.

*Merger*.  Reads the bytes of a piece, the last one as a symbol of its own
(with the word end).  A sequence of tokens is the BPE result exactly if every
two neighbours are the result of their own bytes, so the last token of every
prefix follows from those of shorter prefixes.  A state holds the starts that a
later token may still have: the place in the vocabulary's trie, the last token
before it, and how many tokens more than the least of them were needed.  What
all of them have in common is emitted by the transition: its annotation is a
count of tokens.  States and transitions are made when first met and kept, in a
bounded number; a bounded number of bytes of finished pieces is remembered.

Defined results: a null text is an empty one and has no tokens; texts are
whole, of any length; strings of special tokens inside a text count as one
token each, as the library does it; repeated rows are each counted; columns of
the input other than the key and the text are not read.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from annolens.llm.common import byte_column, row_blocks

#: Characters of a chunk of the splitter.
CHUNK = 64
#: States that the merger holds before it starts anew.
STATES = 1 << 17
#: Bytes of finished pieces that a worker remembers before it starts anew (with the cost of an entry).
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 120

SPACE, LETTER, NUMBER, OTHER, QUOTE = range(5)
GAP, LETTERS, OTHERS = range(3)
#: Parts of a splitting pattern after its contractions: fixed values of the file format.
RUNS = [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]


class Splitter:
    """The splitting pattern as a transducer over character classes."""

    def __init__(self, literals: list[str]):
        ends = {x[1:] for x in literals}
        nodes = sorted({x[:i] for x in ends for i in range(len(x))})
        if any(x[0] != "'" or len(x) < 2 for x in literals) or ends & set(nodes):
            raise ValueError("contractions have to begin with ' and none may begin another")
        letters = sorted({c for x in ends for c in x})
        self.own = {"'": QUOTE} | {c: QUOTE + 1 + i for i, c in enumerate(letters)}
        self.classes = QUOTE + 1 + len(letters)
        state = {x: OTHERS + 1 + i for i, x in enumerate(nodes)}
        self.late = max(len(x) for x in nodes)

        def fresh(cls: int) -> tuple[int, int]:
            if cls == SPACE:
                return GAP, 0
            if cls == NUMBER:
                return GAP, 1
            if cls == QUOTE:
                return state[""], 1
            return (OTHERS if cls == OTHER else LETTERS), 1

        def step(s: int, cls: int) -> tuple[int, int]:
            letter = cls == LETTER or cls > QUOTE
            if s == LETTERS and letter:
                return LETTERS, 0
            if s == OTHERS and cls in (OTHER, QUOTE):
                return OTHERS, 0
            if s <= OTHERS:
                return fresh(cls)
            seen = nodes[s - OTHERS - 1]
            more = seen + letters[cls - QUOTE - 1] if cls > QUOTE else None
            if more in ends:
                return GAP, 0
            if more in state:
                return state[more], 0
            if not seen:  # a quote alone begins a run of others, if such follow
                return (OTHERS, 0) if cls in (OTHER, QUOTE) else fresh(cls)
            late = 1 << len(seen)  # no contraction: its letters began a piece
            if letter:
                return LETTERS, late
            to, emit = fresh(cls)
            return to, emit | late

        self.states = OTHERS + 1 + len(nodes)
        table = [step(s, c) for s in range(self.states) for c in range(self.classes)]
        self.to = np.array([t for t, _ in table], np.uint8)
        self.emit = np.array([e for _, e in table], np.uint8)

    def starts(self, cls: np.ndarray) -> np.ndarray:
        """First characters of all pieces; the classes have to end with a space."""
        n = len(cls)
        rows = -(-n // CHUNK)
        grid = np.zeros(rows * CHUNK, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.intp)
        maps = np.tile(np.arange(self.states, dtype=np.uint8), (rows, 1))
        for column in grid:
            maps = self.to[maps * np.intp(self.classes) + column[:, None]]
        reach = 1
        while reach < rows:  # after each round a map covers twice as many chunks
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
            reach *= 2
        state = np.concatenate([[GAP], maps[:-1, GAP]]).astype(np.uint8)
        out = np.empty((CHUNK, rows), np.uint8)
        for i, column in enumerate(grid):
            at = state * np.intp(self.classes) + column
            out[i] = self.emit[at]
            state = self.to[at]
        emitted = out.T.ravel()[:n]
        return np.sort(np.concatenate([np.flatnonzero(emitted & (1 << k)) - k for k in range(self.late + 1)]))


class Merger:
    """BPE with word ends as a transducer that emits token counts."""

    END = 256

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        shown = byte_names()
        symbols = [vocab[shown[b]] for b in range(256)] + [vocab[shown[b] + suffix] for b in range(256)]
        spelled: dict[int, tuple[int, ...]] = {t: (s,) for s, t in enumerate(symbols)}
        self.first = dict(enumerate(symbols))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, to = vocab[a], vocab[b], vocab[a + b]
            if to in spelled:
                raise ValueError("a token made by two merges")
            spelled[to] = spelled[left] + spelled[right]
            self.pairs[left, right] = (rank, to)
        self.spelled = spelled
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [True]
        for t, spelling in spelled.items():
            node = 0
            for s in spelling:
                self.inner[node] = True
                to = self.child.get(node << 9 | s)
                if to is None:
                    to = self.child[node << 9 | s] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = t
        self.fit: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.items: list[tuple] = [((0, -1, 0),)]
        self.known = {self.items[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain BPE of a few symbols."""
        ids = [self.first[s] for s in symbols]
        while len(ids) > 1:
            found = [(self.pairs[ids[k], ids[k + 1]][0], k) for k in range(len(ids) - 1) if (ids[k], ids[k + 1]) in self.pairs]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [self.pairs[ids[i], ids[i + 1]][1]]
        return ids

    def fits(self, last: int, token: int) -> bool:
        """Are the two tokens (or the one, at the start of a piece) the BPE of their own bytes?"""
        ok = self.fit.get((last, token))
        if ok is None:
            if len(self.fit) >= STATES * 4:
                self.fit.clear()
            before = self.spelled[last] if last >= 0 else ()
            ok = self.merged(before + self.spelled[token]) == ([last, token] if last >= 0 else [token])
            self.fit[last, token] = ok
        return ok

    def expand(self, state: int, symbol: int) -> tuple[int, int]:
        """Make the transition of a state by a symbol: the state after it and the tokens it emits."""
        items, newest = [], None
        for node, last, more in self.items[state]:
            to = self.child.get(node << 9 | symbol)
            if to is None:
                continue
            if self.inner[to]:
                items.append((to, last, more))
            token = self.token[to]
            if token >= 0 and self.fits(last, token):
                newest = (0, token, more + 1)
        if symbol >= self.END:
            self.step[state << 9 | symbol] = out = (0, newest[2])
            return out
        items.append(newest)
        common = min(x[2] for x in items)
        key = tuple((node, last, more - common) for node, last, more in items)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.items)
            self.items.append(key)
        self.step[state << 9 | symbol] = out = (to, common)
        return out

    def count(self, piece: bytes) -> int:
        if len(self.items) >= STATES:
            self._clear()
        state, n, get = 0, 0, self.step.get
        for b in piece[:-1]:
            state, emitted = get(state << 9 | b) or self.expand(state, b)
            n += emitted
        last = piece[-1] | self.END
        return n + (get(state << 9 | last) or self.expand(state, last))[1]


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in plain}
    names |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in names)}
    return [names[b] for b in range(256)]


class Counter:
    """A compiled tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        parts = split["pattern"]["Regex"].split("|")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or parts[-3:] != RUNS or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("no tokenizer of the known form: normalizer or splitting pattern")
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("no tokenizer of the known form: model")
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError("no tokenizer of the known form: added tokens")
        self.splitter = Splitter(parts[:-3])
        self.merger = Merger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.library = Tokenizer.from_file(path)
        self.cls = np.full(0x110000, 255, np.uint8)
        self.cache: dict[str, int] = {}
        self.held = 0

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        """Character classes; a character met for the first time is classed by the library's own tables."""
        cls = self.cls[codes]
        if (cls == 255).any():
            for c in np.unique(codes[cls == 255]).tolist():
                ch = chr(c)
                pieces = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{ch} {ch}{ch}"))
                self.cls[c] = self.splitter.own.get(ch, (SPACE, LETTER, OTHER, NUMBER)[pieces - 1])
            cls = self.cls[codes]
        return cls

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if any(unicodedata.category(c) == "Cn" for c in set(text)):  # newer than Python's tables
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # the library lowers each character alone

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        n = np.zeros(len(texts), np.int64)
        shown = []
        for i, t in enumerate(texts):
            if self.special and "<" in t:
                t, k = self.special.subn(" ", t)
                n[i] = k
            shown.append(self._normal(t))
        offsets = np.cumsum([0, *(len(t) + 1 for t in shown)])
        whole = " ".join([*shown, ""])
        if not len(whole):
            return n
        cls = self._classify(np.frombuffer(whole.encode("utf-32-le"), np.uint32))
        starts = self.splitter.starts(cls)
        if not len(starts):
            return n
        edges = np.flatnonzero(cls == SPACE)
        ends = np.minimum(edges[np.searchsorted(edges, starts)], np.append(starts[1:], len(whole)))
        pieces = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        each = np.array([self._piece(p) for p in coded.dictionary.to_pylist()], np.int64)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        return n + np.bincount(doc, each[coded.indices.to_numpy()], len(texts)).astype(np.int64)

    def _piece(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.merger.count(piece.encode())
            self.held += len(piece) + ENTRY_BYTES
            if self.held > CACHE_BYTES:
                self.cache, self.held = {}, len(piece) + ENTRY_BYTES
            if self.held <= CACHE_BYTES:
                self.cache[piece] = n
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text: key, n_bytes, n_tokens."""
    source = df.select(key, text)
    schema = T.StructType([source.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = counter(path)
        for b in batches:
            texts = b.column(1)
            _, off = byte_column(texts)
            for lo, hi in row_blocks(off):
                n = compiled.counts([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(off[lo : hi + 1])), pa.array(n)], names=schema.names)

    return source.mapInArrow(run, schema)
