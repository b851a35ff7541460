"""Tokenizers for budgets and chunking.

A tokenizer turns a text column into ``array<string>`` pieces whose
concatenation is the text, one piece per token, and counts them.

* ``WordTokenizer`` (default): lossless word tokens, pure JVM expressions.
* ``SubwordTokenizer``: greedy longest match over a vocabulary table, JVM
  expressions as well.
* ``OffsetTokenizer``: any tokenizer that reports character offsets.  The text is cut at each token's start
  offset inside an Arrow-batched pandas UDF; the encoder is loaded once per
  Python worker.  A byte-level token that starts inside a character gets an
  empty piece, so counts stay exact and pieces still join to the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WORD_TOKEN, word_tokens


class WordTokenizer:
    name = "word"
    attach = "before"  # a separator goes with the text before it

    def pieces(self, c: Column) -> Column:
        return word_tokens(c)

    def count(self, c: Column) -> Column:
        """Non-space runs plus one for leading whitespace (same count as the pieces)."""
        return (F.regexp_count(c, F.lit(r"\S+")) +
                F.when(c.rlike(r"^\s"), F.lit(1)).otherwise(F.lit(0))).cast("bigint")

    def count_text(self, text: str) -> int:
        return len(re.findall(WORD_TOKEN, text))


def cut_at_offsets(text: str, starts: list[int]) -> list[str]:
    """One piece per token start; cut points made monotone and clamped."""
    n = len(text)
    cuts, prev = [], 0
    for i, s in enumerate(starts):
        c = 0 if i == 0 else min(max(int(s), prev), n)
        cuts.append(c)
        prev = c
    cuts.append(n)
    return [text[cuts[i]:cuts[i + 1]] for i in range(len(starts))]


class OffsetTokenizer:
    """``load()`` returns ``encode(text) -> list of (start, end)`` character
    offsets; it runs once per Python worker."""

    attach = "before"

    def __init__(self, name: str, load: Callable[[], Callable[[str], list[tuple[int, int]]]]):
        self.name = name
        self._load = load
        self._enc = None
        cache: dict = {}

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def pieces_udf(texts: pd.Series) -> pd.Series:
            if "enc" not in cache:
                cache["enc"] = load()
            enc = cache["enc"]
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                offs = enc(t)
                out.append(cut_at_offsets(t, [o[0] for o in offs]) if offs else ([] if t == "" else [t]))
            return pd.Series(out)

        self._udf = pieces_udf

    def pieces(self, c: Column) -> Column:
        return self._udf(c)

    def count(self, c: Column) -> Column:
        return F.size(self._udf(c)).cast("bigint")

    def count_text(self, text: str) -> int:
        if self._enc is None:
            self._enc = self._load()
        return len(self._enc(text))


#: Most tokens of a vocabulary that ``SubwordTokenizer.from_table`` takes to the driver.
VOCABULARY_TOKENS = 1 << 16


class SubwordTokenizer:
    """Greedy longest match over a vocabulary, by expressions only.

    From the start of a text the longest token that fits is taken, again and
    again; a character that begins no token is one by itself.  The vocabulary
    becomes one regular expression, a trie in which every token is tried at its
    full length before its beginnings.

    A token may begin with white space and has none elsewhere.  So every white
    space character begins a token, and a separator that begins with one keeps
    the tokens of the texts before and after it apart: only where a text meets
    its separator (``attach``: the separator goes with the text behind it) can
    the count differ from that of the text alone.
    """

    attach = "behind"

    def __init__(self, tokens: Iterable[str], name: str = "subword"):
        self.name = name
        trie: dict = {}
        for token in tokens:
            if not token or re.search(r"\s", token[1:]):
                raise ValueError(f"a token is not empty and has white space at its start only: {token!r}")
            node = trie
            for c in token:
                node = node.setdefault(c, {})
            node[""] = {}
        self.pattern = f"{self._branch(trie)}|(?s:.)" if trie else "(?s:.)"

    @classmethod
    def from_table(cls, vocabulary: DataFrame, token_col: str = "token", name: str = "subword") -> "SubwordTokenizer":
        """The tokens of a table of at most ``VOCABULARY_TOKENS`` rows; more are an error."""
        rows = vocabulary.select(token_col).where(F.length(token_col) > 0).distinct().limit(VOCABULARY_TOKENS + 1).collect()
        if len(rows) > VOCABULARY_TOKENS:
            raise ValueError(f"the vocabulary has more than {VOCABULARY_TOKENS} tokens")
        return cls(sorted(r[0] for r in rows), name)

    @classmethod
    def _size(cls, node: dict) -> int:
        """Tokens below a node."""
        return sum(cls._size(n) if c else 1 for c, n in node.items())

    @classmethod
    def _branch(cls, node: dict) -> str:
        """A pattern of the longest way down from a node; ways begin with different characters, those to most tokens are tried first."""
        ways = [c for c in sorted(node) if c]
        leaves = [c for c in ways if set(node[c]) == {""}]
        parts = [(cls._size(node[c]), re.escape(c) + cls._branch(node[c])) for c in ways if c not in leaves]
        if len(leaves) == 1:
            parts.append((1, re.escape(leaves[0])))
        elif leaves:
            parts.append((len(leaves), "[" + "".join(re.escape(c) for c in leaves) + "]"))
        if not parts:
            return ""
        parts.sort(key=lambda p: -p[0])
        return f"(?:{'|'.join(p for _, p in parts)}){'?' if '' in node else ''}"

    def pieces(self, c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(self.pattern), F.lit(0))

    def count(self, c: Column) -> Column:
        # Every character is in a token: the tokens are not kept, each leaves one character.
        return F.length(F.regexp_replace(c, F.lit(self.pattern), F.lit("x"))).cast("bigint")

    def count_text(self, text: str) -> int:
        return len(re.findall(self.pattern, text))

    def seam(self, sep: str, text: Column) -> Column:
        """Tokens of the separator and the text, less those of the text: counted where they meet."""
        head = F.regexp_extract(text, r"^\S*", 0)
        return self.count(F.concat(F.lit(sep), head)) - self.count(head)


DEFAULT = WordTokenizer()
