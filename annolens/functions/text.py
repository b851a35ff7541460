"""Text column functions.

Every function takes and returns a ``Column`` built from stock Spark SQL
expressions, so they stay inside whole-stage code generation (or the
interpreted higher-order-function path) and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
FENCE = "```"                      # markdown code fence removed from model output
TERMINAL_PUNCT = (".", "?", "!")   # a text already ending in one of these gets no period
ARTICLE_TAGS = ("title", "p", "sec")  # article elements whose leading text is kept
ARTICLE_SEP = "\n\n"               # separator between article segments
TEXT_SEP = " "                     # separator between texts of a gene / chunk answers

# Lossless word tokens: a run of non-space characters with the whitespace
# that follows it, or the leading whitespace of the text.  Concatenating the
# tokens gives back the input exactly.
WORD_TOKEN = r"\S+\s*|^\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: Spark ``trim`` only removes spaces."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def parse_pmid_list(c) -> Column:
    """``'12,34'`` -> ``[12, 34]``; ``'12'`` -> ``[12]``; ``''`` -> ``[]``."""
    parts = F.transform(F.split(_c(c), ","), lambda x: strip(x).try_cast("bigint"))
    return F.filter(parts, lambda x: x.isNotNull())


def strip_fences(c) -> Column:
    """Drop every line that starts or ends with a code fence."""
    lines = F.split(_c(c), "\n")
    kept = F.filter(lines, lambda l: ~l.startswith(FENCE) & ~l.endswith(FENCE))
    return F.array_join(kept, "\n")


def ensure_terminal_punct(c) -> Column:
    """Append a period unless the text already ends in . ? or !"""
    t = _c(c)
    return F.when(t.isNull(), F.lit(None)).when(
        F.right(t, F.lit(1)).isin(*TERMINAL_PUNCT), t).otherwise(F.concat(t, F.lit(".")))


def first_sentence(c) -> Column:
    """First non-empty piece of a split on '.', stripped; NULL when none."""
    pieces = F.filter(F.split(_c(c), "[.]"), lambda x: x != "")
    return strip(F.get(pieces, 0))


def is_numeric_token(c) -> Column:
    return _c(c).rlike(r"^[0-9]+$")


def word_tokens(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(WORD_TOKEN), 0)


def token_count(c) -> Column:
    return F.size(word_tokens(c)).cast("bigint")


def decode_basic_entities(c) -> Column:
    """The five predefined XML entities; ``&amp;`` last so it is not decoded twice."""
    out = _c(c)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


ARTICLE_SEGMENT_RE = r"<(?:title|p|sec)(?:\s+|\s[^>]*[^/>])?>([^<]+)"


def article_segments(c) -> Column:
    """Lenient article extraction: for each ``title``/``p``/``sec`` start tag,
    the text up to the next tag, stripped and entity-decoded, in document order.

    Comments are removed and CDATA sections unwrapped first.  This never
    fails on malformed input.
    """
    body = F.regexp_replace(_c(c), r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    raw = F.regexp_extract_all(body, F.lit(ARTICLE_SEGMENT_RE), 1)
    return F.transform(raw, lambda s: decode_basic_entities(strip(s)))


def sentences(c) -> Column:
    """Sentence pieces ending in . ! or ? (the trailing fragment is dropped)."""
    return F.regexp_extract_all(_c(c), F.lit(r"[^.!?]*[.!?]+"), 0)
