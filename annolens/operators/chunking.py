"""Token budgets (O40, O41) and token chunking.

Tokens are lossless word tokens (``functions.text.WORD_TOKEN``): joining
the tokens of a chunk gives its text back.  Budgets are parameters; the
reference's model-dependent defaults are in ``MODEL_BUDGETS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import CHUNK_INSTRUCTION, PAYLOAD_SEP
from ..functions.tokenizers import DEFAULT as DEFAULT_TOKENIZER
from .scan import DEFAULT_BLOCK_ROWS, exclusive_prefix_sum

# Context budget per model (tokens); any other model gets the
# default.  The chunk budget is the same for every model.
MODEL_BUDGETS = {"gpt-4-1106-preview": 128000}
DEFAULT_MAX_TOKENS = 16000
CHUNK_TOKENS = 16000


# Model tokens that a word of English prose makes on average, for budgets of word tokens.
TOKENS_PER_WORD = 1.3


def budget_for_model(model: str, tokens_per_word: float = 1.0) -> tuple[int, int]:
    """(max_tokens, chunk_tokens) for a model name.

    The fixed budgets are tokens of the model.  ``tokens_per_word`` turns them
    into tokens of the tokenizer that counts: 1 for the model's own, some
    ``TOKENS_PER_WORD`` for word tokens."""
    if tokens_per_word <= 0:
        raise ValueError("tokens_per_word has to be positive")
    return int(MODEL_BUDGETS.get(model, DEFAULT_MAX_TOKENS) / tokens_per_word), int(CHUNK_TOKENS / tokens_per_word)


def without_lead(text: Column) -> Column:
    """The text without leading white space."""
    return F.regexp_replace(text, r"^\s+", "")


def prefix_tokens(prefix: str = CHUNK_INSTRUCTION + PAYLOAD_SEP, tokenizer=None) -> int:
    """Token count of a prompt prefix, with the same tokenizer as the texts."""
    return (tokenizer or DEFAULT_TOKENIZER).count_text(prefix)


def token_count_fast(text: Column, tokenizer=None) -> Column:
    """Token count without keeping the pieces (word tokens: a regex count)."""
    return (tokenizer or DEFAULT_TOKENIZER).count(text)


def _chunk_pieces(tokens: Column, n: Column, size: int) -> Column:
    """``ceil(n/size)`` consecutive pieces of ``size`` tokens, last one short."""
    nchunks = F.ceil(n / F.lit(size)).cast("int")
    return F.transform(F.sequence(F.lit(0), nchunks - 1),
                       lambda i: F.array_join(F.slice(tokens, i * size + 1, F.lit(size)), ""))


def chunk_texts(text: Column, chunk_tokens: int, prefix: int = 0, tokenizer=None) -> Column:
    """The chunks of one text, in order, as an array."""
    size = chunk_tokens - prefix
    if size <= 0:
        raise ValueError("chunk budget must exceed the prompt prefix")
    tokens = (tokenizer or DEFAULT_TOKENIZER).pieces(text)
    # Bound to a name: inside the pieces' own function the text would be cut into tokens anew for every chunk.
    return F.get(F.transform(F.array(tokens), lambda t: _chunk_pieces(t, F.size(t), size)), 0)


def chunk_rows(df: DataFrame, text_col: str, max_tokens: int, chunk_tokens: int,
               prefix: int = 0, tokenizer=None) -> DataFrame:
    """Per-row budget test and chunking.

    A row whose text has at most ``max_tokens`` tokens passes whole
    (``kind='pass'``, one chunk); otherwise it is cut into chunks of
    ``chunk_tokens - prefix`` tokens (``kind='chunk'``).  Adds
    n_tokens, kind, chunk_idx, n_chunks, chunk_text; one row per chunk.
    """
    size = chunk_tokens - prefix
    if size <= 0:
        raise ValueError("chunk budget must exceed the prompt prefix")
    tk = tokenizer or DEFAULT_TOKENIZER
    d = df.withColumn("_tok", tk.pieces(F.col(text_col))).withColumn("n_tokens", F.size("_tok").cast("bigint"))
    passes = F.col("n_tokens") <= F.lit(max_tokens)
    pieces = F.when(passes, F.array(F.col(text_col))).otherwise(_chunk_pieces(F.col("_tok"), F.col("n_tokens"), size))
    d = d.withColumn("kind", F.when(passes, F.lit("pass")).otherwise(F.lit("chunk"))) \
         .withColumn("_pieces", pieces).drop("_tok")
    d = d.withColumn("n_chunks", F.size("_pieces").cast("bigint"))
    return d.select("*", F.posexplode("_pieces").alias("chunk_idx", "chunk_text")).drop("_pieces") \
            .withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


def _attached_behind(tokenizer, sep: str) -> bool:
    """Does the separator go with the text behind it?"""
    if tokenizer.attach != "behind":
        return False
    if not sep[:1].isspace():
        raise ValueError("texts are joined by a separator that begins with white space")
    return True


def chunk_by_key(df: DataFrame, keys: list[str], order_col: str, text_col: str,
                 max_tokens: int, chunk_tokens: int, prefix: int = 0, sep: str = " ",
                 block_rows: int = DEFAULT_BLOCK_ROWS, tokenizer=None, with_counts: bool = False) -> DataFrame:
    """Join the texts of each key with ``sep`` (in ``order_col`` order) and cut
    the result to the token budget, without ever building the joined text
    of a key that is over budget.

    Every text gets ``sep`` appended.  Pass 1 counts its tokens (a regex
    count, no arrays) for the block prefix sum, which gives each text its
    token offset inside the key and the key's total (no task holds a whole
    key).  Pass 2 tokenises and sends each text to the chunks it overlaps:
    a key within ``max_tokens`` has one chunk (the whole text, bounded by the
    budget); otherwise chunks of ``chunk_tokens - prefix`` tokens, each
    regrouped from its slices (bounded by the chunk size).  The extra ``sep``
    is removed from the key's last chunk.

    Output: keys, chunk_idx, n_chunks, kind, n_tokens, chunk_text (and
    ``with_counts``: n_texts, the number of input texts of the key).
    Leading white space of a text is dropped (in the joined form it would merge
    into the previous text's last token).  Texts must have other characters.

    A tokenizer whose tokens begin with white space (``attach = "behind"``)
    gets the separator before every text but the key's first; the counts are
    those of the joined text, of which only the seams are counted anew.
    """
    size = chunk_tokens - prefix
    if size <= 0:
        raise ValueError("chunk budget must exceed the prompt prefix")
    tk = tokenizer or DEFAULT_TOKENIZER
    behind = _attached_behind(tk, sep)
    body = without_lead(F.col(text_col))
    d = df.select(*keys, order_col, (F.concat(F.lit(sep), body) if behind else F.concat(body, F.lit(sep))).alias("_piece"),
                  *([tk.seam(sep, body).alias("_less")] if behind else []))
    d = d.withColumn("_n", tk.count(F.col("_piece")))
    over_budget = F.col("n_tokens") > F.lit(max_tokens)

    def second_pass(j: DataFrame) -> DataFrame:
        # Keys within budget need no offsets: only over-budget rows are
        # counted again (before the in-block shuffle, so it carries counts,
        # not token arrays).
        if behind:  # no separator before the key's first text
            j = j.withColumn("_piece", F.when(F.col("_first"), F.substr("_piece", F.lit(len(sep) + 1))).otherwise(F.col("_piece"))).drop("_first")
        return j.withColumn("_n", F.when(over_budget, tk.count(F.col("_piece"))).otherwise(F.lit(0)))

    d = exclusive_prefix_sum(d, keys, order_col, "_n", "_st", block_rows, total_col="n_tokens",
                             after_join=second_pass, count_col="n_texts", first_less="_less" if behind else None)
    L = F.lit(size).cast("bigint")
    fits = F.col("n_tokens") <= F.lit(max_tokens)
    first_c = F.when(fits, F.lit(0)).otherwise(F.floor(F.col("_st") / L)).cast("bigint")
    last_c = F.when(fits, F.lit(0)).otherwise(F.floor((F.col("_st") + F.col("_n") - 1) / L)).cast("bigint")
    # Only a text that a cut goes through is split into its tokens.
    whole = first_c == last_c
    d = d.filter(~over_budget | (F.col("_n") > 0)).withColumn("_tok", tk.pieces(F.when(~whole, F.col("_piece"))))

    def part(c):
        a = F.greatest(c * L - F.col("_st"), F.lit(0).cast("bigint"))
        b = F.least((c + 1) * L - F.col("_st"), F.col("_n"))
        sl = F.array_join(F.slice(F.col("_tok"), (a + 1).cast("int"), (b - a).cast("int")), "")
        return F.struct(c.alias("c"), F.when(whole, F.col("_piece")).otherwise(sl).alias("t"))

    parts = d.select(*keys, order_col, "n_tokens", "n_texts",
                     F.explode(F.transform(F.sequence(first_c, last_c), part)).alias("_p"))
    chunks = (parts.groupBy(*keys, F.col("_p.c").alias("chunk_idx")).agg(
                  F.first("n_tokens").alias("n_tokens"), F.first("n_texts").alias("n_texts"),
                  F.expr(f"listagg(_p.t, '') WITHIN GROUP (ORDER BY `{order_col}`)").alias("_t")))
    fits2 = F.col("n_tokens") <= F.lit(max_tokens)
    n_chunks = F.when(fits2, F.lit(1)).otherwise(F.ceil(F.col("n_tokens") / L)).cast("bigint")
    chunks = chunks.withColumn("n_chunks", n_chunks)
    is_last = F.col("chunk_idx") == F.col("n_chunks") - 1
    lsep = 0 if behind else len(sep)
    text = F.when(is_last & F.lit(lsep > 0), F.col("_t").substr(F.lit(1), F.length("_t") - F.lit(lsep))) \
        .otherwise(F.col("_t"))
    extra = [F.col("n_texts").cast("bigint").alias("n_texts")] if with_counts else []
    return chunks.select(*keys, F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "n_chunks",
                         F.when(fits2, F.lit("pass")).otherwise(F.lit("chunk")).alias("kind"), "n_tokens",
                         text.alias("chunk_text"), *extra)


def budget_plan(df: DataFrame, keys: list[str], text_col: str, max_tokens: int, chunk_tokens: int,
                prefix: int = 0, sep: str = " ", tokenizer=None, with_counts: bool = False,
                order_col: str | None = None) -> DataFrame:
    """Per key: total tokens of the joined text, pass/chunk decision and the
    number of chunks.  A plain partial + final aggregate.  ``order_col`` is
    needed where separators go with the text behind them."""
    size = chunk_tokens - prefix
    tk = tokenizer or DEFAULT_TOKENIZER
    body = without_lead(F.col(text_col))
    if _attached_behind(tk, sep):
        lead = F.min(F.struct(F.col(order_col).alias("at"), tk.seam(sep, body).alias("less")))["less"]
        total = F.sum(tk.count(F.concat(F.lit(sep), body))) - lead
    else:
        total = F.sum(tk.count(F.concat(body, F.lit(sep))))
    g = df.groupBy(*keys).agg(total.alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"))
    passes = F.col("n_tokens") <= F.lit(max_tokens)
    extra = ["n_texts"] if with_counts else []
    return g.select(*keys, "n_tokens", F.when(passes, F.lit("pass")).otherwise(F.lit("chunk")).alias("kind"),
                    F.when(passes, F.lit(1)).otherwise(F.ceil(F.col("n_tokens") / F.lit(size))).cast("bigint").alias("n_chunks"),
                    *extra)
