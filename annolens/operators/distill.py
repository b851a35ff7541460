"""Distill (O44): fit the joined texts of each key into the model budget.

Keys (or rows) within the budget pass unchanged.  The joined text of any
other is cut into chunks, every chunk is summarised by the backend, and the
answers, in chunk order, are the distilled text.  One such round is the
default, as in the reference; with ``max_rounds`` over one, an answer that is
still over budget goes through further rounds as long as it shrinks.

Status of a key: ``ok``; ``error`` when the call for one of its chunks failed
(its distilled text is NULL: nothing is answered from a part of the texts);
``over_budget`` when further rounds were asked for but the text is still over
budget and did not shrink, or the rounds ran out.

A native backend is an expression: it makes no extra pass, join or
checkpoint.  For a Python backend only what is over budget is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import chunk_prompt
from ..session import ensure_checkpoint_dir
from .chunking import chunk_by_key, chunk_rows, chunk_texts, prefix_tokens, token_count_fast
from .infer import Backend, infer


def _ordered(text: Column, order: str, sep: str) -> Column:
    """Texts of a group in order, joined."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pieces, lambda x: x["t"]), sep)


def _answers(answered: DataFrame, keys: list[str], sep: str, *more: Column) -> DataFrame:
    """Answers of the chunks of each key, joined; one failed chunk makes the key an error."""
    ok = F.col("_resp").isNotNull() & (F.col("_resp_status") == "ok")
    g = answered.groupBy(*keys).agg(
        F.bool_and(ok).alias("_ok"), _ordered(F.col("_resp"), "chunk_idx", sep).alias("_all"),
        F.min("_resp_error").alias("error"), *more)
    return (g.withColumn("distilled", F.when(F.col("_ok"), F.col("_all")))
             .withColumn("status", F.when(F.col("_ok"), F.lit("ok")).otherwise(F.lit("error"))).drop("_ok", "_all"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_k_{k}"])
    return on


def distill(df: DataFrame, keys: list[str], order_col: str, text_col: str, backend: Backend,
            max_tokens: int, chunk_tokens: int, sep: str = " ", max_rounds: int = 1,
            responses_path: str | None = None, tokenizer=None, parallelism: int | None = None) -> DataFrame:
    """(keys, order, text) -> (keys, n_tokens, n_texts, kind, rounds, distilled, status, error).

    ``backend`` answers the chunk prompts; jobs may pass a cheaper model
    here than the one used for their final prompt (the reference does).
    ``n_tokens``/``kind`` describe the first round (input size, pass/chunk);
    ``rounds`` is the number of summarising rounds the key went through.  A NULL
    key is a key.
    """
    prefix = prefix_tokens(tokenizer=tokenizer)
    cur = df.select(*keys, F.col(order_col).cast("bigint").alias("_ord"), F.col(text_col).alias("_text"))
    c = chunk_by_key(cur, keys, "_ord", "_text", max_tokens, chunk_tokens, prefix, sep, tokenizer=tokenizer, with_counts=True)
    # Texts of keys within budget are not sent: they are their own answer.
    over = F.col("kind") == "chunk"
    asked = infer(c.withColumn("_prompt", F.when(over, chunk_prompt(F.col("chunk_text")))), "_prompt", backend, "_resp", responses_path, parallelism)
    asked = asked.withColumn("_resp", F.when(over, F.col("_resp")).otherwise(F.col("chunk_text"))) \
        .withColumn("_resp_status", F.when(over, F.col("_resp_status")).otherwise(F.lit("ok")))
    out = _answers(asked, keys, sep, F.max("n_tokens").alias("n_tokens"), F.max("n_texts").alias("n_texts"), F.max("kind").alias("kind"))
    out = out.withColumn("rounds", F.when(over, F.lit(1)).otherwise(F.lit(0)))
    out = _more_rounds(out, keys, backend, max_tokens, chunk_tokens, sep, max_rounds, responses_path, tokenizer, parallelism)
    return out.select(*keys, "n_tokens", "n_texts", "kind", F.col("rounds").cast("int").alias("rounds"), "distilled", "status", "error")


def _more_rounds(out: DataFrame, keys: list[str], backend: Backend, max_tokens: int, chunk_tokens: int, sep: str,
                 max_rounds: int, responses_path: str | None, tokenizer, parallelism: int | None) -> DataFrame:
    """Rounds after the first, for keys whose answers are still over budget; a fixed number at most."""
    if max_rounds <= 1:
        return out
    # Model answers: computed once, and the lineage of the loop stays short.
    ensure_checkpoint_dir(out.sparkSession)
    size = token_count_fast(F.col("distilled"), tokenizer)
    out = out.withColumn("_was", F.col("n_tokens")).withColumn("_now", size).checkpoint(eager=True)
    for rnd in range(2, max_rounds + 1):
        again = (F.col("status") == "ok") & (F.col("rounds") == rnd - 1) & (F.col("_now") > max_tokens) & (F.col("_now") < F.col("_was"))
        again = F.coalesce(again, F.lit(False))
        todo = out.filter(again)
        if todo.isEmpty():
            break
        nxt = distill_rows(todo.select(*keys, F.col("distilled").alias("_text")), keys, "_text", backend, max_tokens, chunk_tokens,
                           sep, 1, responses_path, "_next", tokenizer, parallelism)
        nxt = nxt.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_next", F.col("status").alias("_next_status"), F.col("error").alias("_next_error"))
        moved = todo.join(nxt, _same(todo, nxt, keys)).withColumn("distilled", F.col("_next")).withColumn("status", F.col("_next_status")) \
            .withColumn("error", F.col("_next_error")).withColumn("rounds", F.lit(rnd)).withColumn("_was", F.col("_now")).withColumn("_now", size)
        out = out.filter(~again).unionByName(moved.select(*out.columns)).checkpoint(eager=True)
    stuck = (F.col("status") == "ok") & (F.col("rounds") > 0) & (F.col("_now") > max_tokens)
    return out.withColumn("status", F.when(stuck, F.lit("over_budget")).otherwise(F.col("status"))).drop("_was", "_now")


def distill_rows(df: DataFrame, keys: list[str], text_col: str, backend: Backend,
                 max_tokens: int, chunk_tokens: int, sep: str = " ", max_rounds: int = 1,
                 responses_path: str | None = None, out_col: str = "distilled", tokenizer=None,
                 parallelism: int | None = None) -> DataFrame:
    """Distill for inputs with one text per key (an article, the abstracts
    of one annotation row).  Returns ``df`` with n_tokens, kind, rounds,
    ``out_col``, status and error added; every input column passes through.

    Rows within budget (and NULL texts) pass as they are.  With a native
    backend the chunks are cut and answered inside the row, without a shuffle.
    With a Python backend the rows over budget are written, their chunks
    answered and regrouped per key (bounded by the chunks of one text), and
    joined back to the written rows alone.
    """
    prefix = prefix_tokens(tokenizer=tokenizer)
    d = df.withColumn("n_tokens", token_count_fast(F.col(text_col), tokenizer))
    over = F.coalesce(F.col("n_tokens") > max_tokens, F.lit(False))
    none = F.lit(None).cast("string")
    kind = F.when(over, F.lit("chunk")).otherwise(F.lit("pass"))
    if backend.native(F.lit("")) is not None and responses_path is None:
        pieces = chunk_texts(F.col(text_col), chunk_tokens, prefix, tokenizer)
        said = F.array_join(F.transform(pieces, lambda x: backend.native(chunk_prompt(x))), sep)
        out = d.withColumn("kind", kind).withColumn(out_col, F.when(over, said).otherwise(F.col(text_col))) \
            .withColumn("rounds", over.cast("int")).withColumn("status", F.lit("ok")).withColumn("error", none)
    else:
        ensure_checkpoint_dir(df.sparkSession)
        long = d.filter(over).checkpoint(eager=True)
        c = chunk_rows(long.select(*keys, F.col(text_col).alias("_text")), "_text", max_tokens, chunk_tokens, prefix, tokenizer)
        asked = infer(c.select(*keys, "chunk_idx", chunk_prompt(F.col("chunk_text")).alias("_prompt")), "_prompt", backend, "_resp", responses_path, parallelism)
        said = _answers(asked, keys, sep).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("distilled").alias("_said"), "status", "error")
        chunked = long.join(said, _same(long, said, keys)).withColumn(out_col, F.col("_said")).drop("_said", *(f"_k_{k}" for k in keys))
        passed = d.filter(~over).withColumn("status", F.lit("ok")).withColumn("error", none).withColumn(out_col, F.col(text_col))
        out = passed.unionByName(chunked).withColumn("kind", kind).withColumn("rounds", over.cast("int"))
    if max_rounds > 1:
        out = _more_rounds(out.withColumnRenamed(out_col, "distilled"), keys, backend, max_tokens, chunk_tokens, sep, max_rounds,
                           responses_path, tokenizer, parallelism).withColumnRenamed("distilled", out_col)
    return out
