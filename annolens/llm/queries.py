"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.llm import bpe, chat, decontam, html, linededup, lpf, quality, runs, simhash, topk, toxicity, transducer, variants
from annolens.llm.common import table
from annolens.llm.oracle import ORACLE

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its group of near-duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    texts = html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


#: A conversation whose texts hold the template's own control strings.
AWKWARD_ID, AWKWARD_TEXT = -7, "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and the awkward one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(AWKWARD_ID).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(AWKWARD_TEXT))
    return chat.digest(chat.format_conversations(rows.union(more)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by weights learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", folds=5, fold=0)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of the benchmark."""
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that every document loses to an equal or similar earlier line."""
    return linededup.decisions(table(spark, sf_dir, "documents"))


#: Least quality score of a document that is kept.
QUALITY_LEAST = 0.7


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a network fitted outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", folds=4, fold=2)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op10_lpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 50-byte strings of documents with smaller ids."""
    out = lpf.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, after a tenth of the documents was made periodic from some word on."""
    words = F.expr("regexp_extract_all(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    made = docs.where("h % 10 = 0").select("doc_id", "text", words.alias("w"), F.expr("h div 10").alias("g"))
    made = made.withColumn("n", F.size("w")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)")).withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) as int)"))
    tail = "if(n > 0, array_join(concat(slice(w, 1, a), transform(sequence(0, n - a - 1), i -> w[a + i % p])), ' '), text)"
    docs = docs.where("h % 10 <> 0 or h is null").select("doc_id", "text").union(made.select("doc_id", F.expr(tail)))
    found = runs.periodic_runs(docs, least=6, times=4)
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))").alias("best")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 2048


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document by the transducers compiled from a tokenizer file."""
    counted = transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one in 97 runs with a character left out, grouped by spelling."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(variants.lowered_runs(F.col("text"))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run")))
    cut = "concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))"
    words = runs.select(F.expr(f"if(h % 97 = 0, {cut}, run)").alias("word"))
    return variants.group_variants(variants.word_counts(words, least_length=5, least_count=3), factor=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_chat": op3_chat,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_decontam": op6_decontam,
    "op7_topk": op7_topk,
    "op8_lines": op8_lines,
    "op9_quality": op9_quality,
    "op10_lpf": op10_lpf,
    "op11_runs": op11_runs,
    "op12_tokens": op12_tokens,
    "op13_variants": op13_variants,
}

__all__ = ["ORACLE", "QUERIES"]
