"""Gene identifier resolution (O20 symbol->ID, O21 ID->symbol, O22 mixed tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_numeric_token, strip


def best_aliases(aliases: DataFrame) -> DataFrame:
    """One gene per symbol: an official symbol wins, then the lowest gene ID."""
    w = Window.partitionBy("symbol").orderBy(F.col("is_official").desc(), F.col("gene_id").asc())
    return (aliases.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1")
                   .select(F.col("symbol").alias("_sym"), F.col("gene_id").alias("_sym_gene_id")))


def resolve_symbols(df: DataFrame, token_col: str, aliases: DataFrame, out_col: str = "gene_id") -> DataFrame:
    """Symbol -> gene ID; NULL when the symbol is unknown."""
    best = best_aliases(aliases)
    j = df.join(best, F.col(token_col) == F.col("_sym"), "left")
    return j.withColumn(out_col, F.col("_sym_gene_id")).drop("_sym", "_sym_gene_id")


def resolve_ids(df: DataFrame, id_col: str, genes: DataFrame, out_col: str = "symbol") -> DataFrame:
    """Gene ID -> symbol; NULL when the ID is unknown."""
    g = genes.select(F.col("gene_id").alias("_gid"), F.col("symbol").alias("_gsym"))
    j = df.join(g, F.col(id_col) == F.col("_gid"), "left")
    return j.withColumn(out_col, F.col("_gsym")).drop("_gid", "_gsym")


def resolve_tokens(df: DataFrame, token_col: str, aliases: DataFrame, out_col: str = "gene_id") -> DataFrame:
    """Numeric token -> that ID; any other token -> symbol lookup (one rule everywhere)."""
    tok = strip(F.col(token_col).cast("string"))
    d = df.withColumn("_tok", tok)
    r = resolve_symbols(d, "_tok", aliases, "_by_symbol")
    numeric = F.when(is_numeric_token(F.col("_tok")), F.col("_tok").try_cast("bigint"))
    return r.withColumn(out_col, F.coalesce(numeric, F.col("_by_symbol"))).drop("_tok", "_by_symbol")


def resolve_token_value(aliases: DataFrame, token: str) -> int | None:
    """Resolve one token given on the command line / as a parameter.

    A numeric token is its own ID (no job); a symbol is one filtered read
    of the dictionary."""
    t = str(token).strip()
    if t.isascii() and t.isdigit():
        return int(t)
    r = best_aliases(aliases.filter(F.col("symbol") == t)).first()
    return None if r is None else r["_sym_gene_id"]
