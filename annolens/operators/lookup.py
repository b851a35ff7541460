"""Annotation lookups: filters (O13-O16), texts per gene / set / list
(O14, O23-O25, O27), distinct genes (O28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import resolve_tokens
from .scan import ordinal

# Fixed value: taxonomy ID of the species the reference restricts to (human).
HUMAN = 9606

# Sorts after every real row position: an added text goes last in its gene.
LAST_ORD = 1 << 62


def filter_species(df: DataFrame, tax_id: int = HUMAN) -> DataFrame:
    return df.filter(F.col("tax_id") == tax_id)


def filter_has_pmids(df: DataFrame) -> DataFrame:
    return df.filter(F.size("pmids") > 0)


def filter_has_text(df: DataFrame) -> DataFrame:
    return df.filter(F.length("text") > 0)


def texts_for_gene(annotations: DataFrame, gene_id: int, tax_id: int = HUMAN) -> DataFrame:
    """Texts of one gene in file order: (gene_id, idx, row_ord, text).

    The equality filters reach the Parquet scan; ``idx`` comes from the
    block scan, so even a gene with a third of all rows is numbered in
    parallel."""
    a = filter_species(annotations, tax_id).filter(F.col("gene_id") == F.lit(gene_id))
    return ordinal(a.select("gene_id", "row_ord", "text"), ["gene_id"], "row_ord", "idx")


def distinct_members(members: DataFrame, group_cols: list[str], token_col: str) -> DataFrame:
    """One row per distinct token of a group, at its first position."""
    return members.groupBy(*group_cols, token_col).agg(F.min("pos").alias("pos"))


def texts_for_members(members: DataFrame, annotations: DataFrame, aliases: DataFrame,
                      group_cols: list[str], token_col: str = "symbol",
                      tax_id: int = HUMAN, extra_texts: DataFrame | None = None) -> DataFrame:
    """Texts of every distinct member of every group: one row per (group, member, text).

    ``members`` has ``group_cols`` + ``pos`` + ``token_col``; a token given twice
    counts once, at its first position.  Tokens resolve with the mixed rule;
    annotations are filtered to the species and to non-empty text.
    ``extra_texts`` (gene_id, text) come after a gene's own texts.  Members
    whose gene has no text keep one row with ``idx``/``text`` NULL.
    Output: group_cols, pos, token, gene_id, idx, row_ord, text.
    """
    m = resolve_tokens(distinct_members(members, group_cols, token_col), token_col, aliases, "gene_id")
    a = filter_has_text(filter_species(annotations, tax_id)).select("gene_id", "row_ord", "text")
    if extra_texts is not None:
        more = extra_texts.filter(F.length("text") > 0).select("gene_id", F.lit(LAST_ORD).alias("row_ord"), "text")
        a = a.unionByName(more)
    # Texts of the asked genes, numbered once per gene; then one row per member.
    asked = a.join(m.select("gene_id").filter("gene_id is not null").distinct(), "gene_id", "left_semi")
    numbered = ordinal(asked, ["gene_id"], "row_ord", "idx").withColumn(
        "row_ord", F.when(F.col("row_ord") != LAST_ORD, F.col("row_ord")))
    cols = group_cols + ["pos", token_col, "gene_id", "idx", "row_ord", "text"]
    known = m.filter("gene_id is not null").join(numbered, "gene_id", "left").select(*cols)
    unknown = m.filter("gene_id is null")
    for c in ("idx", "row_ord", "text"):
        unknown = unknown.withColumn(c, F.lit(None).cast(known.schema[c].dataType))
    return known.unionByName(unknown.select(*cols))


def texts_by_gene_set(gene_sets: DataFrame, annotations: DataFrame, aliases: DataFrame,
                      tax_id: int = HUMAN, extra_texts: DataFrame | None = None) -> DataFrame:
    return texts_for_members(gene_sets, annotations, aliases, ["gene_set"], "symbol", tax_id, extra_texts)


def texts_by_gene_list(tokens: DataFrame, annotations: DataFrame, aliases: DataFrame,
                       tax_id: int = HUMAN, extra_texts: DataFrame | None = None) -> DataFrame:
    return texts_for_members(tokens, annotations, aliases, [], "token", tax_id, extra_texts)


def distinct_genes(annotations: DataFrame, tax_id: int = HUMAN) -> DataFrame:
    return filter_species(annotations, tax_id).select("gene_id").distinct()
