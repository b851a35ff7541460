"""Gene-set collection (O04) and gene-list files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def parse_gene_sets(df: DataFrame, col: str = "value", source: str | None = None) -> DataFrame:
    """JSON text ``{"set": {"geneSymbols": [...]}, ...}`` -> (gene_set, pos, symbol).

    ``pos`` is the 0-based position in the set's member list.  A document is
    read as a VARIANT and gives one row for each set, so no schema of all sets
    is built; on documents in rows (JSON Lines) the work spreads over tasks.
    A document that is no JSON, or a member list that is none, is an error that
    names the column ``source`` (a file) or else shows how the text begins.
    """
    named = F.col(source) if source else F.concat(F.lit("text beginning "), F.substring(col, 1, 40))
    v = F.coalesce(F.try_parse_json(col), F.raise_error(F.concat(F.lit("no JSON gene sets: "), named)).cast("variant"))
    docs = df.filter(F.col(col).isNotNull()).select(v.alias("_v"))
    sets = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    members = F.variant_get("value", "$.geneSymbols", "array<string>")
    return sets.select(F.col("key").alias("gene_set"), F.posexplode(members).alias("pos", "symbol"))


def read_gene_sets_json(spark: SparkSession, path: str) -> DataFrame:
    """A published collection file holds one JSON object; read it whole
    (collections are curated files), then parse as above."""
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    return parse_gene_sets(docs, "value", "_file")


def gene_set_members(spark: SparkSession, path: str, gene_set: str) -> DataFrame:
    """Members of one named set; an unknown name is an error, as in the reference."""
    m = read_gene_sets_json(spark, path).filter(F.col("gene_set") == gene_set)
    if not m.limit(1).count():
        raise ValueError(f"gene set {gene_set!r} not found in {path}")
    return m


def clean_gene_list(df: DataFrame, line_col: str = "line", pos_col: str = "line_no") -> DataFrame:
    """Strip every line and drop blank ones -> (pos, token)."""
    return (df.select(F.col(pos_col).alias("pos"), strip(F.col(line_col)).alias("token"))
              .filter(F.col("token") != ""))


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """One symbol or numeric ID per line -> (pos, token) in file order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return clean_gene_list(lines)
