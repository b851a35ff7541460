"""Sinks: paired TSV (O09), summary checkpoint (O10/O11), embedding index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SUMMARIES

# Stands for NULL in the TSV, so that it differs from an empty field.
NULL_MARK = "\\N"
PAIRS_HEADER = ("gene id", "gene name", "ground truth", "synthetic")


def _tsv_safe(c):
    return F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ")


def write_pairs_tsv(pairs: DataFrame, path: str) -> None:
    """Header + four tab-separated fields; tabs and newlines inside a field become a
    space, other white space stays; a NULL is written as ``NULL_MARK``."""
    out = pairs.select(*[_tsv_safe(c).alias(h) for c, h in
                         zip(["gene_id", "gene_name", "ground_truth", "synthetic"], PAIRS_HEADER)])
    (out.write.mode("overwrite").option("sep", "\t").option("header", True)
        .option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", NULL_MARK)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_pairs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_pairs_tsv``, field by field: the CSV reader would take an empty field for NULL."""
    lines = spark.read.text(path).filter(F.col("value") != "\t".join(PAIRS_HEADER))
    parts = lines.select(F.split("value", "\t").alias("f"))

    def field(i: int):
        return F.when(F.get("f", F.lit(i)) != NULL_MARK, F.get("f", F.lit(i)))

    return parts.select(field(0).cast("bigint").alias("gene_id"), *(field(i).alias(c) for i, c in
                                                                  ((1, "gene_name"), (2, "ground_truth"), (3, "synthetic"))))


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Gene summary checkpoint ("create dry run")."""
    summaries.select(*[f.name for f in SUMMARIES.fields], *[c for c in summaries.columns
                                                            if c not in SUMMARIES.fieldNames()]) \
        .write.mode("overwrite").parquet(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Gene summary checkpoint ("load dry run"): feeds the process narrative directly."""
    return spark.read.parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """Embedding index as a Parquet table; ``build_index`` has clustered it by gene."""
    index.write.mode("overwrite").parquet(path)
