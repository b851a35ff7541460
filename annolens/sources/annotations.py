"""Annotation table: TSV scan (O01), PMID list parse (O02), ingest/cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_pmid_list
from ..schemas import ANNOTATION_TSV


#: Holds a line of another number of fields; the fields of the others are judged as text.
CORRUPT = "_corrupt_line"
#: The fields as they stand in the file, and the numbers among them.
RAW_TSV = T.StructType([*(T.StructField(f.name, T.StringType()) for f in ANNOTATION_TSV), T.StructField(CORRUPT, T.StringType())])
NUMBERS = [f for f in ANNOTATION_TSV if f.dataType != T.StringType()]


def _scan_tsv(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """All lines of the file with ``row_ord``, the file's name and ``reason``, why a line is no annotation (null: it is one)."""
    raw = (spark.read.schema(RAW_TSV)
           .option("sep", "\t").option("header", header).option("quote", "")
           .option("escape", "").option("lineSep", "\n").option("mode", "PERMISSIVE")
           # Fields are counted whichever of them a query reads.
           .option("columnPruning", False).option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("fields"))
    for f in NUMBERS:
        number = F.col(f.name).try_cast(f.dataType)
        reason = reason.when((F.col(f.name) != "") & number.isNull(), F.lit(f.name))
    raw = raw.withColumn("reason", reason)
    keyed = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"),
    )
    splits = keyed.groupBy("_f", "_b").agg(F.min("_m").alias("_m0"))
    w = Window.orderBy("_f", "_b")   # one row per input split: a small table
    splits = splits.withColumn("_rank", F.row_number().over(w).cast("bigint") - 1)
    j = keyed.join(splits, ["_f", "_b"])
    return j.withColumn("row_ord", F.col("_rank") * F.lit(1 << 32) + (F.col("_m") - F.col("_m0")))


def _annotations(scanned: DataFrame) -> DataFrame:
    return (scanned.filter(F.col("reason").isNull())
            .withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in NUMBERS})
            .withColumn("pmid_list", F.coalesce(F.col("pmid_list"), F.lit("")))
            .withColumn("pmids", parse_pmid_list("pmid_list"))
            .select("tax_id", "gene_id", "pmid_list", "pmids", "updated_at", "text", "row_ord"))


def read_annotation_tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Scan the published tab-separated file (gzip or plain).

    Explicit schema, header row skipped, quotes are literal characters
    (annotation text is prose), lines end with ``\\n``.  Lines that do not fit
    are left out; ``annotation_rejects`` has them.

    ``row_ord`` keeps file order without sorting the rows: every input split
    is a (file, byte offset) pair and rows inside a split keep their reading
    order (``monotonically_increasing_id`` increases within a task).  The
    small table of splits (one row per split, ~800k for 100 TB) is ranked in
    (file, offset) order and joined back; ``row_ord = split_rank * 2^32 +
    position inside the split``.
    """
    return _annotations(_scan_tsv(spark, path, header))


def annotation_rejects(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The lines that are no annotations: file, row_ord (place in the order of the scan), reason, line.

    reason: ``fields`` (not five of them), ``tax_id`` or ``gene_id`` (no whole number)."""
    return _rejects(_scan_tsv(spark, path, header))


def _rejects(scanned: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", *(F.coalesce(f.name, F.lit("")) for f in ANNOTATION_TSV))
    bad = scanned.filter(F.col("reason").isNotNull())
    return bad.select(F.col("_f").alias("file"), "row_ord", "reason", F.coalesce(CORRUPT, line).alias("line"))


def ingest_annotations(spark: SparkSession, src: str, dst: str, files_per_range: int | None = None,
                       rejects: str | None = None) -> dict[str, int]:
    """TSV -> Parquet partitioned by ``tax_id``, clustered by (gene_id, row_ord).

    A range partitioning on (tax_id, gene_id, row_ord) splits a gene that
    holds a large share of all rows over many tasks, and the per-file sort
    gives Parquet row-group statistics on gene_id for filter pushdown.

    Returns {"rows": lines read, "rejects": lines left out}, counted by the
    write itself; with ``rejects`` the lines left out are written there.
    """
    scanned = _scan_tsv(spark, src, True)
    keys = ("tax_id", "gene_id", "row_ord")
    typed = [F.col(k).try_cast(ANNOTATION_TSV[k].dataType) if k in ANNOTATION_TSV.fieldNames() else F.col(k) for k in keys]
    # Without an explicit count AQE sizes the ranges from the data.
    ranged = scanned.repartitionByRange(files_per_range, *typed) if files_per_range else scanned.repartitionByRange(*typed)
    seen = Observation("annotations")
    # Counted behind the exchange: the sampling of ranges reads the lines once more.
    counted = ranged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("reason").alias("rejects"))
    (_annotations(counted).sortWithinPartitions(*keys)
           .write.mode("overwrite").partitionBy("tax_id").parquet(dst))
    if rejects:
        _rejects(scanned).write.mode("overwrite").parquet(rejects)
    return {k: int(v) for k, v in seen.get.items()}


#: Buckets of a bucketed table; about the rows of all genes by a few hundred MB.
BUCKETS = 64


def save_bucketed(annotations: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Annotations as the table ``table``, bucketed by gene and sorted by (gene_id, row_ord), its files below ``path``.

    Joins and aggregates by gene then move no annotation: the files of a bucket
    are a partition already.  A gene is in one bucket, whatever its size; where a
    gene is larger than a task should hold, the ranged files of ``ingest_annotations``
    spread it, and the operators by gene and block work on those.
    """
    dealt = annotations.repartition(buckets, "gene_id").sortWithinPartitions("gene_id", "row_ord")  # a task for each bucket, a file from each task
    (dealt.write.mode("overwrite").format("parquet").option("path", path)
          .bucketBy(buckets, "gene_id").sortBy("gene_id", "row_ord").saveAsTable(table))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def load_annotations(spark: SparkSession, src: str, cache: str) -> DataFrame:
    """Read-through cache: read ``cache`` if a finished table is there, else ingest first.

    A folder without the writer's success mark is an ingest that did not end;
    it is written anew.  Other errors are not taken for an absent table."""
    if _finished(spark, cache):
        return read_annotations(spark, cache)
    ingest_annotations(spark, src, cache)
    return read_annotations(spark, cache)
