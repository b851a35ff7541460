"""Table schemas (FIXTURES.md §1)."""

from pyspark.sql import types as T

# Annotation TSV as published: five tab-separated columns with a header row.
ANNOTATION_TSV = T.StructType([
    T.StructField("tax_id", T.IntegerType()),
    T.StructField("gene_id", T.LongType()),
    T.StructField("pmid_list", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("text", T.StringType()),
])

# Annotations after ingest (Parquet, partitioned by tax_id).
ANNOTATIONS = T.StructType([
    T.StructField("tax_id", T.IntegerType()),
    T.StructField("gene_id", T.LongType()),
    T.StructField("pmids", T.ArrayType(T.LongType())),
    T.StructField("updated_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("row_ord", T.LongType()),
])

GENES = T.StructType([
    T.StructField("gene_id", T.LongType()),
    T.StructField("tax_id", T.IntegerType()),
    T.StructField("symbol", T.StringType()),
])

ALIASES = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("gene_id", T.LongType()),
    T.StructField("is_official", T.BooleanType()),
])

SUMMARIES = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("gene", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("n_texts", T.LongType()),
    T.StructField("status", T.StringType()),
])

PAIRS = T.StructType([
    T.StructField("gene_id", T.LongType()),
    T.StructField("gene_name", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("synthetic", T.StringType()),
])

RESPONSES = T.StructType([
    T.StructField("prompt_id", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
])

INDEX = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("gene_id", T.LongType()),
    T.StructField("gene_name", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
