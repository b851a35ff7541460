"""Annotations bucketed by gene (O03): round trip, and plans that do not move them."""

from pyspark.sql import functions as F

from annolens.sources import annotations as AN


def saved(spark, path, n=500):
    a = spark.range(n).select(F.lit(9606).alias("tax_id"), (F.col("id") * 7 % 23).alias("gene_id"), F.col("id").alias("row_ord"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    AN.save_bucketed(a, "bucketed_test", path, buckets=5)
    return a, spark.table("bucketed_test")


def exchanges_above_scan(plan):
    """Exchange lines between the root and the scan of the bucketed table, on that branch."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "bucketed_test" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*(0123456789)"))
    out = []
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if indent < depth:
            depth = indent
            out.append(line.strip())
    return [x for x in out if "Exchange" in x and "Broadcast" not in x]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip_and_files(spark, tmpdir_path):
    a, t = saved(spark, f"{tmpdir_path}/t")
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, a.collect()))
    assert t.select(F.input_file_name()).distinct().count() <= 5  # a file for each bucket
    by_file = t.select(F.input_file_name().alias("f"), "gene_id").distinct().groupBy("gene_id").count()
    assert by_file.where("count > 1").count() == 0


def test_aggregates_and_joins_by_gene_move_no_annotation(spark, tmpdir_path):
    _, t = saved(spark, f"{tmpdir_path}/t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = t.groupBy("gene_id").agg(F.count("*").alias("n"))
        assert exchanges_above_scan(plan_of(counted)) == []
        members = spark.range(10).select(F.col("id").alias("gene_id"))
        assert exchanges_above_scan(plan_of(t.join(members, "gene_id", "left_semi"))) == []
        plain = spark.read.parquet(f"{tmpdir_path}/t").groupBy("gene_id").count()
        assert "Exchange hashpartitioning(gene_id" in plan_of(plain)  # the same files without the table
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
