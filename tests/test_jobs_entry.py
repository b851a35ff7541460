"""Composite jobs (O45-O52), sinks and the driver contract."""

import os
import sys

from pyspark.sql import functions as F

from annolens.operators.embed import HashEmbedder
from annolens.operators.infer import LeadBackend
from annolens.plans import jobs as J
from annolens.sources import sinks as K

from conftest import SF001

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402


def test_index_keys(spark):
    a = spark.createDataFrame([(9606, 1, "first.", 3), (9606, 1, "second.", 8), (9606, 2, "x.", 9)],
                              "tax_id int, gene_id bigint, text string, row_ord bigint")
    genes = spark.createDataFrame([(1, 9606, "ABC")], "gene_id bigint, tax_id int, symbol string")
    idx = J.build_index(a, genes, HashEmbedder(16)).orderBy("gene_id", "idx").collect()
    assert [r.key for r in idx] == ["ABC-gt-1", "ABC-gt-2", "2-gt-1"]
    assert all(len(r.embedding) == 16 and r.type == "ground_truth" for r in idx)


def test_narrative_from_loaded_summaries(spark, tmp_path):
    s = spark.createDataFrame([("S", 0, "G1", "G1 binds X. More."), ("S", 1, "G2", None)],
                              "gene_set string, pos bigint, gene string, summary string")
    p = str(tmp_path / "summaries")
    K.write_summaries(s.withColumn("n_texts", F.lit(1).cast("bigint")).withColumn("status", F.lit("ok")), p)
    loaded = K.read_summaries(spark, p)
    n = J.process_narrative(loaded, ["gene_set"], LeadBackend(1), "test process").first()
    assert n.n_genes == 1 and n.narrative == "Gene G1: G1 binds X." and n.status == "ok"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["gene_set", "pos", "symbol", "gene_id", "idx", "row_ord", "text"]


def test_every_query_has_oracle():
    from annolens.plans.catalog import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_all_queries_run_on_smallest_scale(spark):
    from annolens.plans.catalog import QUERIES
    for name, q in QUERIES.items():
        q(spark, SF001).write.format("noop").mode("overwrite").save()
