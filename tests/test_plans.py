"""Physical-plan properties the design relies on at scale."""

import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from annolens.operators import literature as LIT
from annolens.operators import lookup, resolve
from annolens.operators.infer import LeadBackend, infer
from annolens.operators.scan import ordinal


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def conf(spark, **kv):
    old = {k: spark.conf.get(k) for k in kv}
    for k, v in kv.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def aliases(spark):
    return spark.createDataFrame([("A", 1, True), ("B", 2, True)], "symbol string, gene_id bigint, is_official boolean")


def test_species_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "ann")
    spark.range(2000).select(F.lit(9606).alias("tax_id"), (F.col("id") % 3).alias("gene_id"),
                             F.col("id").alias("row_ord"), F.lit("text").alias("text"),
                             F.array(F.col("id")).alias("pmids")).write.partitionBy("tax_id").parquet(path)
    ann = spark.read.parquet(path)
    sets = spark.createDataFrame([("S", 0, "A"), ("S", 1, "B")], "gene_set string, pos bigint, symbol string")
    with conf(spark, **{"spark.sql.adaptive.enabled": "false"}):
        p = plan(lookup.texts_by_gene_set(sets, ann, aliases(spark)))
    assert re.search(r"PartitionFilters: \[[^\]]*tax_id#\d+ = 9606", p)


def test_topk_has_partial_limit_before_shuffle(spark):
    gp = spark.range(1000).select((F.col("id") % 5).alias("gene_id"), F.col("id").alias("pmid"))
    p = plan(LIT.top_pmids_per_gene(gp, 10))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_block_scan_shuffles_large_side_once(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"))
    with conf(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        p = plan(ordinal(df, ["k"], "o", "idx", block_rows=64))
    # block partial aggregate, window over blocks, join re-keying of the
    # block table, and one exchange of the rows shared by join and window.
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 4


def test_native_model_is_a_projection(spark):
    df = spark.range(10).select(F.concat(F.lit("Do.\n\nA. B. C."), F.col("id").cast("string")).alias("p"))
    p = plan(infer(df, "p", LeadBackend(1)))
    assert "Exchange" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_hot_key_is_spread_over_tasks(spark):
    """One key with all rows: the in-block window runs in several tasks and
    still numbers the key 1..n."""
    n = 4000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    with conf(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}):
        out = ordinal(df, ["k"], "o", "idx", block_rows=100).select("idx", F.spark_partition_id().alias("p"))
        rows = out.collect()
    assert sorted(r.idx for r in rows) == list(range(1, n + 1))
    assert len({r.p for r in rows}) >= 4


def test_building_a_query_runs_no_job(spark):
    """No counting jobs: Spark decides between join strategies from sizes in bytes."""
    from annolens.plans.catalog import QUERIES
    group = "building"
    spark.sparkContext.setJobGroup(group, "plans only")
    try:
        for name in ("resolve_tokens", "resolve_ids", "texts_by_gene_set", "texts_by_gene_list", "index_rows", "distill", "summarize_genes", "pairs_inputs", "article_lookup", "create_annotations"):
            QUERIES[name](spark, "/root/testdata/sf0.001")
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        # one tiny job per Parquet table reads a footer for its schema
        names = [spark.sparkContext.statusTracker().getJobInfo(i) for i in ids]
        assert all(len(x.stageIds) == 1 for x in names if x)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_dictionary_of_many_partitions_is_joined_by_a_shuffle(spark):
    big = spark.range(0, 1000, 1, 40).select(F.col("id").cast("string").alias("symbol"), F.col("id").alias("gene_id"), F.lit(True).alias("is_official"))
    toks = spark.range(50).select(F.col("id").cast("string").alias("token"))
    with conf(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        df = resolve.resolve_tokens(toks.withColumn("token", F.concat(F.lit("0"), "token")), "token", big)
        assert "SortMergeJoin" in plan(resolve.resolve_symbols(toks, "token", big)) and "Broadcast" not in plan(df)
        assert resolve.resolve_symbols(toks, "token", big).filter("gene_id is not null").count() == 50


def test_article_lookup_cuts_links_and_articles_first(spark):
    links = spark.range(100).select(F.col("id").alias("pmid"), F.col("id").alias("pmcid"), F.lit(1).alias("link_ord"))
    articles = spark.range(100).select(F.col("id").alias("pmcid"), F.lit("body").alias("body"))
    one = spark.createDataFrame([(7,), (1000,)], "pmid bigint")
    with conf(spark, **{"spark.sql.adaptive.enabled": "false"}):
        p = plan(LIT.article_lookup(one, links, articles))
    assert p.index("Window") < p.index("LeftSemi", p.index("Window"))  # the semi-join lies under the window
    assert "Exchange hashpartitioning(pmcid" not in p  # no article is shuffled for a few PMIDs
    assert {(r.pmid, r.status) for r in LIT.article_lookup(one, links, articles).collect()} == {(7, "ok"), (1000, "no_link")}


def test_index_embeds_each_text_once(spark, tmp_path):
    from annolens.operators.embed import PandasEmbedder
    from annolens.plans.jobs import build_index
    from annolens.sources.sinks import write_index
    log = str(tmp_path / "texts")

    def load():
        import numpy as np

        def encode(texts):
            with open(log, "a") as f:
                f.writelines("x\n" for _ in texts)
            return np.ones((len(texts), 4), np.float32)
        return encode

    ann = spark.range(1000).select(F.lit(9606).alias("tax_id"), (F.col("id") % 7).alias("gene_id"), F.col("id").alias("row_ord"), F.lit("text").alias("text"))
    genes = spark.createDataFrame([(1, "A")], "gene_id bigint, symbol string")
    write_index(build_index(ann, genes, PandasEmbedder("count", 4, load)), str(tmp_path / "index"))
    assert len(open(log).read().splitlines()) == 1000 == spark.read.parquet(str(tmp_path / "index")).count()
