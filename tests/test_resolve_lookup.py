"""Resolution (O20-O22), lookups (O13-O16, O23-O25, O27-O30) and the block scan."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from annolens.operators import lookup, resolve
from annolens.operators.scan import exclusive_prefix_sum, ordinal

ALIASES = [("ABC", 10, True), ("abc", 10, False), ("SHARED", 12, False), ("SHARED", 11, False),
           ("DEF", 12, True), ("DEF", 3, False)]


def aliases(spark):
    return spark.createDataFrame(ALIASES, "symbol string, gene_id bigint, is_official boolean")


def test_resolve_tokens(spark):
    toks = spark.createDataFrame([(0, "230"), (1, "ABC"), (2, "NOPE"), (3, "SHARED"), (4, "DEF"), (5, " 7\n")],
                                 "pos bigint, token string")
    r = {x.pos: x.gene_id for x in resolve.resolve_tokens(toks, "token", aliases(spark)).collect()}
    assert r == {0: 230, 1: 10, 2: None, 3: 11, 4: 12, 5: 7}


def test_resolve_ids(spark):
    genes = spark.createDataFrame([(10, 9606, "ABC")], "gene_id bigint, tax_id int, symbol string")
    df = spark.createDataFrame([(10,), (99,)], "gene_id bigint")
    assert sorted((r.gene_id, r.symbol) for r in resolve.resolve_ids(df, "gene_id", genes).collect()) == \
        [(10, "ABC"), (99, None)]


def annotations(spark):
    rows = [(9606, 10, [1], "t1", 0), (9606, 10, [2], "t2", 5), (10090, 10, [3], "mouse", 6),
            (9606, 12, [], "", 7), (9606, 12, [4], "t12", 9)]
    return spark.createDataFrame(rows, "tax_id int, gene_id bigint, pmids array<bigint>, text string, row_ord bigint")


def test_texts_by_gene_set_keeps_empty_members(spark):
    sets = spark.createDataFrame([("S", 0, "ABC"), ("S", 1, "GHOST"), ("S", 2, "DEF")],
                                 "gene_set string, pos bigint, symbol string")
    r = lookup.texts_by_gene_set(sets, annotations(spark), aliases(spark)).collect()
    got = sorted((x.pos, x.idx, x.text) for x in r)
    assert got == [(0, 1, "t1"), (0, 2, "t2"), (1, None, None), (2, 1, "t12")]


def test_a_token_given_twice_counts_once(spark):
    toks = spark.createDataFrame([(0, "1"), (1, "1")], "pos bigint, token string")
    ann = spark.createDataFrame([(9606, 1, 0, "a."), (9606, 1, 1, "b.")], "tax_id int, gene_id bigint, row_ord bigint, text string")
    more = spark.createDataFrame([(1, "added.")], "gene_id bigint, text string")
    got = sorted((r.pos, r.idx, r.text) for r in lookup.texts_by_gene_list(toks, ann, aliases(spark), extra_texts=more).collect())
    assert got == [(0, 1, "a."), (0, 2, "b."), (0, 3, "added.")]


def test_filters(spark):
    a = annotations(spark)
    assert lookup.filter_species(a).count() == 4
    assert lookup.filter_has_pmids(a).count() == 4
    assert lookup.filter_has_text(a).count() == 4
    assert [r.text for r in lookup.texts_for_gene(a, 10).orderBy("idx").collect()] == ["t1", "t2"]
    assert sorted(r.gene_id for r in lookup.distinct_genes(a).collect()) == [10, 12]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), min_size=1, max_size=60),
       st.integers(1, 7))
def test_block_scan_equals_window(spark, rows, block):
    data = [(k, i * 3 + 1, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, o bigint, v bigint")
    got = exclusive_prefix_sum(df, ["k"], "o", "v", "s", block_rows=block, total_col="t")
    w = Window.partitionBy("k").orderBy("o")
    exp = df.withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
            .withColumn("t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    assert sorted(map(tuple, got.select("k", "o", "s", "t").collect())) == \
        sorted(map(tuple, exp.select("k", "o", "s", "t").collect()))
    idx = ordinal(df, ["k"], "o", "idx", block_rows=block)
    exp_idx = df.withColumn("idx", F.row_number().over(w))
    assert sorted(map(tuple, idx.select("k", "o", "idx").collect())) == \
        sorted(map(tuple, exp_idx.select("k", "o", "idx").collect()))
