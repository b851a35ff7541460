"""Scans and sinks: annotation TSV (O01-O03), gene sets (O04), gene lists (O05), sinks."""

import gzip
import json
import os

from pyspark.sql import functions as F

from annolens.sources import annotations as A
from annolens.sources import genesets as G
from annolens.sources import sinks as K

HEADER = "#Tax ID\tGene ID\tPubMed ID (PMID) list\tlast update timestamp\tGeneRIF text\n"
ROWS = [
    (9606, 2, "1,2", "2010-01-01 00:00", 'A "quoted" statement'),
    (9606, 2, "3", "2010-01-01 00:00", "second text of gene 2"),
    (10090, 5, "", "2011-01-01 00:00", "mouse text"),
    (9606, 7, "4", "2012-01-01 00:00", "gene seven"),
]


def write_tsv(path):
    with gzip.open(path, "wt", encoding="utf-8", newline="") as f:
        f.write(HEADER)
        for r in ROWS:
            f.write("\t".join(str(x) for x in r) + "\n")


def test_annotation_tsv_scan(spark, tmp_path):
    p = str(tmp_path / "rifs.tsv.gz")
    write_tsv(p)
    df = A.read_annotation_tsv(spark, p).orderBy("row_ord").collect()
    assert [r["text"] for r in df] == [r[4] for r in ROWS]       # file order, quotes literal
    assert [list(r["pmids"]) for r in df] == [[1, 2], [3], [], [4]]
    assert df[0]["tax_id"] == 9606 and df[0]["gene_id"] == 2


def test_ingest_read_through(spark, tmp_path):
    src = str(tmp_path / "rifs.tsv.gz")
    write_tsv(src)
    cache = str(tmp_path / "cache")
    a = A.load_annotations(spark, src, cache)
    assert a.count() == len(ROWS)
    assert os.path.isdir(os.path.join(cache, "tax_id=9606"))
    # second call reads the cache
    b = A.load_annotations(spark, str(tmp_path / "missing.tsv.gz"), cache)
    assert sorted(r["text"] for r in b.collect()) == sorted(r[4] for r in ROWS)
    plan = b.filter(F.col("tax_id") == 9606)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "9606" in plan


def test_gene_sets_json(spark, tmp_path):
    p = tmp_path / "sets.json"
    p.write_text(json.dumps({"HALLMARK_A": {"geneSymbols": ["X", "Y"], "pmid": "1"},
                             "HALLMARK_B": {"geneSymbols": ["Z"]}}))
    rows = G.read_gene_sets_json(spark, str(p)).orderBy("gene_set", "pos").collect()
    assert [(r.gene_set, r.pos, r.symbol) for r in rows] == [("HALLMARK_A", 0, "X"), ("HALLMARK_A", 1, "Y"),
                                                           ("HALLMARK_B", 0, "Z")]
    assert G.gene_set_members(spark, str(p), "HALLMARK_B").count() == 1
    try:
        G.gene_set_members(spark, str(p), "NOPE")
        raise AssertionError("expected an error for an unknown set")
    except ValueError:
        pass


def test_gene_list_file(spark, tmp_path):
    p = tmp_path / "genes.txt"
    p.write_text("TMEM45A\n\n230\n")
    assert [r.token for r in G.read_gene_list(spark, str(p)).orderBy("pos").collect()] == ["TMEM45A", "230"]


def test_pairs_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "G1", "truth\twith tab", "synthetic\nline")],
                               "gene_id bigint, gene_name string, ground_truth string, synthetic string")
    out = str(tmp_path / "pairs")
    K.write_pairs_tsv(df, out)
    files = [f for f in os.listdir(out) if f.startswith("part-")]
    text = "".join(open(os.path.join(out, f)).read() for f in files)
    assert text.splitlines()[0] == "gene id\tgene name\tground truth\tsynthetic"
    back = K.read_pairs_tsv(spark, out).collect()
    assert back[0]["ground_truth"] == "truth with tab" and back[0]["synthetic"] == "synthetic line"


def test_pairs_tsv_keeps_space_empty_and_null(spark, tmp_path):
    rows = [(1, "G1", "  lead and trail  ", ""), (2, None, "", None), (3, " ", 'with "quotes"', "a\\b")]
    df = spark.createDataFrame(rows, "gene_id bigint, gene_name string, ground_truth string, synthetic string")
    K.write_pairs_tsv(df, str(tmp_path / "pairs"))
    assert sorted(tuple(r) for r in K.read_pairs_tsv(spark, str(tmp_path / "pairs")).collect()) == rows


def test_summary_checkpoint_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "G1", "s1", 2, "ok"), (1, "G2", None, 0, "no_text")],
                               "pos bigint, gene string, summary string, n_texts bigint, status string")
    p = str(tmp_path / "summaries")
    K.write_summaries(df, p)
    assert sorted(K.read_summaries(spark, p).collect()) == sorted(df.collect())


def test_row_order_over_many_splits(spark, tmp_path):
    """Plain (splittable) files cut into many small splits keep file order."""
    folder = tmp_path / "plain"
    folder.mkdir()
    n = 3000
    for part in range(2):
        with open(folder / f"part{part}.tsv", "w") as f:
            f.write(HEADER)
            for i in range(n):
                f.write(f"9606\t{i % 7}\t{i}\t2010\trow {part} {i:05d} " + "x" * 40 + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = A.read_annotation_tsv(spark, str(folder)).orderBy("row_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    texts = [r.text.split(" x")[0] for r in rows]
    assert texts == [f"row {p} {i:05d}" for p in range(2) for i in range(n)]
    assert len({r.row_ord for r in rows}) == 2 * n
