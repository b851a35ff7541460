"""Command line over small tables: the reference's main modes."""

import gzip
import json
import os

from annolens import cli

HEADER = "#Tax ID\tGene ID\tPubMed ID (PMID) list\tlast update timestamp\tGeneRIF text\n"


def setup_tables(spark, tmp):
    rifs = os.path.join(tmp, "rifs.tsv.gz")
    with gzip.open(rifs, "wt") as f:
        f.write(HEADER)
        f.write("9606\t1\t10\tt\tG1 binds X\n9606\t1\t11,12\tt\tG1 activates Y.\n9606\t2\t12\tt\tG2 is a kinase.\n")
    spark.createDataFrame([(1, 9606, "G1"), (2, 9606, "G2")], "gene_id bigint, tax_id int, symbol string") \
        .write.parquet(os.path.join(tmp, "genes"))
    spark.createDataFrame([(10, "Abstract ten. More."), (11, "Abstract eleven."), (12, "Abstract twelve.")],
                          "pmid bigint, text string").write.parquet(os.path.join(tmp, "abstracts"))
    spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "gene_id bigint, pmid bigint").write.parquet(
        os.path.join(tmp, "gene_pmids"))
    spark.createDataFrame([(10, 500, 1)], "pmid bigint, pmcid bigint, link_ord int").write.parquet(
        os.path.join(tmp, "links"))
    spark.createDataFrame([(500, "<article><p>Body one. Body two. Body three.</p></article>")],
                          "pmcid bigint, body string").write.parquet(os.path.join(tmp, "articles"))
    with open(os.path.join(tmp, "sets.json"), "w") as f:
        json.dump({"SET_A": {"geneSymbols": ["G1", "G2", "G9"]}}, f)
    with open(os.path.join(tmp, "list.txt"), "w") as f:
        f.write("G1\n\n2\n")
    return ["--annotations", rifs, "--cache", os.path.join(tmp, "cache"), "--genes", os.path.join(tmp, "genes"),
            "--gene-sets", os.path.join(tmp, "sets.json"), "--abstracts", os.path.join(tmp, "abstracts"),
            "--gene-pmids", os.path.join(tmp, "gene_pmids"), "--article-links", os.path.join(tmp, "links"),
            "--articles", os.path.join(tmp, "articles"), "--backend", "lead:1"]


def test_every_row_is_printed(spark, capsys):
    cli.emit(spark.range(1500), None)
    assert len(capsys.readouterr().out.splitlines()) == 1501


def test_cli_modes(spark, tmp_path, capsys):
    tmp = str(tmp_path)
    base = setup_tables(spark, tmp)
    g = cli.main(base + ["-g", "G1", "--out", os.path.join(tmp, "g")], spark)
    assert [r.text for r in g.orderBy("idx").collect()] == ["G1 binds X", "G1 activates Y."]
    s = cli.main(base + ["-s", "SET_A", "--out", os.path.join(tmp, "s")], spark)
    assert s.count() == 4                                   # G1 x2, G2, G9 without text
    f = cli.main(base + ["-f", os.path.join(tmp, "list.txt"), "--out", os.path.join(tmp, "f")], spark)
    assert f.count() == 3
    summ = os.path.join(tmp, "summ")
    cli.main(base + ["-s", "SET_A", "-p", "hypoxia", "-a", "-d", summ], spark)
    loaded = spark.read.parquet(summ)
    assert loaded.filter("status = 'ok'").count() == 2
    n = cli.main(base + ["-p", "hypoxia", "-r", summ, "--out", os.path.join(tmp, "n")], spark).first()
    assert n.n_genes == 2 and n.narrative.startswith("Gene G")
    y = os.path.join(tmp, "pairs")
    cli.main(base + ["-y", y, "--chunk-backend", "lead:1"], spark)
    assert sorted(r.gene_name for r in spark.read.option("sep", "\t").option("header", True).csv(y)
                  .withColumnRenamed("gene name", "gene_name").collect()) == ["G1", "G1", "G2"]
    m = cli.main(base + ["-m", "10", "-t", "e3-ligase", "--out", os.path.join(tmp, "m")], spark).first()
    assert m.status == "ok" and m.summary == "Body one."
    none = os.path.join(tmp, "no_pairs")
    assert cli.main(base + ["-g", "NOSUCHGENE", "-y", none], spark).count() == 0   # not: all genes
    a = cli.main(base + ["-s", "SET_A", "-a", "--out", os.path.join(tmp, "a")], spark)
    assert a.count() == 6                                   # one text from the abstracts of G1 and G2 each
    with open(os.path.join(tmp, "reversed.txt"), "w") as fh:
        fh.write("2\nG1\nG1\n")
    cli.main(base + ["-f", os.path.join(tmp, "reversed.txt"), "-p", "hypoxia", "-d", summ + "2"], spark)
    n = cli.main(base + ["-p", "hypoxia", "-r", summ + "2", "--out", os.path.join(tmp, "n2")], spark).first()
    assert n.n_genes == 2 and n.narrative.startswith("Gene G2")  # list order, a repeated gene counts once
    idx = os.path.join(tmp, "idx")
    cli.main(base + ["-i", idx], spark)
    assert sorted(r.key for r in spark.read.parquet(idx).collect()) == ["G1-gt-1", "G1-gt-2", "G2-gt-1"]
    store = os.path.join(tmp, "store")
    first = cli.main(base + ["--update-index", store], spark).count()
    assert first == cli.main(base + ["--update-index", store], spark).count() == spark.read.parquet(idx).count()
    assert "0 entries embedded" in capsys.readouterr().out
