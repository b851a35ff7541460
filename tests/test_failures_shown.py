"""Bad input and failed model calls show: rejected lines, broken collections, parts of composite jobs, budgets."""

import gzip

import pytest
from pyspark.sql import functions as F

from annolens.operators.chunking import TOKENS_PER_WORD, budget_for_model, budget_plan
from annolens.operators.infer import CallableBackend
from annolens.plans import jobs as J
from annolens.sources import annotations as AN
from annolens.sources import genesets as G

HEADER = "#Tax ID\tGene ID\tPubMed ID (PMID) list\tlast update timestamp\tGeneRIF text\n"
LINES = ["9606\t1\t11\tnow\tgood one", "9606\t2\t12", "9606\tabc\t13\tnow\tbad gene", "x\t3\t14\tnow\tbad species",
         "9606\t4\t15\tnow\tmore\tfields", "9606\t5\t\tnow\tgood two", "10090\t6\t16,17\tnow\t\"quoted\" text"]


def test_rejected_lines(spark, tmp_path):
    src = str(tmp_path / "a.tsv.gz")
    with gzip.open(src, "wt") as f:
        f.write(HEADER + "\n".join(LINES) + "\n")
    bad = AN.annotation_rejects(spark, src).collect()
    assert {(r["reason"], r["line"]) for r in bad} == {("fields", LINES[1]), ("gene_id", LINES[2]), ("tax_id", LINES[3]), ("fields", LINES[4])}
    assert [r["row_ord"] for r in sorted(bad, key=lambda r: r["row_ord"])] == [1, 2, 3, 4] and all(r["file"].endswith("a.tsv.gz") for r in bad)
    good = AN.read_annotation_tsv(spark, src)
    assert [r["text"] for r in good.select("text", "row_ord").orderBy("row_ord").collect()] == ["good one", "good two", '"quoted" text']
    assert good.select("row_ord").count() == 3  # judged by all fields, whichever are read

    counts = AN.ingest_annotations(spark, src, str(tmp_path / "table"), rejects=str(tmp_path / "rejects"))
    assert counts == {"rows": 7, "rejects": 4}
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3 and spark.read.parquet(str(tmp_path / "rejects")).count() == 4


def test_broken_gene_set_file_is_an_error_with_its_name(spark, tmp_path):
    good, broken = tmp_path / "good.json", tmp_path / "broken.json"
    good.write_text('{"S1": {"geneSymbols": ["A", "B"], "other": 1}, "S2": {"geneSymbols": []}, "S3": {}}')
    assert [tuple(r) for r in G.read_gene_sets_json(spark, str(good)).orderBy("pos").collect()] == [("S1", 0, "A"), ("S1", 1, "B")]
    broken.write_text('{"S1": {"geneSymbols": ["A", "B"')
    with pytest.raises(Exception, match="no JSON gene sets.*broken.json"):
        G.read_gene_sets_json(spark, str(broken)).collect()
    (tmp_path / "kind.json").write_text('{"S1": {"geneSymbols": 5}}')
    with pytest.raises(Exception, match="(?i)variant|cast"):
        G.read_gene_sets_json(spark, str(tmp_path / "kind.json")).collect()


class Words:
    """A small world: genes 1 and 2 with texts, gene 3 with an abstract only."""

    def __init__(self, spark):
        self.annotations = spark.createDataFrame([(9606, 1, "alpha text", 0), (9606, 2, "beta text", 1)], "tax_id int, gene_id long, text string, row_ord long")
        self.genes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "gene_id long, symbol string")
        self.aliases = self.genes.select("symbol", "gene_id", F.lit(True).alias("is_official"))
        self.members = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "unknown")], "pos long, token string")
        self.gene_pmids = spark.createDataFrame([(1, 11), (3, 13)], "gene_id long, pmid long")
        self.abstracts = spark.createDataFrame([(11, "first abstract."), (13, "third abstract.")], "pmid long, text string")


def failing(word):
    """A model that fails on prompts that hold the word."""
    def fn(prompts):
        if any(word in p for p in prompts):
            raise RuntimeError(f"no answer to {word}")
        return ["Said so." for _ in prompts]
    return CallableBackend(f"failing on {word}", fn, max_attempts=1, backoff_s=0.0, batch_size=1)


def process(spark, word, **how):
    w = Words(spark)
    return J.genes_to_process(w.members, w.annotations, w.aliases, w.genes, w.gene_pmids, w.abstracts, failing(word), "a process", 1000, 500, **how)


def test_a_failed_summary_shows_in_the_narrative(spark):
    r = process(spark, "beta text").first()
    assert (r["n_genes"], r["status"]) == (1, "partial") and r["narrative"] == "Said so."
    assert r["error"].startswith("1 genes failed: ") and "no answer to beta text" in r["error"]


def test_all_summaries_failed(spark):
    rows = process(spark, " text").collect()
    assert [(r["n_genes"], r["narrative"], r["status"]) for r in rows] == [(0, None, "error")]
    assert rows[0]["error"].startswith("2 genes failed: ")


def test_a_failed_added_text_shows(spark):
    rows = {r["token"]: r for r in process(spark, "abstract.", add_abstracts=True, just_summaries=True).collect()}
    assert {t: r["status"] for t, r in rows.items()} == {"A": "partial", "B": "ok", "C": "error", "unknown": "unresolved"}
    assert rows["A"]["summary"] == "Said so." and rows["A"]["error"].startswith("abstracts: ") and rows["B"]["error"] is None
    r = process(spark, "abstract.", add_abstracts=True).first()
    assert (r["n_genes"], r["status"]) == (2, "partial") and "abstracts: " in r["error"]


def test_nothing_failed(spark):
    r = process(spark, "no such words", add_abstracts=True).first()
    assert (r["n_genes"], r["status"], r["error"]) == (3, "ok", None)


def test_rows_of_genes_show_failed_added_texts(spark):
    w = Words(spark)
    syn = J.create_annotations(w.genes, w.genes, w.gene_pmids, w.abstracts, failing("third"), "a process", 1000, 500)
    got = {r["gene_id"]: (r["status"], r["error"] is None) for r in J.with_failures(w.genes, J.failed_additions(syn)).collect()}
    assert got == {1: ("ok", True), 2: ("ok", True), 3: ("error", False)}


def test_budgets_in_model_tokens(spark):
    text = spark.createDataFrame([(1, "word " * 15_000)], "k int, text string")
    kinds = [budget_plan(text, ["k"], "text", *budget_for_model("", per_word)).first()["kind"] for per_word in (1.0, TOKENS_PER_WORD)]
    assert kinds == ["pass", "chunk"]
    assert budget_for_model("gpt-4-1106-preview", 2.0) == (64000, 8000)
    with pytest.raises(ValueError):
        budget_for_model("", 0)
