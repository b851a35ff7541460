"""Literature lookups as joins: articles (O06), abstracts by PMID (O07),
top-k abstracts per gene (O08, O31), enrichment for paired data (O26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARTICLE_SEP, strip_fences
from .lookup import filter_has_pmids, filter_has_text, filter_species

ABSTRACT_SEP = "\n\n"


def first_links(links: DataFrame) -> DataFrame:
    """The first PMC link of every PMID (row_number = 1; the limit is applied
    per task before the shuffle)."""
    w = Window.partitionBy("pmid").orderBy("link_ord", "pmcid")
    return links.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").select("pmid", "pmcid")


def article_lookup(pmids: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """PMID -> first PMC id -> XML body.  status: ok / no_link / missing.

    Links and articles are cut to what is asked for before they are ranked or
    joined; PMIDs without a link skip the article join (no NULL key meets there).
    """
    asked = pmids.select("pmid")
    linked = first_links(links.join(asked, "pmid", "left_semi"))
    wanted = articles.select("pmcid", "body").join(linked.select("pmcid"), "pmcid", "left_semi")
    bodies = linked.join(wanted, "pmcid", "left").select("pmid", "pmcid", "body")
    j = asked.join(bodies, "pmid", "left")
    status = (F.when(F.col("pmcid").isNull(), F.lit("no_link"))
               .when(F.col("body").isNull(), F.lit("missing")).otherwise(F.lit("ok")))
    return j.select("pmid", "pmcid", status.alias("status"), "body")


def abstracts_by_pmid(rows: DataFrame, abstracts: DataFrame, list_col: str = "pmids",
                      id_col: str = "row_ord") -> DataFrame:
    """Every PMID of every row with its abstract: (id, pos, pmid, status, abstract).
    A row with an empty list keeps one row, status 'no_pmid'."""
    ex = rows.select(id_col, F.posexplode(list_col).alias("pos", "pmid"))
    j = ex.join(abstracts.select("pmid", F.col("text").alias("abstract")), "pmid", "left")
    status = F.when(F.col("abstract").isNull(), F.lit("missing")).otherwise(F.lit("ok"))
    found = j.select(id_col, F.col("pos").cast("bigint").alias("pos"), "pmid", status.alias("status"), "abstract")
    # Rows without a PMID are added, not joined on a NULL key.
    none = rows.filter(F.coalesce(F.size(list_col), F.lit(0)) < 1).select(
        id_col, F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast(found.schema["pmid"].dataType).alias("pmid"),
        F.lit("no_pmid").alias("status"), F.lit(None).cast("string").alias("abstract"))
    return found.unionByName(none)


def top_pmids_per_gene(gene_pmids: DataFrame, k: int = 100) -> DataFrame:
    """At most ``k`` papers per gene, newest (highest PMID) first:
    (gene_id, rank, pmid).  Catalyst inserts a partial per-task limit before
    the shuffle, so a gene with millions of papers sends only k rows per task."""
    w = Window.partitionBy("gene_id").orderBy(F.col("pmid").desc())
    return (gene_pmids.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                      .select("gene_id", F.col("rank").cast("bigint").alias("rank"), "pmid"))


def gene_abstracts_topk(gene_pmids: DataFrame, abstracts: DataFrame, k: int = 100) -> DataFrame:
    """Top-k ids first, then fetch only those abstracts: (gene_id, rank, pmid, text)."""
    top = top_pmids_per_gene(gene_pmids, k)
    return top.join(abstracts.select("pmid", "text"), "pmid").select("gene_id", "rank", "pmid", "text")


def gene_abstracts_text(gene_pmids: DataFrame, abstracts: DataFrame, k: int = 100) -> DataFrame:
    """One text per gene: its top-k abstracts in rank order, blank-line separated.
    The group is bounded by k."""
    t = gene_abstracts_topk(gene_pmids, abstracts, k)
    return t.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("n_abstracts"),
        F.expr(f"listagg(text, '{ABSTRACT_SEP.encode('unicode_escape').decode()}') WITHIN GROUP (ORDER BY rank)").alias("abstracts"))


def pairs_inputs(annotations: DataFrame, abstracts: DataFrame, genes: DataFrame, tax_id: int = 9606,
                 gene_id: int | None = None) -> DataFrame:
    """Ground-truth rows with their abstracts and gene name.

    Species, non-empty PMID list and non-empty text filters reach the scan;
    each row's ids alone are exploded, joined with abstracts (shuffle on pmid)
    and regrouped per row in list order (the group is the row's own PMID
    list); the annotation text is joined back once.  Rows without any abstract or without a gene name are dropped.
    Output: row_ord, gene_id, gene_name, ground_truth, abstracts.
    """
    a = filter_has_text(filter_has_pmids(filter_species(annotations, tax_id)))
    if gene_id is not None:
        a = a.filter(F.col("gene_id") == F.lit(gene_id))
    names = genes.select("gene_id", F.col("symbol").alias("gene_name")).filter(F.col("gene_name").isNotNull())
    ex = a.select("row_ord", F.posexplode("pmids").alias("pos", "pmid"))
    j = ex.join(abstracts.select("pmid", F.col("text").alias("abstract")), "pmid")
    g = j.groupBy("row_ord").agg(F.expr("listagg(abstract, '\\n\\n') WITHIN GROUP (ORDER BY pos)").alias("abstracts"))
    rows = a.select("row_ord", "gene_id", F.col("text").alias("ground_truth")).join(names, "gene_id")
    return rows.join(g, "row_ord").select("row_ord", "gene_id", "gene_name", "ground_truth", "abstracts")


PAIR = "array<struct<E3_ligase:string,substrate:string>>"


def parse_pairs(answers: DataFrame, answer_col: str, id_col: str = "answer_id") -> DataFrame:
    """Task answers -> one row per pair: (id, enzyme, substrate, status).

    Code fences are dropped; a lone object counts as an array of one.  An answer
    that is not JSON keeps one row with status 'bad_json', one without a pair
    'no_pair'."""
    parsed = answers.select(id_col, F.from_json(strip_fences(answer_col), PAIR, {"mode": "PERMISSIVE"}).alias("pairs"))
    ok = F.col("pairs").isNotNull()
    found = parsed.select(id_col, F.when(ok, F.when(F.size("pairs") > 0, F.lit("ok")).otherwise(F.lit("no_pair"))).otherwise(F.lit("bad_json")).alias("status"), F.explode_outer("pairs").alias("p"))
    bad = (F.col("status") == "ok") & F.col("p.E3_ligase").isNull() & F.col("p.substrate").isNull()
    return found.select(id_col, F.col("p.E3_ligase").alias("enzyme"), F.col("p.substrate").alias("substrate"), F.when(bad, F.lit("bad_json")).otherwise(F.col("status")).alias("status"))


def article_texts(article_rows: DataFrame, extract) -> DataFrame:
    """Adds ``article`` = extracted text of ``body`` (lenient or strict)."""
    return article_rows.withColumn("article", F.array_join(extract(F.col("body")), ARTICLE_SEP))
