"""Command line: the reference's options as Spark jobs over table paths.

    python -m annolens --annotations rifs.tsv.gz --cache rifs.parquet \\
        --genes genes.parquet --gene-sets sets.json -s HALLMARK_HYPOXIA -p "response to hypoxia"

Tables (Parquet unless noted):
  --annotations   published TSV (gzip or plain) or an ingested Parquet table
  --cache         Parquet location for the TSV ingest (read-through)
  --genes         gene_id, tax_id, symbol
  --aliases       symbol, gene_id, is_official (default: official symbols of --genes)
  --gene-sets     gene-set collection JSON
  --abstracts     pmid, text;  --gene-pmids gene_id, pmid
  --article-links pmid, pmcid, link_ord;  --articles pmcid, body
Model: --backend lead[:k] (offline, deterministic) or module:function, a
callable list[str] -> list[str] run in Arrow batches; --llm picks the
context budget.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.prompts import TASKS
from .operators import lookup, resolve
from .operators.chunking import TOKENS_PER_WORD, budget_for_model
from .operators.infer import CallableBackend, LeadBackend
from .plans import jobs as J
from .session import build_session
from .sources import annotations as A
from .sources import genesets as G
from .sources import sinks as K
from .sources.index_store import read_index_store

# Model names the reference accepts; the first is its default.
MODELS = ("gpt-4-1106-preview", "gpt-3.5-turbo-1106")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="annolens", description=__doc__.split("\n\n")[0])
    p.add_argument("-g", "--gene", help="texts of one gene (symbol or numeric ID)")
    p.add_argument("-s", "--geneset", help="texts of a gene set")
    p.add_argument("-f", "--geneset-file", help="texts of the genes listed in a file, one per line")
    p.add_argument("-p", "--process", help="narrative of the given biological process for the genes")
    p.add_argument("-d", "--create-dry-run", help="write the gene summaries to this path instead of a narrative")
    p.add_argument("-r", "--load-dry-run", help="read gene summaries from this path instead of summarising")
    p.add_argument("-a", "--abstracts-too", dest="add_abstracts", action="store_true",
                   help="add one annotation written from each gene's abstracts")
    p.add_argument("--llm", choices=MODELS, default=MODELS[0], help="model name (decides the context budget)")
    p.add_argument("-m", "--article", help="summarise the article of this PMID")
    p.add_argument("-t", "--tasks", choices=sorted(TASKS), help="run a task over the article (-m)")
    p.add_argument("-y", "--synthetic-generifs", help="write paired ground-truth/synthetic rows as TSV here")
    p.add_argument("-i", "--build-index", help="write the embedding index here")
    p.add_argument("--update-index", help="assign new and changed entries in the keyed index store here")
    p.add_argument("--annotations", required=True)
    p.add_argument("--cache")
    p.add_argument("--genes")
    p.add_argument("--aliases")
    p.add_argument("--gene-sets")
    p.add_argument("--abstracts")
    p.add_argument("--gene-pmids")
    p.add_argument("--article-links")
    p.add_argument("--articles")
    p.add_argument("--species", type=int, default=9606)
    p.add_argument("--backend", default="lead:2")
    p.add_argument("--chunk-backend", help="backend for chunk summaries during distill (default: --backend)")
    p.add_argument("--responses", help="responses table for resumable model calls")
    p.add_argument("--out", help="write the result as Parquet here instead of printing it")
    p.add_argument("--master", default=os.environ.get("ANNOLENS_MASTER"), help="default: what spark-submit says")
    p.add_argument("--tokens-per-word", type=float, default=TOKENS_PER_WORD,
                   help="model tokens per word: budgets are of model tokens, texts are counted in words")
    p.add_argument("--parallelism", type=int, help="concurrent tasks of the model stage")
    return p


def make_backend(spec: str):
    if spec.startswith("lead"):
        k = int(spec.split(":", 1)[1]) if ":" in spec else 2
        return LeadBackend(k)
    mod, fn = spec.split(":", 1)
    return CallableBackend(spec, getattr(importlib.import_module(mod), fn))


def _read(spark: SparkSession, path: str | None, what: str) -> DataFrame:
    if not path:
        raise SystemExit(f"--{what} is needed for this command")
    return spark.read.parquet(path)


class Tables:
    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        self.spark, self.a = spark, a

    def annotations(self) -> DataFrame:
        p = self.a.annotations
        if p.endswith((".gz", ".tsv", ".txt")):
            if self.a.cache:
                return A.load_annotations(self.spark, p, self.a.cache)
            return A.read_annotation_tsv(self.spark, p)
        return A.read_annotations(self.spark, p)

    def genes(self) -> DataFrame:
        return _read(self.spark, self.a.genes, "genes")

    def aliases(self) -> DataFrame:
        if self.a.aliases:
            return self.spark.read.parquet(self.a.aliases)
        return self.genes().select("symbol", "gene_id", F.lit(True).alias("is_official"))

    def tokens(self) -> DataFrame | None:
        a = self.a
        if a.geneset:
            if not a.gene_sets:
                raise SystemExit("--gene-sets is needed for -s")
            return G.gene_set_members(self.spark, a.gene_sets, a.geneset).select(
                F.col("pos").cast("bigint").alias("pos"), F.col("symbol").alias("token"))
        if a.gene:
            return self.spark.createDataFrame([(0, a.gene)], "pos bigint, token string")
        if a.geneset_file:
            return G.read_gene_list(self.spark, a.geneset_file)
        return None


    def added(self, backend, mx: int, ck: int) -> DataFrame | None:
        """With -a: for each gene asked for, one text written from its abstracts."""
        a = self.a
        if not a.add_abstracts:
            return None
        ids = resolve.resolve_tokens(self.tokens().select("token").distinct(), "token", self.aliases(), "gene_id").filter("gene_id is not null")
        syn = J.create_annotations(ids, self.genes(), _read(self.spark, a.gene_pmids, "gene-pmids"), _read(self.spark, a.abstracts, "abstracts"),
                                   backend, a.process or "its biological process", mx, ck, responses_path=a.responses, parallelism=a.parallelism)
        # Model output: materialised once for the texts and for what failed.
        return syn.checkpoint(eager=True)

    def texts(self, members: DataFrame, by, backend, mx: int, ck: int) -> DataFrame:
        """Texts of the members; with -a a status and error for each gene whose added text failed."""
        syn = self.added(backend, mx, ck)
        if syn is None:
            return by(members, self.annotations(), self.aliases(), self.a.species)
        more = syn.select("gene_id", F.col("synthetic").alias("text"))
        return J.with_failures(by(members, self.annotations(), self.aliases(), self.a.species, more), J.failed_additions(syn))


def emit(df: DataFrame, out: str | None) -> DataFrame:
    if out:
        df.write.mode("overwrite").parquet(out)
    else:
        print("\t".join(df.columns))
        for row in df.toLocalIterator():  # every row, a partition at a time
            print("\t".join("" if v is None else str(v) for v in row))
    return df


def run(a: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    t = Tables(spark, a)
    backend = make_backend(a.backend)
    chunk_backend = make_backend(a.chunk_backend) if a.chunk_backend else None
    mx, ck = budget_for_model(a.llm, a.tokens_per_word)
    sp = a.species

    if a.process:
        if a.load_dry_run:
            loaded = K.read_summaries(spark, a.load_dry_run)
            per = loaded.select("pos", "gene", "summary", *(c for c in ("status", "error") if c in loaded.columns))
            return emit(J.process_narrative(per.withColumn("_list", F.lit("genes")), ["_list"], backend,
                                            a.process, mx, ck, a.responses, chunk_backend=chunk_backend,
                                            parallelism=a.parallelism).drop("_list"), a.out)
        toks = t.tokens()
        if toks is None:
            raise SystemExit("-p needs -s, -g or -f")
        need_abs = a.add_abstracts
        res = J.genes_to_process(
            toks, t.annotations(), t.aliases(), t.genes(),
            _read(spark, a.gene_pmids, "gene-pmids") if need_abs else None,
            _read(spark, a.abstracts, "abstracts") if need_abs else None,
            backend, a.process, mx, ck, add_abstracts=need_abs, just_summaries=bool(a.create_dry_run),
            tax_id=sp, responses_path=a.responses, chunk_backend=chunk_backend, parallelism=a.parallelism)
        if a.create_dry_run:
            K.write_summaries(res.withColumn("gene", F.coalesce("gene_name", "token")), a.create_dry_run)
            return res
        return emit(res, a.out)

    if a.synthetic_generifs:
        gid = resolve.resolve_token_value(t.aliases(), a.gene) if a.gene else None
        rows = t.annotations()
        if a.gene and gid is None:  # an unknown gene has no pairs
            rows = rows.filter(F.lit(False))
        pairs = J.synthetic_pairs(rows, _read(spark, a.abstracts, "abstracts"), t.genes(), backend,
                                  "its biological process", mx, ck, sp, gid, a.responses,
                                  chunk_backend=chunk_backend, parallelism=a.parallelism)
        K.write_pairs_tsv(pairs, a.synthetic_generifs)
        return pairs

    result = None
    if a.gene:
        gid = resolve.resolve_token_value(t.aliases(), a.gene)
        result = emit(lookup.texts_for_gene(t.annotations(), gid, sp) if gid is not None else
                      spark.createDataFrame([], "gene_id bigint, idx bigint, row_ord bigint, text string"), a.out)
    if a.geneset_file:
        result = emit(t.texts(t.tokens(), lookup.texts_by_gene_list, backend, mx, ck), a.out)
    if a.geneset and not a.gene:
        members = G.gene_set_members(spark, a.gene_sets, a.geneset)
        members = members.withColumn("pos", F.col("pos").cast("bigint"))
        result = emit(t.texts(members, lookup.texts_by_gene_set, backend, mx, ck), a.out)
    if a.article:
        pm = spark.createDataFrame([(int(a.article),)], "pmid bigint")
        result = emit(J.summarize_articles(pm, _read(spark, a.article_links, "article-links"),
                                           _read(spark, a.articles, "articles"), backend, mx, ck, task=a.tasks,
                                           responses_path=a.responses, chunk_backend=chunk_backend,
                                           parallelism=a.parallelism), a.out)
    if a.build_index:
        idx = J.build_index(t.annotations(), t.genes(), tax_id=sp)
        K.write_index(idx, a.build_index)
        result = idx
    if a.update_index:
        n = J.update_index(t.annotations(), t.genes(), a.update_index, tax_id=sp)
        print(f"{n} entries embedded")
        result = read_index_store(spark, a.update_index)
    return result


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    a = parser().parse_args(argv)
    spark = spark or build_session(a.master)
    return run(a, spark)


if __name__ == "__main__":  # pragma: no cover
    main(sys.argv[1:])
