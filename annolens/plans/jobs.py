"""Composite jobs (O45-O50, O52): the reference's entry points as DataFrame jobs.

All jobs take the model ``backend`` explicitly and run over whole tables;
nothing is looped per gene or per row on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as PR
from ..functions.text import ARTICLE_SEP, article_segments, ensure_terminal_punct, first_sentence, strip_fences
from ..operators.distill import distill, distill_rows
from ..operators.embed import HashEmbedder, embed
from ..operators.infer import Backend, infer
from ..operators.literature import article_lookup, gene_abstracts_text, pairs_inputs
from ..operators.lookup import LAST_ORD, distinct_members, filter_has_text, filter_species
from ..operators.resolve import resolve_ids, resolve_tokens
from ..operators.scan import ordinal
from ..sources.index_store import upsert_index

# Fixed values of the embedding index: key = <gene name> + INDEX_KEY_INFIX + <n>,
# and the type tag of rows built from existing annotations.
INDEX_KEY_INFIX = "-gt-"
INDEX_TYPE = "ground_truth"

# What a gene's summary can be without anything having failed.
SOUND = ("ok", "no_text", "unresolved")


def failed_additions(synthetic: DataFrame) -> DataFrame:
    """(gene_id, added_error) of the genes whose text from abstracts failed (``create_annotations``)."""
    bad = synthetic.filter(~F.col("status").isin("ok", "no_abstracts"))
    return bad.select("gene_id", F.concat(F.lit("abstracts: "), F.coalesce("error", "status")).alias("added_error"))


def with_failures(df: DataFrame, failed: DataFrame) -> DataFrame:
    """Adds status and error to rows of genes (gene_id): 'error' where the added text failed."""
    out = df.join(failed, "gene_id", "left")
    return out.select(*df.columns, F.when(F.col("added_error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                      F.col("added_error").alias("error"))


def _ready():
    return F.col("_distilled") == "ok"


def _after_distill(d: DataFrame) -> DataFrame:
    """Keep the outcome of distill beside that of the model call that follows."""
    d = d.withColumnRenamed("status", "_distilled").withColumnRenamed("error", "_distill_error")
    return d.withColumnRenamed("_found", "status") if "_found" in d.columns else d


def _status(out: str):
    """Status of a job's row: that of distill if it failed, else that of the model call."""
    return F.when(F.col("_distilled") != "ok", F.col("_distilled")).otherwise(F.col(f"{out}_status"))


def _error(out: str):
    return F.coalesce(F.col("_distill_error"), F.col(f"{out}_error")).alias("error")


def summarize_articles(pmids: DataFrame, links: DataFrame, articles: DataFrame, backend: Backend,
                       max_tokens: int, chunk_tokens: int, task: str | None = None,
                       extract=article_segments, responses_path: str | None = None,
                       tokenizer=None, chunk_backend: Backend | None = None,
                       parallelism: int | None = None) -> DataFrame:
    """PMID -> article -> text -> distill -> summary (or task answer with
    code fences removed).  Output: pmid, status, summary (NULL unless ok), error.

    status: ok / no_link / missing, or the model's when a call failed."""
    a = article_lookup(pmids, links, articles)
    ok = F.col("status") == "ok"
    a = a.select("pmid", F.col("status").alias("_found"), F.when(ok, F.array_join(extract(F.col("body")), ARTICLE_SEP)).alias("article"))
    d = distill_rows(a, ["pmid"], "article", chunk_backend or backend, max_tokens, chunk_tokens,
                     responses_path=responses_path, tokenizer=tokenizer, parallelism=parallelism)
    d = _after_distill(d)
    instr = PR.task_instruction(task) if task else None
    p = d.withColumn("_prompt", F.when(ok & _ready(), PR.article_prompt(F.col("distilled"), instr)))
    s = infer(p, "_prompt", backend, "summary", responses_path, parallelism)
    if task:
        s = s.withColumn("summary", strip_fences("summary"))
    return s.select("pmid", F.when(ok, _status("summary")).otherwise(F.col("status")).alias("status"), "summary", _error("summary"))


def create_annotations(gene_ids: DataFrame, genes: DataFrame, gene_pmids: DataFrame, abstracts: DataFrame,
                       backend: Backend, process: str, max_tokens: int, chunk_tokens: int, k: int = 100,
                       responses_path: str | None = None,
                       tokenizer=None, chunk_backend: Backend | None = None,
                       parallelism: int | None = None) -> DataFrame:
    """Per gene, its top-k abstracts -> distill -> one-sentence
    annotation.  Output: gene_id, gene_name, synthetic, status, error.

    Every gene asked for has a row; status: ok / no_abstracts, or the model's
    when a call failed."""
    ids = gene_ids.select("gene_id").distinct()
    abs_ = gene_abstracts_text(gene_pmids.join(ids, "gene_id", "left_semi"), abstracts, k).select("gene_id", "abstracts")
    d = distill_rows(abs_, ["gene_id"], "abstracts", chunk_backend or backend, max_tokens, chunk_tokens,
                     responses_path=responses_path, tokenizer=tokenizer, parallelism=parallelism)
    named = resolve_ids(_after_distill(d), "gene_id", genes, "gene_name")
    p = named.withColumn("_prompt", F.when(_ready(), PR.annotation_prompt(
        F.coalesce(F.col("gene_name"), F.col("gene_id").cast("string")), F.lit(process), F.col("distilled"))))
    s = infer(p, "_prompt", backend, "_answer", responses_path, parallelism)
    done = s.select("gene_id", first_sentence("_answer").alias("synthetic"), _status("_answer").alias("status"), _error("_answer"))
    out = resolve_ids(ids.join(done, "gene_id", "left"), "gene_id", genes, "gene_name")
    return out.select("gene_id", "gene_name", "synthetic", F.coalesce("status", F.lit("no_abstracts")).alias("status"), "error")


def synthetic_pairs(annotations: DataFrame, abstracts: DataFrame, genes: DataFrame, backend: Backend,
                    process: str, max_tokens: int, chunk_tokens: int, tax_id: int = 9606,
                    gene_id: int | None = None, responses_path: str | None = None,
                    tokenizer=None, chunk_backend: Backend | None = None,
                       parallelism: int | None = None) -> DataFrame:
    """Ground-truth annotation paired with a synthetic one written from
    the abstracts it cites.  Output: row_ord, gene_id, gene_name, ground_truth,
    synthetic, status, error."""
    pin = pairs_inputs(annotations, abstracts, genes, tax_id, gene_id)
    j = distill_rows(pin, ["row_ord"], "abstracts", chunk_backend or backend, max_tokens, chunk_tokens,
                     responses_path=responses_path, tokenizer=tokenizer, parallelism=parallelism)
    p = _after_distill(j).withColumn("_prompt", F.when(_ready(), PR.annotation_prompt(F.col("gene_name"), F.lit(process), F.col("distilled"))))
    s = infer(p, "_prompt", backend, "_answer", responses_path, parallelism)
    return s.select("row_ord", "gene_id", "gene_name", "ground_truth", first_sentence("_answer").alias("synthetic"),
                    _status("_answer").alias("status"), _error("_answer"))


def gene_texts(annotations: DataFrame, gene_ids: DataFrame, tax_id: int = 9606) -> DataFrame:
    """(gene_id, row_ord, text) of the given genes, non-empty, punctuation ensured."""
    a = filter_has_text(filter_species(annotations, tax_id)).select("gene_id", "row_ord", "text")
    return a.join(gene_ids.select("gene_id").distinct(), "gene_id", "left_semi").select("gene_id", "row_ord", ensure_terminal_punct("text").alias("text"))


def summarize_genes(members: DataFrame, annotations: DataFrame, aliases: DataFrame, genes: DataFrame,
                    backend: Backend, process: str, max_tokens: int, chunk_tokens: int,
                    extra_texts: DataFrame | None = None, tax_id: int = 9606,
                    responses_path: str | None = None,
                    tokenizer=None, chunk_backend: Backend | None = None,
                       parallelism: int | None = None) -> DataFrame:
    """One summary per distinct gene of ``members`` (column ``token``).

    Texts of a gene (file order, punctuation ensured, joined with a space)
    -> distill -> summary prompt -> model.  ``extra_texts`` (gene_id, text)
    are appended after the gene's own texts.  Output per member token:
    token, gene_id, gene_name, n_texts, summary, status
    (ok / no_text / unresolved / the model's status).
    """
    m = resolve_tokens(members.select("token").distinct(), "token", aliases, "gene_id")
    ids = m.filter(F.col("gene_id").isNotNull()).select("gene_id").distinct()
    texts = gene_texts(annotations, ids, tax_id)
    if extra_texts is not None:
        extra = extra_texts.filter(F.col("text").isNotNull() & (F.length("text") > 0)).select(
            "gene_id", F.lit(LAST_ORD).alias("row_ord"), ensure_terminal_punct("text").alias("text"))
        texts = texts.unionByName(extra)
    d = distill(texts, ["gene_id"], "row_ord", "text", chunk_backend or backend, max_tokens, chunk_tokens,
                responses_path=responses_path, tokenizer=tokenizer, parallelism=parallelism)
    named = resolve_ids(_after_distill(d), "gene_id", genes, "gene_name")
    p = named.withColumn("_prompt", F.when(_ready(), PR.gene_summary_prompt(
        F.coalesce(F.col("gene_name"), F.col("gene_id").cast("string")), F.lit(process), F.col("distilled"))))
    s = infer(p, "_prompt", backend, "summary", responses_path, parallelism)
    s = s.select("gene_id", "gene_name", "n_texts", "summary", _status("summary").alias("summary_status"), _error("summary"))
    # Unresolved tokens are added, not joined on a NULL key.
    out = m.filter("gene_id is not null").join(s, "gene_id", "left")
    lost = m.filter("gene_id is null")
    for c in ("gene_name", "n_texts", "summary", "summary_status", "error"):
        lost = lost.withColumn(c, F.lit(None).cast(out.schema[c].dataType))
    out = out.unionByName(lost)
    status = (F.when(F.col("gene_id").isNull(), F.lit("unresolved"))
               .when(F.col("summary_status").isNull(), F.lit("no_text")).otherwise(F.col("summary_status")))
    return out.select("token", "gene_id", "gene_name", F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_texts"),
                      "summary", status.alias("status"), "error")


def process_narrative(summaries: DataFrame, group_cols: list[str], backend: Backend, process: str,
                      max_tokens: int | None = None, chunk_tokens: int | None = None,
                      responses_path: str | None = None,
                      tokenizer=None, chunk_backend: Backend | None = None,
                      parallelism: int | None = None, tokens_per_word: float = 1.0) -> DataFrame:
    """One narrative per group from its genes' summaries.

    ``summaries`` has group_cols, pos, gene, summary.  Lines "Gene g: summary"
    in member order are newline-joined through ``distill`` (identical to a
    plain join when the group fits the budget; a huge set is summarised in
    bounded chunks first) -> process prompt -> model.  Members without a
    summary are left out; a gene given twice counts once.  Output: group_cols,
    n_genes, narrative, status, error.

    If ``summaries`` has their ``status`` (and ``error``), members whose summary
    failed show: the narrative of the others is ``partial``, a group without
    any is ``error``, and the error counts them and tells the first reason.
    """
    from ..operators.chunking import budget_for_model
    if max_tokens is None or chunk_tokens is None:
        max_tokens, chunk_tokens = budget_for_model("", tokens_per_word)
    once = summaries.filter(F.col("summary").isNotNull()).groupBy(*group_cols, "gene", "summary").agg(F.min("pos").alias("pos"))
    lines = once.select(
        *group_cols, F.col("pos").cast("bigint").alias("pos"), PR.gene_line(F.col("gene"), F.col("summary")).alias("_line"))
    d = distill(lines, group_cols, "pos", "_line", chunk_backend or backend, max_tokens, chunk_tokens, sep="\n",
                responses_path=responses_path, tokenizer=tokenizer, parallelism=parallelism)
    p = _after_distill(d).withColumnRenamed("n_texts", "n_genes").withColumn(
        "_prompt", F.when(_ready(), PR.process_prompt(F.lit(process), F.col("distilled"))))
    s = infer(p, "_prompt", backend, "narrative", responses_path, parallelism)
    s = s.select(*group_cols, "n_genes", "narrative", _status("narrative").alias("status"), _error("narrative"))
    if "status" not in summaries.columns:
        return s
    why = F.col("error") if "error" in summaries.columns else F.lit(None).cast("string")
    lost = summaries.filter(~F.coalesce("status", F.lit("ok")).isin(*SOUND)).groupBy(*group_cols).agg(
        F.count_distinct("gene").alias("_lost"), F.min(F.coalesce(why, F.col("status"))).alias("_why"))
    told = F.concat(F.col("_lost").cast("string"), F.lit(" genes failed: "), F.col("_why"))
    j = s.withColumn("_told", F.lit(True)).join(lost, group_cols, "full")
    status = (F.when(F.col("_told").isNull(), F.lit("error"))
               .when(F.col("_lost").isNotNull() & (F.col("status") == "ok"), F.lit("partial")).otherwise(F.col("status")))
    return j.select(*group_cols, F.coalesce("n_genes", F.lit(0).cast("bigint")).alias("n_genes"), "narrative",
                    status.alias("status"), F.coalesce("error", told).alias("error"))


def genes_to_process(members: DataFrame, annotations: DataFrame, aliases: DataFrame, genes: DataFrame,
                     gene_pmids: DataFrame, abstracts: DataFrame, backend: Backend, process: str,
                     max_tokens: int, chunk_tokens: int, add_abstracts: bool = False,
                     just_summaries: bool = False, k: int = 100, tax_id: int = 9606,
                     responses_path: str | None = None,
                     tokenizer=None, chunk_backend: Backend | None = None,
                       parallelism: int | None = None) -> DataFrame:
    """Gene list (pos, token) -> per-gene summaries [-> narrative].

    With ``add_abstracts`` each gene also gets one synthetic annotation
    written from its top-k abstracts (O48), added as its last text.  If that
    fails the gene's status says so, and that of the narrative.
    """
    extra, failed = None, None
    if add_abstracts:
        ids = resolve_tokens(members.select("token").distinct(), "token", aliases, "gene_id") \
            .filter(F.col("gene_id").isNotNull())
        syn = create_annotations(ids, genes, gene_pmids, abstracts, backend, process, max_tokens, chunk_tokens,
                                 k, responses_path, tokenizer, chunk_backend, parallelism)
        # Model output: materialised once, never re-evaluated.
        syn = syn.select("gene_id", F.col("synthetic").alias("text"), "status", "error").checkpoint(eager=True)
        extra, failed = syn.select("gene_id", "text"), failed_additions(syn)
    s = summarize_genes(members, annotations, aliases, genes, backend, process, max_tokens, chunk_tokens,
                        extra, tax_id, responses_path, tokenizer, chunk_backend, parallelism)
    if failed is not None:
        # A gene whose own texts were summarised without the added one is 'partial'; with no text at all it is 'error'.
        f = s.join(failed, "gene_id", "left")
        worse = F.when(F.col("status") == "ok", F.lit("partial")).when(F.col("status") == "no_text", F.lit("error")).otherwise(F.col("status"))
        s = f.select(*(c for c in s.columns if c not in ("status", "error")),
                     F.when(F.col("added_error").isNotNull(), worse).otherwise(F.col("status")).alias("status"),
                     F.coalesce("error", "added_error").alias("error"))
    # One entry per distinct token, at its first position in the list.
    s = s.join(distinct_members(members, [], "token"), "token")
    if just_summaries:
        return s.select("pos", *(c for c in s.columns if c != "pos"))
    per_member = s.select("pos", "token", F.coalesce("gene_name", "token").alias("gene"), "summary", "status", "error")
    return process_narrative(per_member.withColumn("_list", F.lit("genes")), ["_list"], backend, process,
                             max_tokens, chunk_tokens, responses_path, tokenizer, chunk_backend, parallelism).drop("_list")


def index_entries(annotations: DataFrame, genes: DataFrame, tax_id: int = 9606) -> DataFrame:
    """O52 without the vectors: every annotation text of the species with its gene and
    1-based position inside the gene (file order).

    key = '<gene name>-gt-<n>' (the gene ID stands in for a missing name);
    the identity of a row is (gene_id, idx)."""
    a = filter_species(annotations, tax_id).select("gene_id", "row_ord", "text")
    a = ordinal(a, ["gene_id"], "row_ord", "idx")
    a = resolve_ids(a, "gene_id", genes, "gene_name")
    a = a.withColumn("key", F.concat(F.coalesce(F.col("gene_name"), F.col("gene_id").cast("string")),
                                     F.lit(INDEX_KEY_INFIX), F.col("idx").cast("string")))
    return a.select("key", "gene_id", "gene_name", "idx", F.lit(INDEX_TYPE).alias("type"), "text")


def build_index(annotations: DataFrame, genes: DataFrame, embedder=None, tax_id: int = 9606) -> DataFrame:
    """The entries with their vectors, clustered by gene.

    The embedder runs after the rows have been dealt out and sorted, so each
    text is embedded once.
    """
    a = index_entries(annotations, genes, tax_id).repartitionByRange("gene_id", "idx").sortWithinPartitions("gene_id", "idx")
    return embed(a, "text", embedder or HashEmbedder(384))


def update_index(annotations: DataFrame, genes: DataFrame, path: str, embedder=None, tax_id: int = 9606) -> int:
    """O52 into the keyed store at ``path``: only new and changed entries are embedded.  Returns their number."""
    return upsert_index(index_entries(annotations, genes, tax_id), path, embedder or HashEmbedder(384))


def embed_gene(token: str, annotations: DataFrame, aliases: DataFrame, embedder=None, tax_id: int = 9606) -> DataFrame:
    """The vectors of one gene's texts, by symbol or ID: (gene_id, idx, text, embedding).

    A gene without texts, or an unknown one, has no rows."""
    embedder = embedder or HashEmbedder(384)
    gene = resolve_tokens(annotations.sparkSession.createDataFrame([(str(token),)], "token string"), "token", aliases, "gene_id")
    a = filter_has_text(filter_species(annotations, tax_id)).select("gene_id", "row_ord", "text")
    a = a.join(gene.select("gene_id"), "gene_id", "left_semi")
    return embed(ordinal(a, ["gene_id"], "row_ord", "idx"), "text", embedder).select("gene_id", "idx", "text", "embedding")
