"""Query catalogue: one entry per operator row of the survey inventory.

Each entry takes (spark, sf_dir) and returns a DataFrame over the whole
stand-in tables.  ``plans.oracle.ORACLE`` holds the matching DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import literature as LIT
from ..operators import lookup, resolve
from ..operators.scan import ordinal
from ..sources import genesets, standin as S
from . import params as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def gene_sets(spark, d) -> DataFrame:
    return genesets.parse_gene_sets(S.gene_set_json_lines(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


def gene_list(spark, d) -> DataFrame:
    return genesets.clean_gene_list(S.gene_list_lines(spark, d))


def resolve_one(spark, d, token: str) -> int | None:
    """Resolve a single gene token on the driver (one dictionary row)."""
    return resolve.resolve_token_value(S.aliases(spark, d), token)


# --- M1: scans, filters, resolution, lookups ---------------------------------

@query("scan_annotations")
def q_scan_annotations(spark, d):
    return S.annotations(spark, d).select("tax_id", "gene_id", "pmid_list", "text", "row_ord")


@query("parse_pmids")
def q_parse_pmids(spark, d):
    a = S.annotations(spark, d)
    return a.select("row_ord", F.size("pmids").cast("bigint").alias("n_pmids"),
                    F.array_join("pmids", ",").alias("pmids_text"), F.get("pmids", 0).alias("first_pmid"))


@query("gene_set_members")
def q_gene_set_members(spark, d):
    return gene_sets(spark, d)


@query("gene_list_tokens")
def q_gene_list_tokens(spark, d):
    return gene_list(spark, d)


@query("filter_species")
def q_filter_species(spark, d):
    return lookup.filter_species(S.annotations(spark, d), P.HUMAN).select("tax_id", "gene_id", "row_ord", "text")


@query("filter_has_pmids")
def q_filter_has_pmids(spark, d):
    return lookup.filter_has_pmids(S.annotations(spark, d)).select(
        "gene_id", "row_ord", F.size("pmids").cast("bigint").alias("n_pmids"))


@query("filter_has_text")
def q_filter_has_text(spark, d):
    return lookup.filter_has_text(S.annotations(spark, d)).select("gene_id", "row_ord")


@query("resolve_symbols")
def q_resolve_symbols(spark, d):
    return resolve.resolve_symbols(gene_list(spark, d), "token", S.aliases(spark, d)).select("pos", "token", "gene_id")


@query("resolve_tokens")
def q_resolve_tokens(spark, d):
    return resolve.resolve_tokens(gene_list(spark, d), "token", S.aliases(spark, d)).select("pos", "token", "gene_id")


@query("resolve_ids")
def q_resolve_ids(spark, d):
    a = S.annotations(spark, d).select("row_ord", "gene_id")
    return resolve.resolve_ids(a, "gene_id", S.genes(spark, d))


@query("texts_for_gene")
def q_texts_for_gene(spark, d):
    gid = resolve_one(spark, d, P.GENE)
    return lookup.texts_for_gene(S.annotations(spark, d), gid, P.HUMAN).select("gene_id", "idx", "row_ord", "text")


@query("texts_by_gene_set")
def q_texts_by_gene_set(spark, d):
    return lookup.texts_by_gene_set(gene_sets(spark, d), S.annotations(spark, d), S.aliases(spark, d), P.HUMAN)


@query("texts_by_gene_list")
def q_texts_by_gene_list(spark, d):
    return lookup.texts_by_gene_list(gene_list(spark, d), S.annotations(spark, d), S.aliases(spark, d), P.HUMAN)


def added_texts(spark, d):
    """The abstracts of each gene as one more text."""
    g = LIT.gene_abstracts_text(S.gene_pmids(spark, d), S.abstracts(spark, d), P.TOP_K_ABSTRACTS)
    return g.select("gene_id", F.col("abstracts").alias("text"))


@query("texts_by_gene_set_abstracts")
def q_texts_by_gene_set_abstracts(spark, d):
    return lookup.texts_by_gene_set(gene_sets(spark, d), S.annotations(spark, d), S.aliases(spark, d), P.HUMAN, added_texts(spark, d))


@query("texts_by_gene_list_abstracts")
def q_texts_by_gene_list_abstracts(spark, d):
    return lookup.texts_by_gene_list(gene_list(spark, d), S.annotations(spark, d), S.aliases(spark, d), P.HUMAN, added_texts(spark, d))


@query("distinct_genes")
def q_distinct_genes(spark, d):
    return lookup.distinct_genes(S.annotations(spark, d), P.HUMAN)


# --- M2: text functions ---------------------------------------------------------

from ..functions import prompts as PR  # noqa: E402
from ..functions import text as TX  # noqa: E402


@query("strip_fences")
def q_strip_fences(spark, d):
    return S.model_answers(spark, d).select("answer_id", TX.strip_fences("text").alias("cleaned"))


@query("ensure_punct")
def q_ensure_punct(spark, d):
    return S.annotations(spark, d).select("row_ord", TX.ensure_terminal_punct("text").alias("text_p"))


@query("first_sentence")
def q_first_sentence(spark, d):
    return S.model_answers(spark, d).select("answer_id", TX.first_sentence("raw").alias("sentence"))


@query("token_count")
def q_token_count(spark, d):
    return S.table(spark, d, "documents").select("doc_id", TX.token_count("text").alias("n_tokens"))


@query("article_segments")
def q_article_segments(spark, d):
    seg = S.articles(spark, d).select("pmcid", TX.article_segments("body").alias("seg"))
    return seg.select("pmcid", F.size("seg").cast("bigint").alias("n_segments"),
                      F.array_join("seg", TX.ARTICLE_SEP).alias("article"))


@query("article_tree")
def q_article_tree(spark, d):
    """O36, strict: segments by nesting and namespaces, parse errors with a status."""
    from ..functions.xml_tree import article_tree
    t = S.article_xml(spark, d).select("pmcid", article_tree("body").alias("t"))
    return t.select("pmcid", F.col("t.status"), F.col("t.error"), F.size("t.segments").cast("bigint").alias("n_segments"),
                    F.array_join("t.segments", TX.ARTICLE_SEP).alias("article"))


# --- M3: literature ----------------------------------------------------------------

@query("article_lookup")
def q_article_lookup(spark, d):
    pmids = S.abstracts(spark, d).select("pmid")
    return LIT.article_lookup(pmids, S.article_links(spark, d), S.articles(spark, d))


@query("abstract_by_pmid")
def q_abstract_by_pmid(spark, d):
    return LIT.abstracts_by_pmid(S.annotations(spark, d), S.abstracts(spark, d))


@query("gene_abstracts_topk")
def q_gene_abstracts_topk(spark, d):
    return LIT.gene_abstracts_topk(S.gene_pmids(spark, d), S.abstracts(spark, d), P.TOP_K_ABSTRACTS)


@query("gene_abstracts_text")
def q_gene_abstracts_text(spark, d):
    return LIT.gene_abstracts_text(S.gene_pmids(spark, d), S.abstracts(spark, d), P.TOP_K_ABSTRACTS)


@query("pairs_inputs")
def q_pairs_inputs(spark, d):
    return LIT.pairs_inputs(S.annotations(spark, d), S.abstracts(spark, d), S.genes(spark, d), P.HUMAN)


@query("prompt_article")
def q_prompt_article(spark, d):
    a = LIT.article_lookup(S.abstracts(spark, d).select("pmid"), S.article_links(spark, d), S.articles(spark, d))
    a = LIT.article_texts(a.filter(F.col("status") == "ok"), TX.article_segments)
    return a.select("pmid", PR.article_prompt(F.col("article")).alias("prompt"))


@query("prompt_task")
def q_prompt_task(spark, d):
    a = LIT.article_lookup(S.abstracts(spark, d).select("pmid"), S.article_links(spark, d), S.articles(spark, d))
    a = LIT.article_texts(a.filter(F.col("status") == "ok"), TX.article_segments)
    return a.select("pmid", F.lit(P.TASK).alias("task"),
                    PR.article_prompt(F.col("article"), PR.task_instruction(P.TASK)).alias("prompt"))


@query("prompt_chunk")
def q_prompt_chunk(spark, d):
    return S.table(spark, d, "documents").select("doc_id", PR.chunk_prompt(F.col("text")).alias("prompt"))


def _named_annotations(spark, d):
    a = resolve.resolve_ids(S.annotations(spark, d), "gene_id", S.genes(spark, d), "gene_name")
    return a.withColumn("gene", F.coalesce(F.col("gene_name"), F.col("gene_id").cast("string")))


@query("prompt_annotation")
def q_prompt_annotation(spark, d):
    a = _named_annotations(spark, d)
    return a.select("row_ord", PR.annotation_prompt(F.col("gene"), F.lit(P.PROCESS), F.col("text")).alias("prompt"))


@query("prompt_gene_summary")
def q_prompt_gene_summary(spark, d):
    a = _named_annotations(spark, d)
    return a.select("row_ord", PR.gene_summary_prompt(F.col("gene"), F.lit(P.PROCESS), F.col("text")).alias("prompt"))


@query("prompt_process")
def q_prompt_process(spark, d):
    a = _named_annotations(spark, d)
    return a.select("row_ord", PR.process_prompt(F.lit(P.PROCESS), PR.gene_line(F.col("gene"), F.col("text"))).alias("prompt"))


@query("parse_pairs")
def q_parse_pairs(spark, d):
    """Task answers to pairs; of the answers a third is an array, a third one object, the rest prose."""
    raw = S.model_answers(spark, d)
    pair = F.struct(F.substring("raw", 1, 7).alias("E3_ligase"), F.substring("raw", 8, 7).alias("substrate"))
    text = (F.when(F.col("answer_id") % 3 == 0, F.to_json(F.array(pair, pair)))
             .when(F.col("answer_id") % 3 == 1, F.to_json(pair)).otherwise(F.concat(F.lit("none: "), F.col("raw"))))
    answers = raw.select("answer_id", F.concat(F.lit("```json\n"), text, F.lit("\n```")).alias("answer"))
    return LIT.parse_pairs(answers, "answer")


# --- M4: tokens and chunking -----------------------------------------------------

from ..operators import chunking as CH  # noqa: E402

PREFIX = CH.prefix_tokens()


def gene_texts(spark, d):
    """Human, non-empty annotation texts with terminal punctuation ensured."""
    a = lookup.filter_has_text(lookup.filter_species(S.annotations(spark, d), P.HUMAN))
    return a.select("gene_id", "row_ord", TX.ensure_terminal_punct("text").alias("text"))


@query("chunk_text")
def q_chunk_text(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    return CH.chunk_rows(docs, "text", P.ROW_MAX_TOKENS, P.ROW_CHUNK_TOKENS, PREFIX).select(
        "doc_id", "chunk_idx", "n_chunks", "kind", "n_tokens", "chunk_text")


@query("distill_plan")
def q_distill_plan(spark, d):
    mx, ck = CH.budget_for_model(P.MODEL)
    return CH.budget_plan(gene_texts(spark, d), ["gene_id"], "text", mx, ck, PREFIX)


@query("distill_plan_bucketed")
def q_distill_plan_bucketed(spark, d):
    """The budget plan of every gene over a table bucketed by gene; the annotations are not shuffled."""
    from ..sources import annotations as AN
    path = scratch_path(spark, "annotations-bucketed")
    table = "annotations_" + path.rsplit("-", 1)[1]
    AN.save_bucketed(S.annotations(spark, d).select("tax_id", "gene_id", "row_ord", "text"), table, path)
    a = lookup.filter_has_text(lookup.filter_species(spark.table(table), P.HUMAN))
    mx, ck = CH.budget_for_model(P.MODEL)
    return CH.budget_plan(a.withColumn("text", TX.ensure_terminal_punct("text")), ["gene_id"], "text", mx, ck, PREFIX)


@query("chunk_gene")
def q_chunk_gene(spark, d):
    """Some of the texts begin with white space, which does not count."""
    mx, ck = P.GENE_BUDGET
    lead = F.when(F.col("row_ord") % 5 == 1, F.lit(" \n  ")).otherwise(F.lit(""))
    texts = gene_texts(spark, d).withColumn("text", F.concat(lead, F.col("text")))
    return CH.chunk_by_key(texts, ["gene_id"], "row_ord", "text", mx, ck, PREFIX)


@query("chunk_gene_subword")
def q_chunk_gene_subword(spark, d):
    """Genes cut to a budget of subword tokens of a vocabulary table."""
    from ..functions.tokenizers import SubwordTokenizer
    tk = SubwordTokenizer.from_table(S.vocabulary(spark, d))
    mx, ck = P.SUBWORD_BUDGET
    return CH.chunk_by_key(gene_texts(spark, d), ["gene_id"], "row_ord", "text", mx, ck, 0, tokenizer=tk)


# --- M5-M7: model map, distill, jobs, embeddings ----------------------------------

from ..operators import embed as EM  # noqa: E402
from ..operators.distill import distill  # noqa: E402
from ..operators.infer import LeadBackend, infer  # noqa: E402
from . import jobs as J  # noqa: E402


def backend():
    return LeadBackend(P.LEAD_SENTENCES)


def plain(df):
    """Without the outcome columns that only matter when a model call fails."""
    return df.drop("error")


def ok_articles(spark, d):
    a = LIT.article_lookup(S.abstracts(spark, d).select("pmid"), S.article_links(spark, d), S.articles(spark, d))
    return LIT.article_texts(a.filter(F.col("status") == "ok"), TX.article_segments)


@query("infer_lead")
def q_infer_lead(spark, d):
    p = ok_articles(spark, d).select("pmid", PR.article_prompt(F.col("article")).alias("prompt"))
    return infer(p, "prompt", backend(), "response").select("pmid", "response", F.col("response_status").alias("status"))


@query("summarize_freq")
def q_summarize_freq(spark, d):
    """The articles summed up by the term weights of all abstracts."""
    from ..operators.frequency import FreqBackend, term_weights
    model = FreqBackend(term_weights(S.abstracts(spark, d)), P.FREQ_SENTENCES)
    p = ok_articles(spark, d).select("pmid", PR.article_prompt(F.col("article")).alias("prompt"))
    return infer(p, "prompt", model, "response").select("pmid", "response", F.col("response_status").alias("status"))


@query("distill")
def q_distill(spark, d):
    mx, ck = P.GENE_BUDGET
    return plain(distill(gene_texts(spark, d), ["gene_id"], "row_ord", "text", backend(), mx, ck).drop("n_texts"))


@query("distill_two_rounds")
def q_distill_two_rounds(spark, d):
    mx, ck = P.TWO_ROUNDS
    return plain(distill(gene_texts(spark, d), ["gene_id"], "row_ord", "text", backend(), mx, ck, max_rounds=2).drop("n_texts"))


@query("summarize_articles")
def q_summarize_articles(spark, d):
    mx, ck = P.ARTICLE_BUDGET
    return plain(J.summarize_articles(S.abstracts(spark, d).select("pmid"), S.article_links(spark, d),
                                      S.articles(spark, d), backend(), mx, ck))


@query("article_task")
def q_article_task(spark, d):
    mx, ck = P.ARTICLE_BUDGET
    return plain(J.summarize_articles(S.abstracts(spark, d).select("pmid"), S.article_links(spark, d),
                                      S.articles(spark, d), backend(), mx, ck, task=P.TASK))


@query("summarize_genes")
def q_summarize_genes(spark, d):
    mx, ck = P.GENE_BUDGET
    return plain(J.summarize_genes(gene_list(spark, d), S.annotations(spark, d), S.aliases(spark, d), S.genes(spark, d),
                                   backend(), P.PROCESS, mx, ck, tax_id=P.HUMAN))


@query("process_narrative")
def q_process_narrative(spark, d):
    mx, ck = P.GENE_BUDGET
    members = gene_sets(spark, d).withColumnRenamed("symbol", "token")
    s = J.summarize_genes(members, S.annotations(spark, d), S.aliases(spark, d), S.genes(spark, d),
                          backend(), P.PROCESS, mx, ck, tax_id=P.HUMAN)
    per = members.join(s.select("token", F.coalesce("gene_name", "token").alias("gene"), "summary", "status", "error"), "token")
    return plain(J.process_narrative(per, ["gene_set"], backend(), P.PROCESS, mx, ck))


@query("create_annotations")
def q_create_annotations(spark, d):
    mx, ck = P.GENE_BUDGET
    ids = lookup.distinct_genes(S.annotations(spark, d), P.HUMAN)
    # Genes that nothing cites keep a row.
    ids = ids.unionByName(S.genes(spark, d).filter(F.col("gene_id") > S.SUPPLIER_GENE).select("gene_id"))
    return plain(J.create_annotations(ids, S.genes(spark, d), S.gene_pmids(spark, d), S.abstracts(spark, d),
                                      backend(), P.PROCESS, mx, ck, P.TOP_K_ABSTRACTS))


@query("synthetic_pairs")
def q_synthetic_pairs(spark, d):
    mx, ck = P.PAIR_BUDGET
    return plain(J.synthetic_pairs(S.annotations(spark, d), S.abstracts(spark, d), S.genes(spark, d), backend(),
                                   P.PROCESS, mx, ck, P.HUMAN))


@query("genes_to_process")
def q_genes_to_process(spark, d):
    mx, ck = P.GENE_BUDGET
    return plain(J.genes_to_process(gene_list(spark, d), S.annotations(spark, d), S.aliases(spark, d), S.genes(spark, d),
                              S.gene_pmids(spark, d), S.abstracts(spark, d), backend(), P.PROCESS, mx, ck,
                              add_abstracts=True, k=P.TOP_K_ABSTRACTS, tax_id=P.HUMAN))


def vector_checks(e):
    """Exact checks of a hashed vector: non-zero count, index sum, arg-max, unit norm."""
    nz = F.size(F.filter(e, lambda v: v > 0)).cast("bigint")
    idx_sum = F.aggregate(F.transform(e, lambda v, i: F.when(v > 0, i).otherwise(0).cast("bigint")),
                          F.lit(0).cast("bigint"), lambda a, x: a + x)
    top = F.when(nz > 0, (F.array_position(e, F.array_max(e)) - 1).cast("bigint"))
    sq = F.aggregate(e, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double"))
    return [nz.alias("n_nonzero"), idx_sum.alias("idx_sum"), top.alias("top_bucket"),
            (F.abs(sq - 1.0) < 1e-4).alias("unit_norm")]


@query("embed_hash")
def q_embed_hash(spark, d):
    emb = EM.HashEmbedder(P.EMBED_DIM)
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    b = docs.select("doc_id", emb.buckets(F.col("text")).alias("b"))
    e = b.select("doc_id", F.size("b").cast("bigint").alias("n_words"), emb.vector(F.col("b")).alias("embedding"))
    return e.select("doc_id", "n_words", *vector_checks(F.col("embedding")))


@query("index_rows")
def q_index_rows(spark, d):
    idx = J.build_index(S.annotations(spark, d), S.genes(spark, d), EM.HashEmbedder(P.EMBED_DIM), P.HUMAN)
    return idx.select("key", "gene_id", "gene_name", "idx", "type", "text",
                      F.size("embedding").cast("bigint").alias("dim"), vector_checks(F.col("embedding"))[0])


@query("embed_gene")
def q_embed_gene(spark, d):
    e = J.embed_gene(P.GENE_ID, S.annotations(spark, d), S.aliases(spark, d), EM.HashEmbedder(P.EMBED_DIM), P.HUMAN)
    return e.select("gene_id", "idx", "text", *vector_checks(F.col("embedding")))


# --- sinks and the checkpointed ("dry run") path ---------------------------------

from ..session import scratch_path  # noqa: E402
from ..sources import sinks as SK  # noqa: E402


@query("pairs_tsv")
def q_pairs_tsv(spark, d):
    """O49 -> O09: paired rows written as TSV and read back."""
    mx, ck = P.PAIR_BUDGET
    pairs = J.synthetic_pairs(S.annotations(spark, d), S.abstracts(spark, d), S.genes(spark, d), backend(),
                              P.PROCESS, mx, ck, P.HUMAN)
    path = scratch_path(spark, "pairs-tsv")
    SK.write_pairs_tsv(pairs, path)
    return SK.read_pairs_tsv(spark, path)


@query("summaries_checkpoint")
def q_summaries_checkpoint(spark, d):
    """O50 with just_summaries -> O10 write; O11 read -> O46 narrative."""
    mx, ck = P.GENE_BUDGET
    members = gene_list(spark, d)
    s = J.genes_to_process(members, S.annotations(spark, d), S.aliases(spark, d), S.genes(spark, d),
                           S.gene_pmids(spark, d), S.abstracts(spark, d), backend(), P.PROCESS, mx, ck,
                           add_abstracts=True, just_summaries=True, k=P.TOP_K_ABSTRACTS, tax_id=P.HUMAN)
    path = scratch_path(spark, "summaries")
    SK.write_summaries(s.withColumn("gene", F.coalesce("gene_name", "token")), path)
    # The order of the narrative is that of the file's own positions.
    per = SK.read_summaries(spark, path).select("pos", "gene", "summary", "status", "error").withColumn("_list", F.lit("genes"))
    return plain(J.process_narrative(per, ["_list"], backend(), P.PROCESS, mx, ck).drop("_list"))


@query("index_table")
def q_index_table(spark, d):
    """O52 -> O12: the index written as a Parquet table and read back."""
    idx = J.build_index(S.annotations(spark, d), S.genes(spark, d), EM.HashEmbedder(P.EMBED_DIM), P.HUMAN)
    path = scratch_path(spark, "index")
    SK.write_index(idx, path)
    t = spark.read.parquet(path)
    return t.select("key", "gene_id", "gene_name", "idx", "type", "text",
                    F.size("embedding").cast("bigint").alias("dim"), vector_checks(F.col("embedding"))[0])


@query("index_upsert")
def q_index_upsert(spark, d):
    """The keyed store after two releases, the first with another wording of some texts."""
    from ..sources.index_store import read_index_store
    embedder = EM.HashEmbedder(P.EMBED_DIM)
    now = S.annotations(spark, d)
    before = now.withColumn("text", F.when(F.col("row_ord") % 3 == 0, F.concat(F.lit("Formerly: "), "text")).otherwise(F.col("text")))
    path = scratch_path(spark, "index-store")
    for release in (before, now):
        J.update_index(release, S.genes(spark, d), path, embedder, P.HUMAN)
    t = read_index_store(spark, path)
    return t.select("key", "gene_id", "gene_name", "idx", "type", "text",
                    F.size("embedding").cast("bigint").alias("dim"), vector_checks(F.col("embedding"))[0])


@query("index_topk")
def q_index_topk(spark, d):
    """The index filed in cells; for every model answer the nearest annotations."""
    from ..operators import search
    embedder = EM.HashEmbedder(P.EMBED_DIM)
    path = scratch_path(spark, "index-cells")
    search.write_cells(J.build_index(S.annotations(spark, d), S.genes(spark, d), embedder, P.HUMAN), path)
    answers = S.model_answers(spark, d).select(F.col("answer_id").alias("query_id"), "raw")
    return search.top_k(spark, path, EM.embed(answers, "raw", embedder), P.NEAREST)


@query("annotation_tsv_ingest")
def q_annotation_tsv_ingest(spark, d):
    """O01 + O02 + O03 on a real TSV: the stand-in annotations are written in
    the published layout (gzip, header, tab, one line per row; tabs and
    newlines inside text become a space; the source row id rides in the
    timestamp column), scanned back, ingested to partitioned Parquet, read
    through the cache and numbered in the order of the file."""
    a = S.annotations(spark, d)
    safe = F.regexp_replace(F.col("text"), r"[\t\r\n]+", " ")
    tsv = a.orderBy("row_ord").select(
        F.col("tax_id").cast("string").alias("#Tax ID"), F.col("gene_id").cast("string").alias("Gene ID"),
        F.col("pmid_list").alias("PubMed ID (PMID) list"), F.col("row_ord").cast("string").alias("last update timestamp"),
        safe.alias("GeneRIF text"))
    src = scratch_path(spark, "annotations-tsv")
    (tsv.write.option("sep", "\t").option("header", True).option("quote", "").option("escape", "")
        .option("emptyValue", "").option("compression", "gzip").csv(src))
    from ..sources import annotations as AN
    t = AN.load_annotations(spark, src, scratch_path(spark, "annotations-parquet"))
    # The rows were written in the order of their numbers: row_ord has to keep it, inside every input split and from one to the next.
    t = t.withColumn("_split", F.expr("row_ord div 4294967296")).withColumn("_row", F.col("updated_at").cast("bigint"))
    ends = t.groupBy("_split").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    after = ends.select((F.col("_split") - 1).alias("_split"), F.col("_first").alias("_next"))
    ordered = ends.join(after, "_split", "left").select("_split", (F.col("_next").isNull() | (F.col("_last") < F.col("_next"))).alias("_ends"))
    before = F.lag("_row").over(Window.partitionBy("_split").orderBy("row_ord"))
    t = t.withColumn("_inside", F.coalesce(before < F.col("_row"), F.lit(True))).join(ordered, "_split")
    # The place of a row among all: blocks of rows are counted, and only the rows of one block are numbered in one task.
    t = ordinal(t, [], "row_ord", "file_row")
    return t.select("tax_id", "gene_id", "pmid_list", F.size("pmids").cast("bigint").alias("n_pmids"),
                    F.col("updated_at").alias("source_row"), "text", "file_row", (F.col("_inside") & F.col("_ends")).alias("in_order"))


@query("annotation_rejects")
def q_annotation_rejects(spark, d):
    """Lines of a TSV that are no annotations: too short, or with a gene that is no number."""
    a = S.annotations(spark, d)
    safe = F.regexp_replace(F.substring("text", 1, 60), r"[\t\r\n]+", " ")
    gene = F.when(F.col("row_ord") % 5 == 1, F.concat(F.lit("gene "), F.col("gene_id").cast("string"))).otherwise(F.col("gene_id").cast("string"))
    fields = [F.col("tax_id").cast("string"), gene, F.col("pmid_list"), F.col("row_ord").cast("string"), safe]
    line = F.when(F.col("row_ord") % 7 == 2, F.concat_ws("\t", *fields[:4])).otherwise(F.concat_ws("\t", *fields))
    src = scratch_path(spark, "annotations-tsv")
    a.select(line.alias("value")).write.option("compression", "gzip").text(src)
    from ..sources import annotations as AN
    r = AN.annotation_rejects(spark, src, header=False)
    return r.select("reason", "line")


@query("infer_resumable")
def q_infer_resumable(spark, d):
    """O43 through the Python path: distinct prompts -> mapInPandas batches ->
    appended to a responses table; a second run finds every prompt answered
    (anti join) and only joins the stored answers back."""
    from ..operators.infer import python_lead
    p = ok_articles(spark, d).select("pmid", PR.article_prompt(F.col("article")).alias("prompt"))
    store = scratch_path(spark, "responses")
    infer(p, "prompt", python_lead(P.LEAD_SENTENCES), "response", responses_path=store)
    again = infer(p, "prompt", python_lead(P.LEAD_SENTENCES), "response", responses_path=store)
    return again.select("pmid", "response", F.col("response_status").alias("status"))
