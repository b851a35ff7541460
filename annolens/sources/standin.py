"""Stand-in views: the reference's inputs derived from the driver tables.

FIXTURES.md §3 maps ``documents``/``nation``/``region``/``pages``/
``conversations``/``embeddings`` onto annotations, genes, gene sets,
abstracts, articles, model answers and index vectors.  Every view is a
plain projection or join of whole tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_pmid_list

# Fixed species codes of the stand-in mapping (lang -> taxonomy id).
HUMAN = 9606
LANG_TO_TAX = {"en": 9606, "de": 10090, "fr": 10116}
OTHER_TAX = 7955


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _tax(lang: Column) -> Column:
    expr = None
    for k, v in LANG_TO_TAX.items():
        expr = (F.when(lang == k, F.lit(v)) if expr is None else expr.when(lang == k, F.lit(v)))
    return expr.otherwise(F.lit(OTHER_TAX)).cast("int")


def pmid_list_of(doc_id: Column) -> Column:
    """Stand-in PMID list text: empty, one id, or two ids."""
    return (F.when(doc_id % 7 == 0, F.lit(""))
            .when(doc_id % 3 == 0, F.concat(doc_id.cast("string"), F.lit(","), (doc_id + 1).cast("string")))
            .otherwise(doc_id.cast("string")))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """tax_id, gene_id, pmid_list, pmids, text, row_ord."""
    doc = table(spark, d, "documents")
    return doc.select(
        _tax(F.col("lang")).alias("tax_id"),
        F.col("source").substr(F.lit(4), F.length("source")).try_cast("bigint").alias("gene_id"),
        pmid_list_of(F.col("doc_id")).alias("pmid_list"),
        F.col("text"),
        F.col("doc_id").alias("row_ord"),
    ).withColumn("pmids", parse_pmid_list("pmid_list"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    """Gene dictionary: gene_id, tax_id, symbol."""
    return _symbols(spark, d).select("gene_id", F.lit(HUMAN).cast("int").alias("tax_id"), "symbol")


# Suppliers are genes, too (without annotations), so that the dictionary grows with the tables.
SUPPLIER_GENE = 1000


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """gene_id, symbol, region: the nations, then the suppliers."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return n.select(F.col("n_nationkey").cast("bigint").alias("gene_id"), F.col("n_name").alias("symbol"), F.col("n_regionkey").alias("region")) \
        .unionByName(s.select((F.col("s_suppkey") + SUPPLIER_GENE).cast("bigint").alias("gene_id"), F.col("s_name").alias("symbol"), F.col("n_regionkey").alias("region")))


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """symbol, gene_id, is_official: official names, lower-case names, and a
    shared group name per region (several genes: the tie-break decides)."""
    n = table(spark, d, "nation")
    official = _symbols(spark, d).select("symbol", "gene_id", F.lit(True).alias("is_official"))
    lower = n.select(F.lower("n_name").alias("symbol"), F.col("n_nationkey").cast("bigint").alias("gene_id"),
                     F.lit(False).alias("is_official"))
    group = n.select(F.concat(F.lit("NATION_"), F.col("n_regionkey").cast("string")).alias("symbol"),
                     F.col("n_nationkey").cast("bigint").alias("gene_id"), F.lit(False).alias("is_official"))
    return official.unionByName(lower).unionByName(group)


def gene_set_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per gene set, in the published collection shape
    ``{"<set>": {"geneSymbols": [...]}}``, built per region."""
    r = table(spark, d, "region")
    members = (r.join(_symbols(spark, d), F.col("region") == F.col("r_regionkey"))
               .groupBy("r_name")
               .agg(F.array_sort(F.collect_list(F.struct("gene_id", "symbol"))).alias("m")))
    return members.select(F.to_json(F.create_map(
        F.col("r_name"), F.struct(F.transform("m", lambda x: x["symbol"]).alias("geneSymbols")))).alias("value"))


def gene_list_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw gene-list lines (line_no, line): symbols, numeric IDs, padded and
    blank lines, lower-case aliases, and unknown names."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    k = F.col("n_regionkey")
    nl = n.select(
        F.col("n_nationkey").cast("bigint").alias("line_no"),
        F.when(k == 0, F.lit(""))
         .when(k == 1, F.concat(F.col("n_nationkey").cast("string"), F.lit("\n")))
         .when(k == 2, F.concat(F.lit("  "), F.col("n_name")))
         .when(k == 3, F.lower("n_name"))
         .otherwise(F.col("n_name")).alias("line"))
    rl = r.select((F.col("r_regionkey") + 100).cast("bigint").alias("line_no"), F.col("r_name").alias("line"))
    more = _symbols(spark, d).filter(F.col("gene_id") > SUPPLIER_GENE).select(F.col("gene_id").alias("line_no"), F.col("symbol").alias("line"))
    return nl.unionByName(rl).unionByName(more)


def abstracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("pmid"), "text")


#: Tokens of the stand-in vocabulary, before those with a space are added.
VOCABULARY_SIZE = 1000


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """token: the most frequent letter runs of up to five characters in the documents, each also after a space."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{1,5}"), F.lit(0))).alias("token"))
    often = words.groupBy("token").count().orderBy(F.desc("count"), "token").limit(VOCABULARY_SIZE)
    return often.select(F.explode(F.array("token", F.concat(F.lit(" "), "token"))).alias("token"))


def gene_pmids(spark: SparkSession, d: str) -> DataFrame:
    """gene_id, pmid: every PMID cited by an annotation of the gene."""
    a = annotations(spark, d)
    return a.select("gene_id", F.explode("pmids").alias("pmid")).distinct()


def article_links(spark: SparkSession, d: str) -> DataFrame:
    """pmid, pmcid, link_ord; a fifth of the PMIDs has a (second) link to no article."""
    doc = table(spark, d, "documents").select("doc_id")
    pages = table(spark, d, "pages").select("page_id")
    found = doc.join(pages, F.col("page_id") == F.col("doc_id")).select(
        F.col("doc_id").alias("pmid"), F.col("page_id").alias("pmcid"), F.lit(1).alias("link_ord"))
    return found.unionByName(doc.filter(F.col("doc_id") % 5 == 4).select(
        F.col("doc_id").alias("pmid"), (-F.col("doc_id")).alias("pmcid"), F.lit(2).alias("link_ord")))


def articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("pmcid"), F.col("html").alias("body"))


def article_xml(spark: SparkSession, d: str) -> DataFrame:
    """pmcid, body: every document as an XML article, in six forms of which two are not well-formed, and every page as it is."""
    doc = table(spark, d, "documents").withColumn("t", F.expr("replace(replace(text, '&', '&amp;'), '<', '&lt;')"))
    doc = doc.withColumn("first", F.expr("split_part(t, '\\n', 1)")).withColumn("rest", F.expr("replace(t, '\\n', '</p><p>')"))
    body = F.expr("""case doc_id % 6
        when 0 then concat('<article><title>', first, '</title><sec><p>', rest, '</p></sec></article>')
        when 1 then concat('<article xmlns:m="u"><m:p>', first, '</m:p><p>', rest, '<b>x</b>tail</p></article>')
        when 2 then concat('<article><p>', rest, '</article>')
        when 3 then concat('<article><p><![CDATA[', first, ']]>', rest, '</p><p/></article>')
        when 4 then concat('<article><sec xmlns="u"><p>', first, '</p></sec><!-- c --><p> ', rest, ' </p></article>')
        else concat('<article><p>', first, '&#233;&x;</p></article>') end""")
    return doc.select(F.col("doc_id").alias("pmcid"), body.alias("body")).unionByName(
        articles(spark, d).select((-F.col("pmcid") - 1).alias("pmcid"), "body"))


FENCE_OPEN = "```json"
FENCE_CLOSE = "```"


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as model answers, wrapped in code fences the way chat
    models return them (answer_id, text)."""
    c = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"),
        F.concat(F.lit(FENCE_OPEN + "\n"), F.col("text"), F.lit("\nsee above" + FENCE_CLOSE + "\n" + FENCE_CLOSE)).alias("text"),
        F.col("text").alias("raw"),
    )
