"""Oracle SQL (DuckDB dialect) for every catalogue query.

Each statement starts from the same stand-in views as ``sources.standin``
(FIXTURES.md §3), written independently in SQL.  Parameters are the fixed
values of ``plans.params``.
"""

from __future__ import annotations

from . import params as P

BASE = f"""
annotations AS (
  SELECT CAST(CASE lang WHEN 'en' THEN 9606 WHEN 'de' THEN 10090 WHEN 'fr' THEN 10116 ELSE 7955 END AS INTEGER) AS tax_id,
         CAST(substr(source, 4) AS BIGINT) AS gene_id,
         CASE WHEN doc_id % 7 = 0 THEN ''
              WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) || ',' || CAST(doc_id + 1 AS VARCHAR)
              ELSE CAST(doc_id AS VARCHAR) END AS pmid_list,
         list_filter(list_transform(string_split(
            CASE WHEN doc_id % 7 = 0 THEN ''
                 WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) || ',' || CAST(doc_id + 1 AS VARCHAR)
                 ELSE CAST(doc_id AS VARCHAR) END, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)), lambda x: x IS NOT NULL) AS pmids,
         text, doc_id AS row_ord
  FROM documents),
symbols AS (
  SELECT CAST(n_nationkey AS BIGINT) AS gene_id, n_name AS symbol, n_regionkey AS region FROM nation
  UNION ALL SELECT CAST(s_suppkey AS BIGINT) + 1000, s_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
genes AS (SELECT gene_id, 9606 AS tax_id, symbol FROM symbols),
aliases AS (
  SELECT symbol, gene_id, true AS is_official FROM symbols
  UNION ALL SELECT lower(n_name), CAST(n_nationkey AS BIGINT), false FROM nation
  UNION ALL SELECT 'NATION_' || CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS BIGINT), false FROM nation),
best_alias AS (
  SELECT symbol, gene_id FROM (
    SELECT symbol, gene_id, row_number() OVER (PARTITION BY symbol ORDER BY is_official DESC, gene_id) AS rk FROM aliases)
  WHERE rk = 1),
gene_sets AS (
  SELECT r_name AS gene_set, CAST(row_number() OVER (PARTITION BY r_name ORDER BY gene_id) - 1 AS BIGINT) AS pos, symbol
  FROM region JOIN symbols ON region = r_regionkey),
gene_list_lines AS (
  SELECT CAST(n_nationkey AS BIGINT) AS line_no,
         CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN CAST(n_nationkey AS VARCHAR) || chr(10)
              WHEN 2 THEN '  ' || n_name WHEN 3 THEN lower(n_name) ELSE n_name END AS line
  FROM nation
  UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), r_name FROM region
  UNION ALL SELECT gene_id, symbol FROM symbols WHERE gene_id > 1000),
gene_list AS (
  SELECT line_no AS pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS token FROM gene_list_lines
  WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''),
abstracts AS (SELECT doc_id AS pmid, text FROM documents),
gene_pmids AS (SELECT DISTINCT gene_id, unnest(pmids) AS pmid FROM annotations),
article_links AS (
  SELECT doc_id AS pmid, page_id AS pmcid, 1 AS link_ord FROM documents JOIN pages ON page_id = doc_id
  UNION ALL SELECT doc_id, -doc_id, 2 FROM documents WHERE doc_id % 5 = 4),
articles AS (SELECT page_id AS pmcid, html AS body FROM pages),
model_answers AS (
  SELECT conv_id * 1000 + turn AS answer_id,
         '```json' || chr(10) || text || chr(10) || 'see above```' || chr(10) || '```' AS text,
         text AS raw
  FROM conversations WHERE role = 'assistant'),
human AS (SELECT * FROM annotations WHERE tax_id = {P.HUMAN})
"""


def q(body: str) -> str:
    return "WITH " + BASE.strip() + "\n" + body


def resolve_tokens_sql(src: str, tok: str) -> str:
    """Mixed resolution of column ``tok`` of relation ``src`` (adds gene_id)."""
    return f"""(SELECT s.*, COALESCE(
        CASE WHEN regexp_full_match(s.{tok}, '[0-9]+') THEN TRY_CAST(s.{tok} AS BIGINT) END,
        b.gene_id) AS gene_id
      FROM {src} s LEFT JOIN best_alias b ON b.symbol = s.{tok})"""


ORACLE: dict[str, str] = {}

ORACLE["scan_annotations"] = q("SELECT tax_id, gene_id, pmid_list, text, row_ord FROM annotations")

ORACLE["parse_pmids"] = q("""SELECT row_ord, CAST(len(pmids) AS BIGINT) AS n_pmids,
  array_to_string(pmids, ',') AS pmids_text, pmids[1] AS first_pmid FROM annotations""")

ORACLE["gene_set_members"] = q("SELECT gene_set, pos, symbol FROM gene_sets")

ORACLE["gene_list_tokens"] = q("SELECT pos, token FROM gene_list")

ORACLE["filter_species"] = q("SELECT tax_id, gene_id, row_ord, text FROM annotations WHERE tax_id = 9606")

ORACLE["filter_has_pmids"] = q("SELECT gene_id, row_ord, CAST(len(pmids) AS BIGINT) AS n_pmids FROM annotations WHERE len(pmids) > 0")

ORACLE["filter_has_text"] = q("SELECT gene_id, row_ord FROM annotations WHERE length(text) > 0")

ORACLE["resolve_symbols"] = q("""SELECT g.pos, g.token, b.gene_id FROM gene_list g
  LEFT JOIN best_alias b ON b.symbol = g.token""")

ORACLE["resolve_tokens"] = q(f"SELECT pos, token, gene_id FROM {resolve_tokens_sql('gene_list', 'token')}")

ORACLE["resolve_ids"] = q("""SELECT a.row_ord, a.gene_id, g.symbol FROM annotations a
  LEFT JOIN genes g ON g.gene_id = a.gene_id""")

ORACLE["texts_for_gene"] = q(f"""SELECT gene_id, CAST(row_number() OVER (ORDER BY row_ord) AS BIGINT) AS idx, row_ord, text
  FROM human WHERE gene_id = (SELECT gene_id FROM best_alias WHERE symbol = '{P.GENE}')""")


def _texts_for_members(src: str, tok: str, group: list[str], more: str = "") -> str:
    part = ", ".join([f"m.{g}" for g in group] + ["m.pos"])
    gsel = "".join(f"m.{g}, " for g in group)
    cols = ", ".join([*group, tok])
    return f"""SELECT {gsel}m.pos, m.{tok}, m.gene_id,
    CASE WHEN a.text IS NULL THEN NULL
         ELSE CAST(row_number() OVER (PARTITION BY {part} ORDER BY a.row_ord NULLS LAST) AS BIGINT) END AS idx,
    a.row_ord, a.text
  FROM {resolve_tokens_sql(f"(SELECT {cols}, min(pos) AS pos FROM {src} GROUP BY {cols})", tok)} m
  LEFT JOIN (SELECT gene_id, row_ord, text FROM human WHERE length(text) > 0 {more}) a ON a.gene_id = m.gene_id"""


ORACLE["texts_by_gene_set"] = q(_texts_for_members("gene_sets", "symbol", ["gene_set"]))

ORACLE["texts_by_gene_list"] = q(_texts_for_members("gene_list", "token", []))

ORACLE["distinct_genes"] = q("SELECT DISTINCT gene_id FROM human")


# --- M2 / M3 -------------------------------------------------------------------

NL2 = "chr(10) || chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def article_seg_sql(body: str) -> str:
    b = rf"regexp_replace(regexp_replace({body}, '(?s)<!--.*?-->', '', 'g'), '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g')"
    dec = strip_sql("s")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        dec = f"replace({dec}, {lit(ent)}, {lit(ch)})"
    return rf"list_transform(regexp_extract_all({b}, '<(?:title|p|sec)(?:\s+|\s[^>]*[^/>])?>([^<]+)', 1), lambda s: {dec})"


ORACLE["strip_fences"] = q("""SELECT answer_id, array_to_string(list_filter(string_split(text, chr(10)),
  lambda l: NOT starts_with(l, '```') AND NOT ends_with(l, '```')), chr(10)) AS cleaned FROM model_answers""")

ORACLE["ensure_punct"] = q("""SELECT row_ord, CASE WHEN text IS NULL THEN NULL
  WHEN right(text, 1) IN ('.', '?', '!') THEN text ELSE text || '.' END AS text_p FROM annotations""")

ORACLE["first_sentence"] = q(f"""SELECT answer_id,
  {strip_sql("list_filter(string_split(raw, '.'), lambda x: x <> '')[1]")} AS sentence FROM model_answers""")

ORACLE["token_count"] = q(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+\s*|^\s+', 0)) AS BIGINT) AS n_tokens
  FROM documents""")

ORACLE["article_segments"] = q(f"""SELECT pmcid, CAST(len(seg) AS BIGINT) AS n_segments,
  array_to_string(seg, {NL2}) AS article FROM (SELECT pmcid, {article_seg_sql('body')} AS seg FROM articles)""")

LOOKUP_SQL = """, lookup AS (
  SELECT a.pmid, l.pmcid, CASE WHEN l.pmcid IS NULL THEN 'no_link' WHEN ar.body IS NULL THEN 'missing' ELSE 'ok' END AS status,
         ar.body
  FROM abstracts a
  LEFT JOIN (SELECT pmid, pmcid FROM (SELECT pmid, pmcid,
               row_number() OVER (PARTITION BY pmid ORDER BY link_ord, pmcid) AS rk FROM article_links) WHERE rk = 1) l
    ON l.pmid = a.pmid
  LEFT JOIN articles ar ON ar.pmcid = l.pmcid)"""

ORACLE["article_lookup"] = q(LOOKUP_SQL + "\nSELECT pmid, pmcid, status, body FROM lookup")

ORACLE["abstract_by_pmid"] = q(""", ex AS (
  SELECT row_ord, CAST(i AS BIGINT) AS pos, pmids[i + 1] AS pmid
  FROM (SELECT row_ord, pmids, unnest(range(len(pmids))) AS i FROM annotations)
  UNION ALL SELECT row_ord, NULL, NULL FROM annotations WHERE len(pmids) = 0)
SELECT ex.row_ord, ex.pos, ex.pmid,
  CASE WHEN ex.pmid IS NULL THEN 'no_pmid' WHEN ab.text IS NULL THEN 'missing' ELSE 'ok' END AS status,
  ab.text AS abstract
FROM ex LEFT JOIN abstracts ab ON ab.pmid = ex.pmid""")

TOPK_SQL = f""", top AS (
  SELECT gene_id, rank, pmid FROM (
    SELECT gene_id, CAST(row_number() OVER (PARTITION BY gene_id ORDER BY pmid DESC) AS BIGINT) AS rank, pmid
    FROM gene_pmids) WHERE rank <= {P.TOP_K_ABSTRACTS}),
topk AS (SELECT t.gene_id, t.rank, t.pmid, ab.text FROM top t JOIN abstracts ab ON ab.pmid = t.pmid),
gene_abs AS (SELECT gene_id, count(*) AS n_abstracts, string_agg(text, {NL2} ORDER BY rank) AS abstracts
  FROM topk GROUP BY gene_id)"""

_ADDED = "UNION ALL SELECT gene_id, NULL, abstracts FROM gene_abs"
ORACLE["texts_by_gene_set_abstracts"] = q(TOPK_SQL + "\n" + _texts_for_members("gene_sets", "symbol", ["gene_set"], _ADDED))
ORACLE["texts_by_gene_list_abstracts"] = q(TOPK_SQL + "\n" + _texts_for_members("gene_list", "token", [], _ADDED))

ORACLE["gene_abstracts_topk"] = q(TOPK_SQL + "\nSELECT gene_id, rank, pmid, text FROM topk")

ORACLE["gene_abstracts_text"] = q(TOPK_SQL + "\nSELECT gene_id, n_abstracts, abstracts FROM gene_abs")

PAIRS_SQL = f""", ex AS (
  SELECT row_ord, gene_id, text AS ground_truth, i AS pos, pmids[i + 1] AS pmid
  FROM (SELECT *, unnest(range(len(pmids))) AS i FROM human WHERE len(pmids) > 0 AND length(text) > 0)),
pairs_in AS (
  SELECT e.row_ord, e.gene_id, g.symbol AS gene_name, e.ground_truth,
         string_agg(ab.text, {NL2} ORDER BY e.pos) AS abstracts
  FROM ex e JOIN abstracts ab ON ab.pmid = e.pmid JOIN genes g ON g.gene_id = e.gene_id
  WHERE g.symbol IS NOT NULL
  GROUP BY e.row_ord, e.gene_id, g.symbol, e.ground_truth)"""

ORACLE["pairs_inputs"] = q(PAIRS_SQL + "\nSELECT row_ord, gene_id, gene_name, ground_truth, abstracts FROM pairs_in")

ART_OK_SQL = LOOKUP_SQL + f""", art AS (
  SELECT pmid, array_to_string({article_seg_sql('body')}, {NL2}) AS article FROM lookup WHERE status = 'ok')"""

# The instructions, written out here once more: a change of a template has to show.
CHUNK_SAYS = "Condense the passage below into a short summary that keeps every gene, protein and effect it names."
ARTICLE_SAYS = "Write a summary of the scientific article below."
TASK_SAYS = ("Which E3 ligase acts on which substrate in the text below? "
             "JSON only, one object per pair: E3_ligase, substrate (protein identifiers).")
PROCESS = "response to hypoxia"

ORACLE["prompt_article"] = q(ART_OK_SQL + f"\nSELECT pmid, {lit(ARTICLE_SAYS)} || {NL2} || article AS prompt FROM art")

ORACLE["prompt_task"] = q(ART_OK_SQL + f"""
SELECT pmid, 'e3-ligase' AS task, {lit(TASK_SAYS)} || {NL2} || article AS prompt FROM art""")


# --- M4 ------------------------------------------------------------------------

# Words of the chunk instruction, and the budgets of the jobs less these.
PREFIX = len(CHUNK_SAYS.split())
MAXT, CHUNKT = 16000, 16000
GENE, ARTICLE, PAIR = ((mx, ck - PREFIX) for mx, ck in (P.GENE_BUDGET, P.ARTICLE_BUDGET, P.PAIR_BUDGET))
TOKRE = r"'\S+\s*|^\s+'"


def punct_sql(t: str) -> str:
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN right({t}, 1) IN ('.', '?', '!') THEN {t} ELSE {t} || '.' END"


def chunks_sql(src: str, key: str, joined: str, mx: int, size: int) -> str:
    """Naive form: tokenize the whole joined text, then cut."""
    return f"""(
  SELECT {key}, CAST(0 AS BIGINT) AS chunk_idx, CAST(1 AS BIGINT) AS n_chunks, 'pass' AS kind,
         CAST(len(k) AS BIGINT) AS n_tokens, {joined} AS chunk_text
  FROM (SELECT *, regexp_extract_all({joined}, {TOKRE}, 0) AS k FROM {src}) WHERE len(k) <= {mx}
  UNION ALL
  SELECT {key}, CAST(i AS BIGINT), CAST(ceil(len(k) / {size}) AS BIGINT), 'chunk', CAST(len(k) AS BIGINT),
         array_to_string(k[i * {size} + 1 : i * {size} + {size}], '')
  FROM (SELECT *, unnest(range(CAST(ceil(len(k) / {size}) AS BIGINT))) AS i
        FROM (SELECT *, regexp_extract_all({joined}, {TOKRE}, 0) AS k FROM {src}) WHERE len(k) > {mx}))"""


GENE_TEXT_SQL = f""", gene_text AS (
  SELECT gene_id, row_ord, {punct_sql('text')} AS text FROM human WHERE length(text) > 0),
gene_joined AS (SELECT gene_id, string_agg(text, ' ' ORDER BY row_ord) AS joined FROM gene_text GROUP BY gene_id)"""

ORACLE["chunk_text"] = q(f"""SELECT doc_id, chunk_idx, n_chunks, kind, n_tokens, chunk_text FROM
  {chunks_sql('(SELECT doc_id, text FROM documents)', 'doc_id', 'text', P.ROW_MAX_TOKENS, P.ROW_CHUNK_TOKENS - PREFIX)}""")

ORACLE["distill_plan"] = q(GENE_TEXT_SQL + f"""
SELECT gene_id, n_tokens, CASE WHEN n_tokens <= {MAXT} THEN 'pass' ELSE 'chunk' END AS kind,
  CAST(CASE WHEN n_tokens <= {MAXT} THEN 1 ELSE ceil(n_tokens / {CHUNKT - PREFIX}) END AS BIGINT) AS n_chunks
FROM (SELECT gene_id, CAST(len(regexp_extract_all(joined, {TOKRE}, 0)) AS BIGINT) AS n_tokens FROM gene_joined)""")

ORACLE["distill_plan_bucketed"] = ORACLE["distill_plan"]

ORACLE["chunk_gene"] = q(GENE_TEXT_SQL + f"""
SELECT gene_id, chunk_idx, n_chunks, kind, n_tokens, chunk_text FROM
  {chunks_sql('gene_joined', 'gene_id', 'joined', *GENE)}""")


# --- M5-M7 ----------------------------------------------------------------------


def lead_sql(prompt: str, k: int = P.LEAD_SENTENCES) -> str:
    body = f"(CASE WHEN strpos({prompt}, {NL2}) > 0 THEN substr({prompt}, strpos({prompt}, {NL2}) + 2) ELSE {prompt} END)"
    s = f"regexp_extract_all({body}, '[^.!?]*[.!?]+', 0)"
    return strip_sql(f"(CASE WHEN len({s}) > 0 THEN array_to_string({s}[1:{k}], '') ELSE {body} END)")


def first_sentence_sql(x: str) -> str:
    return strip_sql(f"list_filter(string_split({x}, '.'), lambda x: x <> '')[1]")


def distill_sql(src: str, key: str, joined: str, mx: int, size: int) -> str:
    """One round: pass whole, or answer each chunk and join answers with a space."""
    chunk_p = f"{lit(CHUNK_SAYS)} || {NL2} || chunk_text"
    return f"""(
  SELECT {key}, any_value(n_tokens) AS n_tokens, any_value(kind) AS kind,
         CAST(CASE WHEN any_value(kind) = 'pass' THEN 0 ELSE 1 END AS INTEGER) AS rounds,
         CASE WHEN any_value(kind) = 'pass' THEN any_value(chunk_text)
              ELSE string_agg({lead_sql(chunk_p)}, ' ' ORDER BY chunk_idx) END AS distilled
  FROM {chunks_sql(src, key, joined, mx, size)} GROUP BY {key})"""


def gene_prompt_sql(name: str, data: str) -> str:
    return (f"'Each statement below is a curated finding. Merge the findings on ' || {name} || ' that bear on {PROCESS} into one "
            f"paragraph.' || {NL2} || {data}")


def annotation_prompt_sql(name: str, data: str) -> str:
    return (f"'The abstracts below mention ' || {name} || '. Name its part in {PROCESS} in a single sentence; add nothing that "
            f"they do not say.' || {NL2} || {data}")


def process_prompt_sql(lines: str) -> str:
    return (f"'Topic: {PROCESS}. Every line below sums up one gene. Tell how the genes that matter to the topic work together, "
            f"and say how each might act.' || {NL2} || {lines}")


ORACLE["prompt_chunk"] = q(f"SELECT doc_id, {lit(CHUNK_SAYS)} || {NL2} || text AS prompt FROM documents")
_NAMED = """, named AS (SELECT a.row_ord, a.text, coalesce(g.symbol, CAST(a.gene_id AS VARCHAR)) AS gene
  FROM annotations a LEFT JOIN genes g ON g.gene_id = a.gene_id)"""
ORACLE["prompt_annotation"] = q(_NAMED + f"\nSELECT row_ord, {annotation_prompt_sql('gene', 'text')} AS prompt FROM named")
ORACLE["prompt_gene_summary"] = q(_NAMED + f"\nSELECT row_ord, {gene_prompt_sql('gene', 'text')} AS prompt FROM named")
_LINE = "'Gene ' || gene || ': ' || text"
ORACLE["prompt_process"] = q(_NAMED + f"\nSELECT row_ord, {process_prompt_sql(_LINE)} AS prompt FROM named")

ORACLE["parse_pairs"] = q("""
SELECT answer_id, CASE WHEN answer_id % 3 < 2 THEN substr(raw, 1, 7) END AS enzyme, CASE WHEN answer_id % 3 < 2 THEN substr(raw, 8, 7) END AS substrate,
  CASE WHEN answer_id % 3 < 2 THEN 'ok' ELSE 'bad_json' END AS status FROM model_answers
UNION ALL SELECT answer_id, substr(raw, 1, 7), substr(raw, 8, 7), 'ok' FROM model_answers WHERE answer_id % 3 = 0""")


ORACLE["infer_lead"] = q(ART_OK_SQL + f"""
SELECT pmid, {lead_sql(f"({lit(ARTICLE_SAYS)} || {NL2} || article)")} AS response, 'ok' AS status FROM art""")

ORACLE["distill"] = q(GENE_TEXT_SQL + f"""
SELECT gene_id, n_tokens, kind, rounds, distilled, 'ok' AS status FROM {distill_sql('gene_joined', 'gene_id', 'joined', *GENE)}""")

_MX2, _SIZE2 = P.TWO_ROUNDS[0], P.TWO_ROUNDS[1] - PREFIX
ORACLE["distill_two_rounds"] = q(GENE_TEXT_SQL + f""", r1 AS {distill_sql('gene_joined', 'gene_id', 'joined', _MX2, _SIZE2)},
t1 AS (SELECT *, len(regexp_extract_all(distilled, {TOKRE}, 0)) AS now FROM r1),
again AS (SELECT gene_id, distilled FROM t1 WHERE kind = 'chunk' AND now > {_MX2} AND now < n_tokens),
r2 AS {distill_sql('again', 'gene_id', 'distilled', _MX2, _SIZE2)},
t2 AS (SELECT t1.gene_id, t1.n_tokens, t1.kind,
         CAST(CASE WHEN r2.gene_id IS NULL THEN t1.rounds ELSE 2 END AS INTEGER) AS rounds, coalesce(r2.distilled, t1.distilled) AS distilled
       FROM t1 LEFT JOIN r2 ON r2.gene_id = t1.gene_id)
SELECT *, CASE WHEN rounds > 0 AND len(regexp_extract_all(distilled, {TOKRE}, 0)) > {_MX2} THEN 'over_budget' ELSE 'ok' END AS status FROM t2""")


def _articles_sql(instr: str, fences: bool) -> str:
    summ = lead_sql(f"({instr} || {NL2} || d.distilled)")
    if fences:
        summ = (f"array_to_string(list_filter(string_split({summ}, chr(10)), "
                f"lambda l: NOT starts_with(l, '```') AND NOT ends_with(l, '```')), chr(10))")
    return q(ART_OK_SQL + f"""
SELECT l.pmid, l.status, {summ} AS summary
FROM lookup l LEFT JOIN {distill_sql('art', 'pmid', 'article', *ARTICLE)} d ON d.pmid = l.pmid""")


ORACLE["summarize_articles"] = _articles_sql(lit(ARTICLE_SAYS), False)
ORACLE["article_task"] = _articles_sql(lit(TASK_SAYS), True)


def summaries_sql(members: str, extra: str | None = None) -> str:
    """CTEs m (token, gene_id), gsum (gene_id, gene_name, n_texts, summary) for the tokens of ``members``."""
    texts = "SELECT gene_id, row_ord, text FROM gene_text WHERE gene_id IN (SELECT gene_id FROM m)"
    if extra:
        texts += f"\n    UNION ALL SELECT gene_id, {1 << 62} AS row_ord, {punct_sql('text')} FROM {extra} WHERE length(text) > 0"
    return f""", m AS (SELECT DISTINCT token, gene_id FROM {resolve_tokens_sql(f'(SELECT DISTINCT token FROM {members})', 'token')}),
gene_text AS (SELECT gene_id, row_ord, {punct_sql('text')} AS text FROM human WHERE length(text) > 0),
mtexts AS ({texts}),
mjoined AS (SELECT gene_id, count(*) AS n_texts, string_agg(text, ' ' ORDER BY row_ord) AS joined FROM mtexts GROUP BY gene_id),
gdist AS {distill_sql('mjoined', 'gene_id', 'joined', *GENE)},
gsum AS (SELECT d.gene_id, g.symbol AS gene_name, j.n_texts,
           {lead_sql(gene_prompt_sql('coalesce(g.symbol, CAST(d.gene_id AS VARCHAR))', 'd.distilled'))} AS summary
         FROM gdist d JOIN mjoined j ON j.gene_id = d.gene_id LEFT JOIN genes g ON g.gene_id = d.gene_id),
msum AS (SELECT m.token, m.gene_id, s.gene_name, CAST(coalesce(s.n_texts, 0) AS BIGINT) AS n_texts, s.summary,
           CASE WHEN m.gene_id IS NULL THEN 'unresolved' WHEN s.summary IS NULL THEN 'no_text' ELSE 'ok' END AS status
         FROM m LEFT JOIN gsum s ON s.gene_id = m.gene_id)"""


ORACLE["summarize_genes"] = q(summaries_sql("gene_list") + "\nSELECT token, gene_id, gene_name, n_texts, summary, status FROM msum")


def narrative_sql(group_sel: str, group_by: str, members: str) -> str:
    line = "'Gene ' || coalesce(s.gene_name, s.token) || ': ' || s.summary"
    return f"""
SELECT {group_sel} n_genes, {lead_sql(process_prompt_sql('lines'))} AS narrative, 'ok' AS status FROM (
  SELECT {group_by} count(*) AS n_genes, string_agg({line}, chr(10) ORDER BY mb.pos) AS lines
  FROM {members} mb JOIN msum s ON s.token = mb.token WHERE s.summary IS NOT NULL {'GROUP BY ' + group_by.rstrip(', ') if group_by else ''})"""


ORACLE["process_narrative"] = q(summaries_sql("(SELECT symbol AS token FROM gene_sets)")
                                + narrative_sql("gene_set,", "mb.gene_set,",
                                                "(SELECT gene_set, pos, symbol AS token FROM gene_sets)"))

CREATE_SQL = TOPK_SQL + f""", syn_dist AS {distill_sql('(SELECT * FROM gene_abs WHERE gene_id IN (SELECT gene_id FROM ids))', 'gene_id', 'abstracts', *GENE)},
syn AS (SELECT d.gene_id, g.symbol AS gene_name,
          {first_sentence_sql(lead_sql(annotation_prompt_sql('coalesce(g.symbol, CAST(d.gene_id AS VARCHAR))', 'd.distilled')))} AS synthetic
        FROM syn_dist d LEFT JOIN genes g ON g.gene_id = d.gene_id)"""

ORACLE["create_annotations"] = q(", ids AS (SELECT DISTINCT gene_id FROM human)" + CREATE_SQL
                                 + """
SELECT i.gene_id, g.symbol AS gene_name, s.synthetic, CASE WHEN s.gene_id IS NULL THEN 'no_abstracts' ELSE 'ok' END AS status
FROM (SELECT gene_id FROM ids UNION SELECT gene_id FROM genes WHERE gene_id > 1000) i
LEFT JOIN syn s ON s.gene_id = i.gene_id LEFT JOIN genes g ON g.gene_id = i.gene_id""")

ORACLE["synthetic_pairs"] = q(PAIRS_SQL + f""", pd AS {distill_sql('pairs_in', 'row_ord', 'abstracts', *PAIR)}
SELECT p.row_ord, p.gene_id, p.gene_name, p.ground_truth,
  {first_sentence_sql(lead_sql(annotation_prompt_sql('p.gene_name', 'd.distilled')))} AS synthetic, 'ok' AS status
FROM pairs_in p JOIN pd d ON d.row_ord = p.row_ord""")

ORACLE["genes_to_process"] = q(
    f", ids AS (SELECT DISTINCT gene_id FROM {resolve_tokens_sql('(SELECT DISTINCT token FROM gene_list)', 'token')} WHERE gene_id IS NOT NULL)"
    + CREATE_SQL
    + summaries_sql("gene_list", "(SELECT gene_id, synthetic AS text FROM syn WHERE synthetic IS NOT NULL)")
    + narrative_sql("", "", "gene_list"))

WORDS_SQL = r"""regexp_extract_all(lower(text), '[^\s.,;:!?()"'']+', 0)"""
BUCKET_SQL = f"CAST(CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {P.EMBED_DIM} AS BIGINT)"


def vec_checks_sql(src: str, key: str) -> str:
    return f"""(SELECT {key}, CAST(count(*) AS BIGINT) AS n_nonzero, CAST(sum(bucket) AS BIGINT) AS idx_sum,
     CAST(arg_max(bucket, cnt * 100000 - bucket) AS BIGINT) AS top_bucket, true AS unit_norm
   FROM (SELECT {key}, bucket, count(*) AS cnt FROM
           (SELECT {key}, {BUCKET_SQL} AS bucket FROM (SELECT {key}, unnest({WORDS_SQL}) AS w FROM {src}))
         GROUP BY ALL) GROUP BY {key})"""


ORACLE["embed_hash"] = q(f"""
SELECT d.doc_id, CAST(len({WORDS_SQL.replace('text', 'd.text')}) AS BIGINT) AS n_words,
  coalesce(v.n_nonzero, 0) AS n_nonzero, coalesce(v.idx_sum, 0) AS idx_sum, v.top_bucket,
  coalesce(v.unit_norm, false) AS unit_norm
FROM documents d LEFT JOIN {vec_checks_sql('documents', 'doc_id')} v ON v.doc_id = d.doc_id""")

ORACLE["index_rows"] = q(f"""
SELECT coalesce(g.symbol, CAST(h.gene_id AS VARCHAR)) || '-gt-' || CAST(row_number() OVER (PARTITION BY h.gene_id ORDER BY h.row_ord) AS VARCHAR) AS key,
  h.gene_id, g.symbol AS gene_name,
  CAST(row_number() OVER (PARTITION BY h.gene_id ORDER BY h.row_ord) AS BIGINT) AS idx,
  'ground_truth' AS type, h.text, CAST({P.EMBED_DIM} AS BIGINT) AS dim, coalesce(v.n_nonzero, 0) AS n_nonzero
FROM human h LEFT JOIN genes g ON g.gene_id = h.gene_id
LEFT JOIN {vec_checks_sql('(SELECT row_ord, text FROM human)', 'row_ord')} v ON v.row_ord = h.row_ord""")


ORACLE["embed_gene"] = q(f"""
SELECT h.gene_id, CAST(row_number() OVER (ORDER BY h.row_ord) AS BIGINT) AS idx, h.text, coalesce(v.n_nonzero, 0) AS n_nonzero,
  coalesce(v.idx_sum, 0) AS idx_sum, v.top_bucket, coalesce(v.unit_norm, false) AS unit_norm
FROM human h LEFT JOIN {vec_checks_sql('(SELECT row_ord, text FROM human)', 'row_ord')} v ON v.row_ord = h.row_ord
WHERE h.gene_id = {P.GENE_ID} AND length(h.text) > 0""")


# --- sinks -------------------------------------------------------------------------

ORACLE["pairs_tsv"] = q(PAIRS_SQL + f""", pd AS {distill_sql('pairs_in', 'row_ord', 'abstracts', *PAIR)}
SELECT p.gene_id,
  regexp_replace(p.gene_name, '[\\t\\r\\n]+', ' ', 'g') AS gene_name,
  regexp_replace(p.ground_truth, '[\\t\\r\\n]+', ' ', 'g') AS ground_truth,
  regexp_replace({first_sentence_sql(lead_sql(annotation_prompt_sql('p.gene_name', 'd.distilled')))}, '[\\t\\r\\n]+', ' ', 'g') AS synthetic
FROM pairs_in p JOIN pd d ON d.row_ord = p.row_ord""")

ORACLE["summaries_checkpoint"] = ORACLE["genes_to_process"]

ORACLE["index_table"] = ORACLE["index_rows"]
ORACLE["index_upsert"] = ORACLE["index_rows"]

ORACLE["annotation_tsv_ingest"] = q("""SELECT tax_id, gene_id, pmid_list, CAST(len(pmids) AS BIGINT) AS n_pmids,
  CAST(row_ord AS VARCHAR) AS source_row, regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g') AS text,
  CAST(row_number() OVER (ORDER BY row_ord) AS BIGINT) AS file_row, true AS in_order FROM annotations""")

ORACLE["annotation_rejects"] = q("""SELECT CASE WHEN row_ord % 7 = 2 THEN 'fields' ELSE 'gene_id' END AS reason,
  CAST(tax_id AS VARCHAR) || chr(9) || CASE WHEN row_ord % 5 = 1 THEN 'gene ' ELSE '' END || CAST(gene_id AS VARCHAR) || chr(9) || pmid_list || chr(9)
    || CAST(row_ord AS VARCHAR) || CASE WHEN row_ord % 7 = 2 THEN '' ELSE chr(9) || regexp_replace(substr(text, 1, 60), '[\\t\\r\\n]+', ' ', 'g') END AS line
FROM annotations WHERE row_ord % 7 = 2 OR row_ord % 5 = 1""")

ORACLE["infer_resumable"] = ORACLE["infer_lead"]


def _fixed_sql(src: str, key: str) -> str:
    """(key, bucket, v): components of the hashed unit vectors, as integers in 1/32768."""
    return f"""(SELECT {key}, bucket, CAST(floor(CAST(CAST(cnt / sqrt(CAST(sum(cnt * cnt) OVER (PARTITION BY {key}) AS DOUBLE)) AS FLOAT) AS DOUBLE) * 32768) AS BIGINT) AS v
  FROM (SELECT {key}, bucket, count(*) AS cnt FROM
          (SELECT {key}, {BUCKET_SQL} AS bucket FROM (SELECT {key}, unnest({WORDS_SQL}) AS w FROM {src})) GROUP BY ALL))"""


ORACLE["index_topk"] = q(f""", idx AS (
  SELECT row_ord, h.gene_id, CAST(row_number() OVER (PARTITION BY h.gene_id ORDER BY h.row_ord) AS BIGINT) AS idx,
         coalesce(g.symbol, CAST(h.gene_id AS VARCHAR)) || '-gt-' || CAST(row_number() OVER (PARTITION BY h.gene_id ORDER BY h.row_ord) AS VARCHAR) AS key
  FROM human h LEFT JOIN genes g ON g.gene_id = h.gene_id),
common AS (
  SELECT a.answer_id, x.row_ord, CAST(sum(a.v * x.v) AS BIGINT) AS score
  FROM {_fixed_sql('(SELECT answer_id, raw AS text FROM model_answers)', 'answer_id')} a
  JOIN {_fixed_sql('(SELECT row_ord, text FROM human)', 'row_ord')} x ON x.bucket = a.bucket GROUP BY ALL),
every AS (
  SELECT m.answer_id, i.key, i.gene_id, i.idx, coalesce(c.score, 0) AS score
  FROM model_answers m CROSS JOIN idx i LEFT JOIN common c ON c.answer_id = m.answer_id AND c.row_ord = i.row_ord)
SELECT answer_id AS query_id, CAST(n AS INTEGER) AS rank, key, gene_id, idx, score FROM (
  SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY score DESC, key, gene_id, idx) AS n FROM every)
WHERE n <= {P.NEAREST}""")


_TERM = r"""regexp_extract_all(lower({0}), '[^\s.,;:!?()"'']+', 0)"""
ORACLE["summarize_freq"] = q(ART_OK_SQL + rf""", n AS (
  SELECT word, count(*) AS n FROM (SELECT unnest({_TERM.format('text')}) AS word FROM abstracts) GROUP BY word),
terms AS (SELECT word, CAST(floor(CAST(n AS DOUBLE) / CAST((SELECT sum(n) FROM n) AS DOUBLE) * 1000000000) AS BIGINT) AS v FROM n),
cut AS (SELECT pmid, regexp_extract_all(article, '[^.!?]*[.!?]+', 0) AS pieces FROM art),
sent AS (SELECT pmid, i AS s, pieces[i + 1] AS piece FROM (SELECT pmid, pieces, unnest(range(len(pieces))) AS i FROM cut)),
w AS (SELECT pmid, s, word, count(*) AS c FROM (SELECT pmid, s, unnest({_TERM.format('piece')}) AS word FROM sent) GROUP BY ALL),
first AS (SELECT w.pmid, w.s, w.word, w.c, coalesce(t.v, 0) AS v FROM w LEFT JOIN terms t ON t.word = w.word),
pick1 AS (SELECT pmid, s FROM (SELECT pmid, s, row_number() OVER (PARTITION BY pmid ORDER BY score DESC, s) AS n FROM (
    SELECT pmid, s, CAST(sum(v * c) AS BIGINT) // CAST(sum(c) AS BIGINT) AS score FROM first GROUP BY ALL)) WHERE n = 1),
said AS (SELECT f.pmid, f.word FROM first f JOIN pick1 p ON p.pmid = f.pmid AND p.s = f.s),
second AS (SELECT f.pmid, f.s, f.c, CASE WHEN x.word IS NULL THEN f.v ELSE f.v * f.v // 1000000000 END AS v
  FROM first f LEFT JOIN said x ON x.pmid = f.pmid AND x.word = f.word),
pick2 AS (SELECT pmid, s FROM (SELECT pmid, s, row_number() OVER (PARTITION BY pmid ORDER BY score DESC, s) AS n FROM (
    SELECT k.pmid, k.s, CAST(sum(k.v * k.c) AS BIGINT) // CAST(sum(k.c) AS BIGINT) AS score
    FROM second k LEFT JOIN pick1 p ON p.pmid = k.pmid AND p.s = k.s WHERE p.s IS NULL GROUP BY ALL)) WHERE n = 1),
told AS (SELECT s.pmid, string_agg(s.piece, '' ORDER BY s.s) AS told FROM sent s
  JOIN (SELECT * FROM pick1 UNION ALL SELECT * FROM pick2) p ON p.pmid = s.pmid AND p.s = s.s GROUP BY s.pmid)
SELECT a.pmid, {strip_sql("coalesce(t.told, a.article)")} AS response, 'ok' AS status FROM art a LEFT JOIN told t ON t.pmid = a.pmid""")


# Strict articles: the tokens of the markup folded with a stack of open elements ('name|1 in a default namespace|,prefixes,').
_XNAME = r"[A-Za-z_:\x{C0}-\x{10FFFF}][A-Za-z0-9_:.\x{B7}\x{C0}-\x{10FFFF}-]*"
_XATT = rf"""\s+({_XNAME})\s*=\s*(?:"[^<"]*"|''[^<'']*'')"""
_XTOKEN = (r"<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>|<\?(?s:.*?)\?>|<!DOCTYPE(?:[^<>\[]|\[[^\]]*\])*>"
           rf"""|</({_XNAME})\s*>|<{_XNAME}(?:\s+{_XNAME}\s*=\s*(?:"[^<"]*"|''[^<'']*''))*\s*/?>|<|[^<]+""")
_XREF = "&(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"
_XTOP = "coalesce(s.stack[-1], '|0|,xml,')"
_XKEPT = f"CASE WHEN s.taking AND s.txt <> '' THEN list_append(s.kept, {strip_sql('s.txt')}) ELSE s.kept END"


def _xstate(**changed: str) -> str:
    return "{" + ", ".join(f"'{k}': {changed.get(k, 's.' + k)}" for k in ("stack", "taking", "txt", "kept", "rooted", "bad")) + "}"


def _xbad(why: str) -> str:
    return _xstate(bad=f"CAST('{why}' AS VARCHAR)")


_XDECODED = ("array_to_string(list_transform(regexp_extract_all(t, '&[^;]*;|[^&]+', 0), lambda x: CASE x WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' "
             "WHEN '&amp;' THEN '&' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN '''' ELSE CASE WHEN starts_with(x, '&#x') THEN chr(CAST('0x' || x[4:-2] AS INTEGER)) "
             "WHEN starts_with(x, '&#') THEN chr(CAST(x[3:-2] AS INTEGER)) ELSE x END END), '')")
_XUNKNOWN = "contains(regexp_replace(t, '" + _XREF + "', '', 'g'), '&')"
_XNAMES = f"regexp_extract_all(t, '{_XATT}', 1)"
_XOWN = f"regexp_extract(t, '^<({_XNAME})', 1)"
_XSPACE = rf"""CASE WHEN regexp_matches(t, '\sxmlns\s*=\s*(""|'''')') THEN '0' WHEN regexp_matches(t, '\sxmlns\s*=') THEN '1' ELSE split_part({_XTOP}, '|', 2) END"""
_XPREFIXES = f"(split_part({_XTOP}, '|', 3) || array_to_string(list_transform(list_filter({_XNAMES}, lambda x: starts_with(x, 'xmlns:')), lambda x: x[7:] || ','), ''))"
_XSTART = f"""CASE WHEN s.rooted AND len(s.stack) = 0 THEN {_xbad('junk after the root')}
  WHEN len(list_distinct({_XNAMES})) < len({_XNAMES}) THEN {_xbad('duplicate attribute')}
  WHEN len(list_filter(list_append({_XNAMES}, {_XOWN}), lambda x: contains(x, ':') AND NOT starts_with(x, 'xmlns:')
         AND NOT contains({_XPREFIXES}, ',' || split_part(x, ':', 1) || ','))) > 0 THEN {_xbad('unbound prefix')}
  WHEN {_XUNKNOWN} THEN {_xbad('unknown entity')}
  ELSE {_xstate(stack=f"CASE WHEN ends_with(t, '/>') THEN s.stack ELSE list_append(s.stack, {_XOWN} || '|' || {_XSPACE} || '|' || {_XPREFIXES}) END",
                taking=f"(len(s.stack) > 0 AND NOT ends_with(t, '/>') AND ({_XSPACE}) = '0' AND {_XOWN} IN ('title', 'p', 'sec'))",
                txt="''", kept=_XKEPT, rooted="true")} END"""
_XSTEP = f"""CASE WHEN s.bad IS NOT NULL THEN s
  WHEN starts_with(t, '<!--') THEN CASE WHEN contains(t[5:-4], '--') OR ends_with(t[5:-4], '-') THEN {_xbad('-- in a comment')} ELSE s END
  WHEN starts_with(t, '<![CDATA[') THEN CASE WHEN len(s.stack) = 0 THEN {_xbad('text outside the root')}
    ELSE {_xstate(txt="CASE WHEN s.taking THEN s.txt || t[10:-4] ELSE s.txt END")} END
  WHEN starts_with(t, '<?') THEN CASE WHEN regexp_matches(t, '^<.(?i:xml)[^A-Za-z0-9_.:-]') THEN {_xbad('misplaced declaration')} ELSE s END
  WHEN starts_with(t, '<!DOCTYPE') THEN CASE WHEN s.rooted THEN {_xbad('misplaced document type')} ELSE s END
  WHEN starts_with(t, '</') THEN CASE WHEN len(s.stack) = 0 OR split_part(s.stack[-1], '|', 1) <> regexp_extract(t, '</({_XNAME})\\s*>', 1) THEN {_xbad('mismatched tag')}
    ELSE {_xstate(stack="s.stack[1:len(s.stack) - 1]", taking="false", txt="''", kept=_XKEPT)} END
  WHEN t = '<' THEN {_xbad('not well-formed')}
  WHEN starts_with(t, '<') THEN {_XSTART}
  WHEN len(s.stack) = 0 THEN CASE WHEN {strip_sql('t')} = '' THEN s ELSE {_xbad('text outside the root')} END
  WHEN {_XUNKNOWN} THEN {_xbad('unknown entity')}
  WHEN contains(t, ']]>') THEN {_xbad('not well-formed')}
  WHEN s.taking THEN {_xstate(txt=f"s.txt || {_XDECODED}")} ELSE s END"""
_XINIT = "{'stack': CAST([] AS VARCHAR[]), 'taking': false, 'txt': '', 'kept': CAST([] AS VARCHAR[]), 'rooted': false, 'bad': CAST(NULL AS VARCHAR)}"
_XBODY = strip_sql(r"regexp_replace(body, '\r(?:\n)?', chr(10), 'g')")
ORACLE["article_tree"] = q(rf""", x AS (SELECT doc_id, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS t FROM documents),
y AS (SELECT doc_id, split_part(t, chr(10), 1) AS first, replace(t, chr(10), '</p><p>') AS rest FROM x),
raw AS (SELECT doc_id AS pmcid, CASE doc_id % 6
    WHEN 0 THEN '<article><title>' || first || '</title><sec><p>' || rest || '</p></sec></article>'
    WHEN 1 THEN '<article xmlns:m="u"><m:p>' || first || '</m:p><p>' || rest || '<b>x</b>tail</p></article>'
    WHEN 2 THEN '<article><p>' || rest || '</article>'
    WHEN 3 THEN '<article><p><![CDATA[' || first || ']]>' || rest || '</p><p/></article>'
    WHEN 4 THEN '<article><sec xmlns="u"><p>' || first || '</p></sec><!-- c --><p> ' || rest || ' </p></article>'
    ELSE '<article><p>' || first || '&#233;&x;</p></article>' END AS body FROM y
  UNION ALL SELECT -pmcid - 1, body FROM articles),
bodies AS (SELECT pmcid, body, regexp_replace({_XBODY}, '^<\?xml\s(?s:.*?)\?>', '') AS b FROM raw),
read AS (SELECT pmcid, CASE WHEN regexp_matches(body, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]') THEN 'no character of XML' END AS no,
  CASE WHEN b = '' THEN {_XINIT} ELSE list_reduce(regexp_extract_all(b, '{_XTOKEN}', 0), lambda s, t: {_XSTEP}, {_XINIT}) END AS r FROM bodies),
judged AS (SELECT pmcid, r.kept AS kept, coalesce(no, r.bad, CASE WHEN len(r.stack) > 0 THEN 'element not closed' WHEN NOT r.rooted THEN 'no element' END) AS bad FROM read)
SELECT pmcid, CASE WHEN bad IS NULL THEN 'ok' ELSE 'parse_error' END AS status, bad AS error,
  CASE WHEN bad IS NULL THEN CAST(len(kept) AS BIGINT) END AS n_segments, CASE WHEN bad IS NULL THEN array_to_string(kept, {NL2}) END AS article FROM judged""")

# Greedy longest match: alternatives in the order of their length; the text is joined first and cut then.
_VOCABULARY = """, often AS (SELECT w AS token FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{1,5}', 0)) AS w FROM documents)
  GROUP BY w ORDER BY count(*) DESC, w LIMIT 1000),
longest AS (SELECT string_agg(token, '|' ORDER BY length(token) DESC, token) || '|(?s:.)' AS rx
  FROM (SELECT token FROM often UNION ALL SELECT ' ' || token FROM often))"""
_SMX, _SSIZE = P.SUBWORD_BUDGET
ORACLE["chunk_gene_subword"] = q(_VOCABULARY + f""", gene_text AS (
  SELECT gene_id, row_ord, {punct_sql('text')} AS text FROM human WHERE length(text) > 0),
joined AS (SELECT gene_id, string_agg(regexp_replace(text, '^\\s+', ''), ' ' ORDER BY row_ord) AS joined FROM gene_text GROUP BY gene_id),
cut AS (SELECT gene_id, joined, regexp_extract_all(joined, (SELECT rx FROM longest), 0) AS k FROM joined)
SELECT gene_id, CAST(0 AS BIGINT) AS chunk_idx, CAST(1 AS BIGINT) AS n_chunks, 'pass' AS kind, CAST(len(k) AS BIGINT) AS n_tokens, joined AS chunk_text
FROM cut WHERE len(k) <= {_SMX}
UNION ALL
SELECT gene_id, CAST(i AS BIGINT), CAST(ceil(len(k) / {_SSIZE}) AS BIGINT), 'chunk', CAST(len(k) AS BIGINT), array_to_string(k[i * {_SSIZE} + 1 : i * {_SSIZE} + {_SSIZE}], '')
FROM (SELECT *, unnest(range(CAST(ceil(len(k) / {_SSIZE}) AS BIGINT))) AS i FROM cut WHERE len(k) > {_SMX})""")
