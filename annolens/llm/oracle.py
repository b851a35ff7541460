"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

# The chat template in SQL: a text is escaped if it holds a control string or does not read back as it is.
_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ')"
_READ = r"replace(replace(replace({0}, '##\# ', '### '), '<\/turn>', '</turn>'), '\\', '\')"

OP3_CHAT = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
drawn AS (
  SELECT *, replace({_ESCAPED.format("role")}, ':', '<\\.>') AS shown,
         CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR {_READ.format("text")} <> text
              THEN {_ESCAPED.format("text")} ELSE text END AS body
  FROM every)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || shown || ': ' || body || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM drawn GROUP BY conv_id
"""

OP7_TOPK = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""

# CRC-32 of a text's bytes, by the table of the polynomial.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t)"


def _crc32(text: str, table: str) -> str:
    return f"""xor(4294967295, list_reduce(list_transform(range(strlen({text})), lambda i: CAST('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2] AS BIGINT)),
      lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)))"""


OP11_RUNS = f"""
WITH given AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o, {_crc32("CAST(doc_id AS VARCHAR)", "t")} AS h
  FROM documents, {_CRC_TABLE}),
cut AS (SELECT *, len(o) AS n, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM given),
words AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(o[1:a], list_transform(range(n - a), lambda i: o[a + i % (1 + (n - a) // (3 + (h // 10) % 8)) + 1])) ELSE o END AS w
  FROM cut),
grams AS (SELECT r, n, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT r, n, w, unnest(range(n - 4)) AS i FROM words WHERE n > 5)),
pairs AS (SELECT x.r, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k),
long AS MATERIALIZED (SELECT * FROM stretches WHERE l >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT * FROM long a WHERE NOT EXISTS (
  SELECT 1 FROM long b WHERE b.r = a.r AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS text
  FROM (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM words) x LEFT JOIN gone g ON g.r = x.r AND g.i = x.i WHERE g.i IS NULL GROUP BY x.r),
told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    first({{'s': s, 'l': l, 'q': q}} ORDER BY l DESC, s, q) AS best FROM runs GROUP BY r)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM words w LEFT JOIN told t ON t.r = w.r LEFT JOIN kept k ON k.r = w.r
"""

OP13_VARIANTS = f"""
WITH RECURSIVE found AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (SELECT run, k, {_crc32("(doc_id || ':' || run)", "t")} AS h FROM found, {_CRC_TABLE}),
cut AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (SELECT word, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS v FROM places),
less AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM places),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM masked a JOIN masked b ON a.v = b.v AND a.word <> b.word
  UNION SELECT w.word, l.word FROM words w JOIN less l ON l.v = w.word
  UNION SELECT l.word, w.word FROM words w JOIN less l ON l.v = w.word),
best AS (SELECT r.word, count(*) AS n_near, first(r.other ORDER BY o.n DESC, r.other) AS other, max(o.n) AS other_n FROM near r JOIN words o ON o.word = r.other GROUP BY r.word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at WHERE e.form IS NULL
"""

ORACLE: dict[str, str] = {
    "op3_chat": OP3_CHAT,
    "op7_topk": OP7_TOPK,
    "op11_runs": OP11_RUNS,
    "op13_variants": OP13_VARIANTS,
}
