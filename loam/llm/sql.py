"""DuckDB SQL for the queries that SQL can express on whole tables."""

from loam.llm.mixing import SQL as MIXING

#: WARC: base-32 of the SHA-1 digest, five bits at a time out of its binary digits.
WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), nibbles AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i:
      ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
      [1 + instr('0123456789abcdef', hex[i]) - 1]), 'string_agg', '') AS bits FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT
           + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM nibbles
"""

#: Windows of 50 words, each compared as text.
SUBSTRING = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS first FROM starts GROUP BY h HAVING min(doc_id) < max(doc_id)
), covered AS (
  SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 50)) AS k FROM starts s JOIN firsts f USING (h) WHERE f.first < s.doc_id
), removed AS (
  SELECT doc_id, list(k) AS ks FROM covered GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ks IS NULL THEN array_to_string(ws, ' ') ELSE
         coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ks, i)), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN removed r ON w.doc_id = r.doc_id
"""

#: The template tree with the production depth, similarity and number of documents.
LINES = r"""
WITH each AS (
  SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE NOT regexp_matches(line, '^[\x20\x09-\x0D]*$')
), placed AS (
  SELECT doc_id, line, list_transform(regexp_split_to_array(trim(line, chr(32)||chr(9)||chr(13)||chr(11)||chr(12)), '[\x20\x09-\x0D]+'),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS ts FROM each
), leafed AS (
  SELECT *, [len(ts)::VARCHAR] || ts[1:3] AS leaf FROM placed
), busy AS (
  SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 3
), alive AS (
  SELECT l.* FROM leafed l JOIN busy USING (leaf)
), lines AS (
  SELECT leaf, line, any_value(ts) AS ts, count(*) AS docs FROM alive GROUP BY leaf, line
), words AS (
  SELECT leaf, line, docs, unnest(ts) AS token, generate_subscripts(ts, 1) AS place FROM lines
), common AS (
  SELECT leaf, place, token FROM words GROUP BY leaf, place, token HAVING sum(docs) >= 3
), templates AS (
  SELECT w.leaf, w.line, list(CASE WHEN w.place <= 3 OR c.token IS NOT NULL THEN w.token ELSE '<*>' END ORDER BY w.place) AS parts
  FROM words w LEFT JOIN common c ON w.leaf = c.leaf AND w.place = c.place AND w.token = c.token GROUP BY w.leaf, w.line
), named AS (
  SELECT a.doc_id, a.line, CASE WHEN len(list_filter(parts, lambda t: t <> '<*>')) >= 0.7 * len(parts)
    THEN [chr(1)] || a.leaf || parts ELSE [chr(2), a.line] END AS template
  FROM alive a JOIN templates t ON a.line = t.line
), often AS (
  SELECT template FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= 3
), dropped AS (
  SELECT doc_id, list(DISTINCT line) AS ls FROM named JOIN often USING (template) GROUP BY doc_id
), cleaned AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS ls,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(r.ls, x), false)) AS stays
  FROM documents d LEFT JOIN dropped r ON d.doc_id = r.doc_id
)
SELECT doc_id, coalesce(len(ls), 0)::INT AS n_lines, (coalesce(len(ls), 0) - coalesce(len(stays), 0))::INT AS n_dropped,
  CASE WHEN ls IS NULL THEN NULL ELSE sha256(coalesce(array_to_string(stays, chr(10)), '')) END AS kept_sha256
FROM cleaned
"""

SQL = {"op1_mixing": MIXING, "op4_substring_dedup": SUBSTRING, "op6_line_dedup": LINES, "op7_warc": WARC}
