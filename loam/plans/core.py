"""Queries of splitting, chunking, merging, sinks and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import word_tokens
from loam.operators import chunking, merging, splitting


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


SPLIT_SQL = """
WITH pieces AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ps FROM documents),
rows AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS i FROM pieces),
placed AS (SELECT doc_id, i, text, coalesce(sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM rows)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS idx, text, pos::INT AS "offset", strlen(text)::INT AS length
FROM placed {where}
"""
PREV, NEXT, NONE = r"[^\n.?]*[\n.?]|[^\n.?]+", r"[\n.?][^\n.?]*|[^\n.?]+", r"[^\n.?]+|[\n.?]"


def split_prev(spark, sf_dir):
    return splitting.split(docs(spark, sf_dir))


def split_next(spark, sf_dir):
    return splitting.split(docs(spark, sf_dir), attach="next")


def split_none(spark, sf_dir):
    return splitting.split(docs(spark, sf_dir), attach="none")


MIN_SQL = f"""
WITH RECURSIVE pieces AS (SELECT doc_id, regexp_extract_all(text, '{PREV}') AS ps FROM documents WHERE doc_id % 10 = 0),
fold AS (
  SELECT doc_id, ps, 1 AS i, ps[1] AS acc, 0 AS pos, NULL::VARCHAR AS done, 0 AS done_at FROM pieces WHERE len(ps) > 0
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN strlen(acc) < 120 OR strlen(ps[i + 1]) < 120 THEN acc || ps[i + 1] ELSE ps[i + 1] END,
    CASE WHEN strlen(acc) < 120 OR strlen(ps[i + 1]) < 120 THEN pos ELSE pos + strlen(acc) END,
    CASE WHEN strlen(acc) < 120 OR strlen(ps[i + 1]) < 120 THEN NULL ELSE acc END, pos
  FROM fold WHERE i < len(ps)
), out AS (
  SELECT doc_id, done AS text, done_at AS pos FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, acc, pos FROM fold WHERE i = len(ps)
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS idx, text, pos::INT AS "offset", strlen(text)::INT AS length FROM out
""".replace(" WHERE doc_id % 10 = 0", "")


def split_min_bytes(spark, sf_dir):
    return splitting.split(docs(spark, sf_dir), min_bytes=120)


PATTERNS = [". ", "\n", ", "]
PATTERN_SQL = SPLIT_SQL.format(pattern=r"(?s)(?:.*?(?:\. |\n|, ))|(?:.+$)", where="WHERE text <> ''")


def split_patterns(spark, sf_dir):
    return splitting.split_patterns(docs(spark, sf_dir), PATTERNS)


MERGE_CTE = f"""
WITH RECURSIVE pieces AS (
  SELECT doc_id, ps, list_transform(ps, lambda p: len(regexp_extract_all(p, '\\S+'))) AS ns
  FROM (SELECT doc_id, regexp_extract_all(text, '{PREV}') AS ps FROM documents) WHERE len(ps) > 0
), fold AS (
  SELECT doc_id, 1 AS i, len(ns) AS n, ns, 0 AS g, ns[1] AS used FROM pieces
  UNION ALL
  SELECT doc_id, i + 1, n, ns, CASE WHEN used + ns[i + 1] <= 64 THEN g ELSE g + 1 END,
    CASE WHEN used + ns[i + 1] <= 64 THEN used + ns[i + 1] ELSE ns[i + 1] END
  FROM fold WHERE i < n
), chunks AS (
  SELECT f.doc_id, f.g AS idx, string_agg(p.ps[f.i], '' ORDER BY f.i) AS text, min(f.i) AS lead FROM fold f JOIN pieces p USING (doc_id) GROUP BY f.doc_id, f.g
), placed AS (
  SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS "offset" FROM chunks
)
"""
MERGE_SQL = MERGE_CTE + r"""SELECT doc_id, idx::INT AS idx, text, "offset", strlen(text)::INT AS length, len(regexp_extract_all(text, '\S+'))::INT AS tokens FROM placed"""


def merge_tokens(spark, sf_dir):
    return merging.merge(docs(spark, sf_dir), splitting.split_spans(F.col("text")), 64)


def merge_conversations(spark, sf_dir):
    """Turns of a conversation packed into chunks of up to 120 words."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    counts = F.transform(F.col("t.text"), word_tokens)
    result = merging.merge_splits(F.col("t.text"), counts, 120)
    return turns.select("conv_id", result.alias("m")).select("conv_id", F.posexplode(F.arrays_zip("m.merged", "m.token_counts")).alias("idx", "x")).select(
        "conv_id", "idx", F.col("x.merged").alias("text"), F.col("x.token_counts").alias("tokens")
    )


CONVERSATION_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, list(text ORDER BY turn) AS ps, list(len(regexp_extract_all(text, '\S+')) ORDER BY turn) AS ns FROM conversations GROUP BY conv_id
), fold AS (
  SELECT conv_id, ps, ns, 1 AS i, 0 AS g, ns[1] AS used FROM t
  UNION ALL
  SELECT conv_id, ps, ns, i + 1, CASE WHEN used + ns[i + 1] <= 120 THEN g ELSE g + 1 END,
    CASE WHEN used + ns[i + 1] <= 120 THEN used + ns[i + 1] ELSE ns[i + 1] END FROM fold WHERE i < len(ns)
)
SELECT conv_id, g::INT AS idx, string_agg(ps[i], '' ORDER BY i) AS text, sum(ns[i])::BIGINT AS tokens FROM fold GROUP BY conv_id, g
"""


def merge_indices(spark, sf_dir):
    """Exclusive ends of the runs of line items whose quantities stay within 60, per order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x")
    )
    counts = F.transform(F.col("x.l_quantity"), lambda q: q.cast("int"))
    return lines.select("l_orderkey", F.array_join(merging.merge_indices(counts, 60).cast("array<string>"), ",").alias("ends"))


INDICES_SQL = """
WITH RECURSIVE t AS (
  SELECT l_orderkey, list(l_quantity::INT ORDER BY l_linenumber, l_partkey, l_quantity) AS ns FROM lineitem GROUP BY l_orderkey
), fold AS (
  SELECT l_orderkey, ns, 1 AS i, 0 AS g, ns[1] AS used FROM t
  UNION ALL
  SELECT l_orderkey, ns, i + 1, CASE WHEN used + ns[i + 1] <= 60 THEN g ELSE g + 1 END,
    CASE WHEN used + ns[i + 1] <= 60 THEN used + ns[i + 1] ELSE ns[i + 1] END FROM fold WHERE i < len(ns)
), ends AS (SELECT l_orderkey, g, max(i) AS e FROM fold GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(e::VARCHAR, ',' ORDER BY g) AS ends FROM ends GROUP BY l_orderkey
"""


def chunk_stats(spark, sf_dir):
    """Chunks, bytes and words of the packed chunks per document; averages are whole numbers."""
    rows = merge_tokens(spark, sf_dir)
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("bytes"), F.min("length").alias("min_bytes"), F.max("length").alias("max_bytes"),
        F.expr("sum(length) div count(1)").alias("avg_bytes"), F.sum("tokens").alias("words"), F.min("tokens").alias("min_words"),
        F.max("tokens").alias("max_words"), F.expr("sum(tokens) div count(1)").alias("avg_words"),
    )


STATS_SQL = MERGE_CTE + r"""
SELECT doc_id, count(*) AS chunks, sum(l)::BIGINT AS bytes, min(l) AS min_bytes, max(l) AS max_bytes, (sum(l) // count(*))::BIGINT AS avg_bytes,
  sum(w)::BIGINT AS words, min(w) AS min_words, max(w) AS max_words, (sum(w) // count(*))::BIGINT AS avg_words
FROM (SELECT doc_id, strlen(text)::INT AS l, len(regexp_extract_all(text, '\S+'))::INT AS w FROM placed) GROUP BY doc_id
"""


def corpus_rollup(spark, sf_dir):
    """Chunks and words by language and source with subtotals."""
    sized = merge_tokens(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id")
    return sized.rollup("lang", "source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("words"))


ROLLUP_SQL = MERGE_CTE + r"""
SELECT lang, source, count(*) AS chunks, sum(len(regexp_extract_all(p.text, '\S+')))::BIGINT AS words
FROM placed p JOIN documents d ON p.doc_id = d.doc_id GROUP BY ROLLUP (lang, source)
"""


def size_limit(spark, sf_dir):
    """Documents that a limit of 4 KiB lets through, and the others."""
    from loam.sources.readers import within_limit

    kept, rejected = within_limit(docs(spark, sf_dir), 4096)
    return kept.select("doc_id", F.octet_length("text").alias("bytes"), F.lit(True).alias("kept")).union(
        rejected.select("doc_id", F.octet_length("text").alias("bytes"), F.lit(False).alias("kept"))
    )


def _chunk_sql(pieces, hit, wide, size, cut, keep="true"):
    """Chunks by a walk over the byte places of all delimiters: ``h`` is the last one within reach, ``f`` the first beyond."""
    return rf"""
WITH RECURSIVE whole AS (SELECT doc_id, text, strlen(text) AS n, regexp_extract_all(text, '{pieces}') AS ps FROM documents WHERE text <> ''),
each AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM whole),
ended AS (SELECT doc_id, piece, sum(strlen(piece)) OVER w AS e, lag(piece) OVER w AS prev FROM each WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT doc_id, list(e - {wide} ORDER BY e) AS hs FROM ended WHERE {hit} AND {keep} GROUP BY doc_id),
src AS (SELECT w.doc_id, hex(text) AS hx, n, coalesce(hs, []) AS hs FROM whole w LEFT JOIN hits h ON w.doc_id = h.doc_id),
walk AS (
  SELECT doc_id, n, hs, -1 AS idx, 0::BIGINT AS a, 0::BIGINT AS b FROM src
  UNION ALL
  SELECT doc_id, n, hs, idx + 1, b, CASE WHEN n - b <= {size} THEN n {cut} END
  FROM (SELECT *, list_max(list_filter(hs, lambda p: p > b AND p <= b + {size - wide})) AS h, list_min(list_filter(hs, lambda p: p >= b + {size})) AS f FROM walk WHERE b < n)
)
SELECT k.doc_id, idx::INT AS idx, md5(substring(hx, 2 * a + 1, 2 * (b - a))) AS md5, a::INT AS "offset", (b - a)::INT AS length
FROM walk k JOIN src s ON k.doc_id = s.doc_id WHERE idx >= 0
"""


ENDS = "right(piece, 1) IN (chr(10), '.', '?')"
AFTER, BEFORE = "WHEN h IS NOT NULL THEN h + {0} ELSE b + 500", "WHEN h IS NOT NULL THEN h ELSE b + 500"


def _chunks(spark, sf_dir, size, **options):
    """Chunks of all documents by the bytes they hold: a cut may part a character."""
    rows = chunking.chunk(docs(spark, sf_dir), size, as_bytes=True, **options)
    return rows.select("doc_id", "idx", F.md5(F.hex("text")).alias("md5"), "offset", "length")


def chunk_suffix(spark, sf_dir):
    return _chunks(spark, sf_dir, 500)


def chunk_prefix(spark, sf_dir):
    return _chunks(spark, sf_dir, 500, prefix=True)


def chunk_pattern(spark, sf_dir):
    return _chunks(spark, sf_dir, 500, pattern=". ", prefix=True)


def chunk_hard(spark, sf_dir):
    return _chunks(spark, sf_dir, 500, delimiters="")


def chunk_fallback(spark, sf_dir):
    return _chunks(spark, sf_dir, 40, delimiters="\n", prefix=True, forward_fallback=True)


def chunk_consecutive(spark, sf_dir):
    return _chunks(spark, sf_dir, 500, consecutive=True, prefix=True)


def chunk_bytes_kept(spark, sf_dir):
    """Bytes of each document and of its chunks: equal, and chunks touch."""
    d = docs(spark, sf_dir)
    rows = chunking.chunk(d, 300)
    return rows.groupBy("doc_id").agg(F.sum("length").alias("bytes"), F.max(F.col("offset") + F.col("length")).alias("end"))


def jsonl_rows(spark, sf_dir):
    from loam.sources.writers import json_lines

    return json_lines(merge_tokens(spark, sf_dir))


JSONL_SQL = MERGE_CTE + r"""SELECT doc_id, idx::INT AS idx, to_json({'index': idx::INT, 'text': text, 'offset': "offset", 'length': strlen(text)::INT})::VARCHAR AS value FROM placed"""

QUERIES = {
    f.__name__: f
    for f in (
        split_prev, split_next, split_none, split_min_bytes, split_patterns, merge_tokens, merge_conversations, merge_indices, chunk_stats,
        corpus_rollup, size_limit, chunk_suffix, chunk_prefix, chunk_pattern, chunk_hard, chunk_fallback, chunk_consecutive, chunk_bytes_kept, jsonl_rows,
    )
}
ORACLES = {
    "split_prev": SPLIT_SQL.format(pattern=PREV, where=""),
    "split_next": SPLIT_SQL.format(pattern=NEXT, where=""),
    "split_none": SPLIT_SQL.format(pattern=NONE, where=r"WHERE NOT regexp_full_match(text, '[\n.?]')"),
    "split_min_bytes": MIN_SQL,
    "split_patterns": PATTERN_SQL,
    "merge_tokens": MERGE_SQL,
    "merge_conversations": CONVERSATION_SQL,
    "merge_indices": INDICES_SQL,
    "chunk_stats": STATS_SQL,
    "corpus_rollup": ROLLUP_SQL,
    "size_limit": "SELECT doc_id, strlen(text)::INT AS bytes, strlen(text) <= 4096 AS kept FROM documents",
    "chunk_suffix": _chunk_sql(PREV, ENDS, 1, 500, AFTER.format(1)),
    "chunk_prefix": _chunk_sql(PREV, ENDS, 1, 500, BEFORE),
    "chunk_pattern": _chunk_sql(r"(?s)(?:.*?\. )|(?:.+$)", "right(piece, 2) = '. '", 2, 500, BEFORE),
    "chunk_hard": _chunk_sql(PREV, "false", 1, 500, "ELSE b + 500"),
    "chunk_fallback": _chunk_sql(r"[^\n]*[\n]|[^\n]+", "right(piece, 1) = chr(10)", 1, 40, "WHEN h IS NOT NULL THEN h WHEN f IS NOT NULL THEN f ELSE n"),
    "chunk_consecutive": _chunk_sql(PREV, ENDS, 1, 500, BEFORE, "NOT coalesce(strlen(piece) = 1 AND right(prev, 1) = piece, false)"),
    "chunk_bytes_kept": "SELECT doc_id, strlen(text)::BIGINT AS bytes, strlen(text)::INT AS \"end\" FROM documents WHERE text <> ''",
    "jsonl_rows": JSONL_SQL,
}
