"""Line dedup with a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: first by its number of tokens, then by its leading tokens, where a token
that holds a digit counts as variable. The lines of a leaf share those; in the other places a token is constant if
it stands there ``min_docs`` times, where each different line counts once for each document that has it, and variable
otherwise. A line's template is its constant tokens with ``<*>`` for the variable ones. Where more than
``1 - similarity`` of the places would be variable the line is its own template. Templates that occur in ``min_docs``
different documents or more are dropped from all of them; how often one document repeats a template does not matter.

Counting goes over different lines, not over all: a line's documents are counted first, and only leaves that reach
``min_docs`` are taken apart into tokens. All counts are aggregates with map-side combining; a line is compared with
counts, never with other lines. What is joined to hot leaves, lines and templates is written first, so that the joins
are of two plain exchanges and adaptive execution can split them. Lines stay in their documents: what is dropped
returns to a document as a list of hashes of its own lines.

Defined results: a null text stays null with 0 lines; an empty text has one empty line; blank lines are never dropped;
a very long text or line counts whole; of a tie (equally many constant places as ``similarity`` asks for) the template
is generalised; repeated rows of one doc_id count as one document and each is cleaned; rows without a doc_id count as
one document together; an empty table gives an empty result; other columns pass through unread, but for old ``n_lines``
and ``n_dropped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.store import discard, written

DEPTH, SIMILARITY, MIN_DOCS = 3, 0.7, 3
SPACE = r"[\x20\x09-\x0D]+"
#: What stands for a missing doc_id where documents are counted.
NO_ID = -(2**63)


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _tokens(line: Column) -> Column:
    """Tokens of a line, numbers masked: what holds a digit is variable."""
    return F.transform(F.split(F.btrim(line, F.lit(" \t\r\x0b\x0c")), SPACE), lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, line): hashes of the lines of each document whose template recurs."""
    lines_of = F.array_distinct(F.split("text", "\n"))
    each = docs.select("doc_id", F.explode(lines_of).alias("text_line")).where(~F.col("text_line").rlike(r"^[\x20\x09-\x0D]*$"))
    # Leaf of the tree: token count and leading tokens. Only hashes are exchanged here; the table is read four times.
    hashed = each.withColumn("tokens", _tokens(F.col("text_line"))).select(
        "doc_id", line_hash(F.col("text_line")).alias("line"), F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf")
    )
    occurrences = written(hashed.distinct(), "lines")
    # A leaf needs min_docs documents at all: most lines of running prose go here.
    known = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    busy = written(occurrences.groupBy("leaf").agg(F.count_distinct(known).alias("n")).where(F.col("n") >= min_docs).select("leaf"), "busy-leaves")
    alive = written(occurrences.join(busy, "leaf"), "alive-lines")
    discard(occurrences, busy)
    lines = alive.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("rep"))
    # A line's text comes from one document that has it.
    wanted = lines.groupBy("rep").agg(F.collect_set("line").alias("wanted"))
    holders = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("wanted", lines_of.alias("ls"))
    texts = holders.select(F.explode(F.filter("ls", lambda x: F.array_contains("wanted", line_hash(x)))).alias("text_line"))
    texts = texts.groupBy(line_hash(F.col("text_line")).alias("line")).agg(F.first("text_line").alias("text_line"))
    split = lines.join(texts, "line").select("leaf", "line", "docs", _tokens(F.col("text_line")).alias("tokens"))
    words = split.select("leaf", "line", "docs", F.posexplode("tokens").alias("place", "token"))
    common = words.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).drop("n")
    marked = words.join(common.withColumn("constant", F.lit(True)), ["leaf", "place", "token"], "left")
    constant = (F.col("place") < depth) | F.coalesce("constant", F.lit(False))
    generalised = marked.groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("place", F.when(constant, F.col("token")).otherwise(F.lit("<*>")).alias("token")))).alias("parts")
    ).select("leaf", "line", F.col("parts.token").alias("parts"))
    kept = F.size(F.filter("parts", lambda t: t != "<*>"))
    template = F.when(kept >= similarity * F.size("parts"), F.xxhash64("leaf", "parts")).otherwise(F.xxhash64("leaf", "line", F.lit("own")))
    templates = written(generalised.select("line", template.alias("template")), "line-templates")
    named = written(alive.select("doc_id", "line").join(templates, "line"), "named-lines")
    discard(alive, templates)
    often = written(
        named.select("template", "doc_id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template"), "often-templates"
    )
    return named.join(often, "template").select("doc_id", "line")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the recurring lines gone from ``text``, plus ``n_lines`` and ``n_dropped``."""
    dropped = recurring_lines(docs.select("doc_id", "text"), min_docs, depth, similarity)
    lists = dropped.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__dropped"))
    lines = F.split("text", "\n")
    stays = F.filter(lines, lambda x: F.col("__dropped").isNull() | ~F.array_contains("__dropped", line_hash(x)))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.withColumn("__stays", stays).select(
        *[c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.array_join("__stays", "\n").alias("text"), n.alias("n_lines"),
        (n - F.when(F.col("text").isNull(), 0).otherwise(F.size("__stays"))).alias("n_dropped"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    return drop_recurring_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
