"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects the same number of copies: the source's target divided by its
size. Within a source the documents stand in a fixed order, the expected copies are summed along it
from one random offset, and a document is taken once for each integer its interval crosses.

The order is by size class, then by a hashed cell, then by size, so that each stretch of it holds
documents of like size and the words taken stay close to the target. A source is never gathered:
ranks come from counts per (source, size class, cell) plus a rank inside one cell, and each size class
has one cell for ``CELL_ROWS`` of its rows. Words are counted once, in a first pass that writes a few numbers
per row; where whole rows are asked for they are read a second time and exchanged once.

Defined results: a null or empty text has size 0 and takes 0 words; a very long text counts whole; a null source is a
source of its own, sorted last; a null doc_id draws its place by its text; ties go by doc_id, then by a hash of the
text; repeated rows are separate documents; an empty table gives an empty result; columns other than ``doc_id``,
``text``, ``source`` come along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.store import discard, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows that one cell, ranked by one task, holds on average.
CELL_ROWS = 20_000
SIZE_CLASSES_PER_DOUBLING = 4


def hash_unit(value: Column, seed: int) -> Column:
    """A number in [0, 1) from MD5, the same on every engine that has MD5."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("\0")))), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(16**12))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets of (source, source_size): the total is shared by weight, no source above cap times its size.

    Filling by weight stops sources in the order of cap * size / weight. With the first k stopped, the
    rest share what is left; k is the least for which none of the rest would be above its cap. One row
    per source is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position + 1)
    weighed = sources.select("source", "source_size", weight.alias("weight"))
    room = F.lit(float(cap)) * F.col("source_size")
    order = Window.orderBy((room / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = weighed.select("*", room.alias("room"), level.alias("level"), F.row_number().over(order).alias("k"))
    stop = F.min(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("k"))).over(everything)
    shared = F.max(F.when(F.col("k") == F.col("stop"), F.col("level"))).over(everything)
    target = F.when(F.col("k") < F.col("stop"), F.col("room")).otherwise(
        F.least(F.col("room"), F.col("weight") * F.col("shared"))
    )
    return filled.withColumn("stop", stop).withColumn("shared", shared).select("source", "source_size", target.alias("target"))


def measured(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """(doc_id, mix_key, size, size_class, draw, tie) of each row and ``more``. ``mix_key`` is the source, never null."""
    id_, source = F.col("doc_id").cast("string"), F.col("source")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("mix_key"), word_count(F.col("text")).alias("size"),
        hash_unit(F.coalesce(id_, F.concat(F.lit("\0"), F.md5(text))), seed + 1).alias("draw"), F.xxhash64(text).alias("tie"), *more,
    )
    return sized.withColumn("size_class", F.ceil(F.log2(F.col("size") + 1.0) * SIZE_CLASSES_PER_DOUBLING).cast("int"))


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 42, cell_rows: int = CELL_ROWS, whole_rows: bool = True
) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies) of every row of ``docs``; ``row`` holds all its columns and is
    left out unless ``whole_rows``."""
    narrow = written(measured(docs, seed), "mix-sizes")
    classes = narrow.groupBy("mix_key", "size_class").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "mix-classes")  # a row for each source and size class
    source = F.when(F.col("mix_key") != "n", F.substr("mix_key", F.lit(2)))
    per_source = classes.groupBy("mix_key").agg(F.sum("bytes").alias("source_size")).select(source.alias("source"), "source_size")
    targets = source_targets(per_source, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    plan = classes.join(targets.select(key.alias("mix_key"), "source_size", "target", rate.alias("rate"), hash_unit(F.col("source"), seed).alias("offset")), "mix_key").select(
        "mix_key", "size_class", "source_size", "target", "rate", "offset", F.greatest(F.lit(1.0), F.ceil(F.col("n") / F.lit(float(cell_rows)))).alias("cells")
    )
    plan = written(plan, "mix-plan")
    in_cells = lambda df: df.join(plan, ["mix_key", "size_class"]).withColumn("cell", F.floor(F.col("draw") * F.col("cells")).cast("int"))
    cell = ["mix_key", "size_class", "cell"]
    counts = in_cells(narrow).groupBy(*cell).agg(F.count(F.lit(1)).alias("in_cell"))
    before = Window.partitionBy("mix_key").orderBy("size_class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select(*cell, F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("ahead")), "mix-starts")
    placed = in_cells(measured(docs, seed, F.struct("*").alias("row")) if whole_rows else narrow)
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "draw", "doc_id", "tie")) + F.col("ahead")
    crossed = lambda r: F.floor(F.col("offset") + F.col("rate") * r)
    copies = F.least(F.lit(cap), crossed(F.col("rank")) - crossed(F.col("rank") - 1)).cast("int")
    ranked = placed.join(starts, cell).withColumn("rank", rank.cast("double"))
    discard(classes)
    return ranked.select(*["row"] * whole_rows, "doc_id", "size", "source_size", "target", copies.alias("copies"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mix: each document's columns once for each copy taken."""
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.where("copies > 0").select("row", each.alias("copy")).select("row.*")


def mixing_digest(docs: DataFrame) -> DataFrame:
    return mix_sources(docs.select("doc_id", "text", "source"), whole_rows=False).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), src AS (
  SELECT source, sum(size) AS source_size, count(*) AS n_rows FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] :: DOUBLE AS weight,
         3.0::DOUBLE * source_size AS room FROM src
), filled AS (
  SELECT *, row_number() OVER w AS k,
         (sum(source_size) OVER () - coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY room / weight, source NULLS LAST)
), stopped AS (
  SELECT *, min(CASE WHEN level * weight <= room THEN k END) OVER () AS stop FROM filled
), targets AS (
  SELECT source, source_size, n_rows,
         CASE WHEN k < stop THEN room ELSE least(room, weight * max(CASE WHEN k = stop THEN level END) OVER ()) END AS target
  FROM stopped
), placed AS (
  SELECT s.doc_id, s.size, t.source, t.source_size::BIGINT AS source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(3.0, t.target / t.source_size) ELSE 0 END AS rate,
         ('0x' || md5('42:' || coalesce(t.source, chr(0)))[1:12])::BIGINT / 281474976710656.0::DOUBLE AS offs,
         ('0x' || md5('43:' || coalesce(s.doc_id::VARCHAR, chr(0) || md5(coalesce(s.text, ''))))[1:12])::BIGINT / 281474976710656.0::DOUBLE AS draw,
         ceil(log2(s.size + 1.0::DOUBLE) * 4)::INT AS size_class
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), celled AS (
  SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY source, size_class) / 20000.0)) AS cells FROM placed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, floor(draw * cells), size, draw, doc_id) AS r FROM celled
), taken AS (
  SELECT *, least(3, floor(offs + rate * r) - floor(offs + rate * (r - 1)))::INT AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM taken
"""
