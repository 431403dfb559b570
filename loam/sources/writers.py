"""Chunk rows as plain text, JSON arrays, JSON lines and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_object() -> Column:
    return F.struct(F.col("idx").alias("index"), "text", "offset", "length")


def json_lines(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, value): one JSON object for each chunk."""
    return chunks.select(key, "idx", F.to_json(chunk_object()).alias("value"))


def json_arrays(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value): {"chunks": [...], "count": n} for each document."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", chunk_object().alias("c")))), lambda x: x["c"])
    return chunks.groupBy(key).agg(F.to_json(F.struct(listed.alias("chunks"), F.count(F.lit(1)).alias("count"))).alias("value"))


def write_plain(chunks: DataFrame, path: str) -> None:
    """Texts, each followed by a newline."""
    chunks.sortWithinPartitions("doc_id", "idx").select("text").write.text(path)


def write_jsonl(chunks: DataFrame, path: str, key: str = "doc_id") -> None:
    chunks.select(key, F.col("idx").alias("index"), "text", "offset", "length").write.json(path)


def write_partitioned(chunks: DataFrame, path: str, *columns: str) -> None:
    """Parquet laid out by columns that readers filter on, such as lang or source."""
    chunks.write.partitionBy(*columns).parquet(path)


def signal_lines(signals: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, boundary_idx, line): tab-separated scores with four decimals."""
    four = [F.format_string("%.4f", F.col(c)) for c in ("sim", "entity", "discourse", "heading", "struct", "orphan", "shift", "budget", "join_score")]
    return signals.select(key, "boundary_idx", F.concat_ws("\t", F.col("boundary_idx").cast("string"), *four).alias("line"))


def curve_lines(curves: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, i, line): raw and smoothed value of a curve with six decimals."""
    both = curves.select(key, F.posexplode(F.arrays_zip("curve", "smoothed")).alias("i", "x"))
    six = lambda c: F.format_string("%.6f", c)
    return both.select(key, "i", F.concat_ws("\t", F.col("i").cast("string"), six(F.col("x.curve")), six(F.col("x.smoothed"))).alias("line"))


def rows_as_json(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value): each row's columns as one JSON object; nulls are left out."""
    return rows.select(key, F.to_json(F.struct("*")).alias("value"))


def signals_as_json(signals: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value): boundary scores rounded half away from zero to four decimals, with reasons."""
    scores = [F.round(c, 4).alias(c) for c in ("sim", "entity", "relation", "discourse", "heading", "struct", "orphan", "shift", "budget", "join_score")]
    return signals.select(key, F.to_json(F.struct("boundary_idx", *scores, "reasons")).alias("value"))


#: Columns of the methods' outputs under the names they have in JSON.
JSON_NAMES = {"idx": "index", "dominant": "dominant_entities", "tokens": "token_estimate", "confidence": "continuity_confidence", "prev_idx": "prev_chunk", "next_idx": "next_chunk", "intent_idx": "best_intent", "alignment": "alignment_score"}
JSON_ORDER = (
    "idx", "text", "offset_start", "offset_end", "length", "heading_path", "dominant", "dominant_relations", "tokens", "confidence", "synopsis", "prev_idx", "next_idx",
    "intent_idx", "alignment", "section_classification", "cross_references", "title", "summary", "keywords", "typed_entities", "hypothetical_questions", "semantic_keys", "category",
)


def method_json(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, value): each chunk of a scored method as one JSON object, fields in a fixed order; nulls and empty
    relations are left out."""
    rows = chunks.withColumnRenamed("part", "idx") if "part" in chunks.columns else chunks
    if "length" not in rows.columns:
        rows = rows.withColumn("length", F.octet_length("text"))
    if "dominant_relations" in rows.columns:
        rows = rows.withColumn("dominant_relations", F.when(F.size("dominant_relations") > 0, F.col("dominant_relations")))
    fields = [F.col(c).alias(JSON_NAMES.get(c, c)) for c in JSON_ORDER if c in rows.columns]
    return rows.select(key, "idx", F.to_json(F.struct(*fields)).alias("value"))


def graph_json(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value): the graph of each document as one JSON object with nodes, edges and metadata."""
    node = F.struct("id", "text", "offset_start", "offset_end", "heading_path", F.col("dominant").alias("dominant_entities"), F.col("tokens").alias("token_estimate"), F.col("confidence").alias("continuity_confidence"))
    edge = F.struct("source", "target", F.col("type").alias("edge_type"), "entity")
    made = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", node.alias("n")))).alias("ns"))
    linked = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source", "target", F.col("type"), "entity", edge.alias("e")))).alias("es"))
    meta = metadata.select(key, F.struct("chunk_count", "edge_count", "shared_entity_count", "block_count").alias("metadata"))
    all_ = made.join(linked, key, "left").join(meta, key)
    listed = lambda c, f: F.transform(F.col(c), lambda x: x[f])
    none = F.array().cast("array<struct<source:int,target:int,edge_type:string,entity:string>>")
    return all_.select(key, F.to_json(F.struct(listed("ns", "n").alias("nodes"), F.coalesce(listed("es", "e"), none).alias("edges"), "metadata")).alias("value"))


def stats_line(chunks: DataFrame) -> DataFrame:
    """One row of counts, sizes and averages over all chunks: bytes and words."""
    words = F.regexp_count("text", F.lit(r"[^\p{IsWhite_Space}]+"))
    sized = chunks.select(F.octet_length("text").alias("b"), words.alias("w"))
    whole = lambda c: F.expr(f"sum({c}) div count(1)")
    return sized.agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("b").alias("bytes"), F.sum("w").alias("tokens"), whole("b").alias("avg_bytes"), F.min("b").alias("min_bytes"),
        F.max("b").alias("max_bytes"), whole("w").alias("avg_tokens"), F.min("w").alias("min_tokens"), F.max("w").alias("max_tokens"),
    )
