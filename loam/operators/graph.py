"""The graph of a document's chunks: neighbours, and chunks that share an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.cognitive import shared_entities


def nodes(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.select(key, F.col("idx").alias("id"), "text", "offset_start", "offset_end", "heading_path", "dominant", "tokens", "confidence")


def edges(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, target, type, entity): adjacency, and a link between consecutive chunks of each shared entity."""
    w = Window.partitionBy(key).orderBy("idx")
    near = chunks.select(key, F.col("idx").alias("source"), F.lead("idx").over(w).alias("target")).where("target is not null")
    near = near.select(key, "source", "target", F.lit("adjacency").alias("type"), F.lit(None).cast("string").alias("entity"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("chunks") - 1), lambda i: F.struct(F.element_at("chunks", i).alias("source"), F.element_at("chunks", i + 1).alias("target")))
    linked = shared_entities(chunks, key).select(key, "entity", F.explode(pairs).alias("p")).select(key, F.col("p.source").alias("source"), F.col("p.target").alias("target"), F.lit("entity_link").alias("type"), "entity")
    return near.unionByName(linked)


def metadata(chunks: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers of chunks, edges, shared entities and blocks per document."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    out = count(chunks, "chunk_count").join(count(blocks, "block_count"), key)
    out = out.join(count(edges(chunks, key), "edge_count"), key, "left").join(count(shared_entities(chunks, key), "shared_entity_count"), key, "left")
    return out.fillna(0, ["edge_count", "shared_entity_count"])
