"""Deterministic providers, native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.arrays import counted, let
from loam.functions.text import words
from loam.functions.vectors import set_overlap

DIMENSION = 64


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """Counts of a text's words by the first 8 hex digits of their MD5 modulo ``dimension``, as doubles."""
    buckets = F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dimension)

    def histogram(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at(found, i.cast("bigint")), F.lit(0.0)))

    return let(F.map_from_entries(F.transform(counted(buckets), lambda x: F.struct(x["v"], x["n"].cast("double")))), histogram)


def table_embeddings(rows: DataFrame, vectors: DataFrame, *on: str) -> DataFrame:
    """Adds ``embedding`` from a table keyed by ``on``; rows without a vector keep null."""
    return rows.join(vectors.select(*on, F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), list(on), "left")


def word_set(text: Column) -> Column:
    """A text's words in lower case, each once."""
    return F.array_distinct(words(F.lower(text)))


def word_overlap_score(a: Column, b: Column) -> Column:
    """Share of common words: a stand-in for a reranker, in [0, 1]."""
    return set_overlap(word_set(a), word_set(b))


def vector_problems(vectors: DataFrame, dimension: int) -> DataFrame:
    """Rows whose vector is missing or has another size."""
    return vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dimension))
