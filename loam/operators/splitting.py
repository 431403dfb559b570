"""Splitting at every delimiter or pattern."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.arrays import let, running_sums, scan
from loam.functions.text import char_class

SPAN = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("offset", T.IntegerType())]))
ATTACH = ("prev", "next", "none")


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _placed(pieces: Column) -> Column:
    def place(p: Column) -> Column:
        offsets = running_sums(F.transform(p, F.octet_length))
        return F.zip_with(p, offsets, lambda t, o: F.struct(t.alias("text"), o.alias("offset")))

    return let(pieces, place)


def accumulated(spans: Column, text: Column, min_bytes: int) -> Column:
    """Neighbouring spans joined while what is gathered or what comes next is shorter than ``min_bytes``."""
    if min_bytes <= 0:
        return spans
    raw, kind = text.cast("binary"), "struct<a:int,b:int>"
    end = lambda s: s["offset"] + F.octet_length(s["text"])
    held = lambda s, some: F.when(some, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))).otherwise(F.array().cast(f"array<{kind}>"))

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        fresh = s["a"] == s["b"]
        short = (s["b"] - s["a"] < min_bytes) | (F.octet_length(x["text"]) < min_bytes)
        done = ~fresh & ~short
        return {"a": F.when(fresh | done, x["offset"]).otherwise(s["a"]), "b": end(x)}, held(s, done)

    cuts = scan(spans, kind, {"a": F.lit(0), "b": F.lit(0)}, step, lambda out, s: F.concat(out, held(s, s["a"] < s["b"])))
    return F.transform(cuts, lambda c: F.struct(F.make_valid_utf8(F.substring(raw, c["a"] + 1, c["b"] - c["a"]).cast("string")).alias("text"), c["a"].alias("offset")))


def split_spans(text: Column, delimiters: str = "\n.?", attach: str = "prev", min_bytes: int = 0) -> Column:
    """array<struct<text, offset>> of the segments between delimiters. No segment is empty.

    ``attach`` puts a delimiter to the segment before it, after it, or nowhere. Without delimiters the text is one
    segment. Delimiters are bytes: a character beyond ASCII stands for each of its own, see ``byte_split_spans``.
    """
    if attach not in ATTACH:
        raise ValueError(f"attach must be one of {ATTACH}")
    if not delimiters.isascii():
        return byte_split_spans(text, delimiters.encode(), attach, min_bytes)
    if not delimiters:
        whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("offset")))
        return F.when(text != "", whole).otherwise(F.array().cast(SPAN))
    d = char_class(delimiters)
    if attach == "prev":
        spans = _placed(_pieces(text, f"[^{d}]*[{d}]|[^{d}]+"))
    elif attach == "next":
        spans = _placed(_pieces(text, f"[{d}][^{d}]*|[^{d}]+"))
    else:
        spans = F.filter(_placed(_pieces(text, f"[^{d}]+|[{d}]")), lambda s: ~s["text"].rlike(f"^[{d}]$"))
    return accumulated(spans, text, min_bytes)


def cut_bytes(raw: bytes, delimiters: bytes, attach: str = "prev", min_bytes: int = 0) -> list[tuple[int, int]]:
    """The segments [start, end) of a text between single bytes."""
    hit = np.flatnonzero(np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(delimiters, np.uint8)))
    edge = {"prev": hit + 1, "next": hit, "none": np.concatenate([hit, hit + 1])}[attach]
    edge = np.unique(np.concatenate(([0], edge, [len(raw)])))
    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    if attach == "none":
        gone = set(hit.tolist())
        spans = [(a, b) for a, b in spans if a not in gone]
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if min_bytes > 0 and out and (out[-1][1] - out[-1][0] < min_bytes or b - a < min_bytes):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def byte_split_spans(text: Column, delimiters: bytes, attach: str = "prev", min_bytes: int = 0) -> Column:
    """The same at any bytes, in an Arrow function; a character that is cut reads as U+FFFD on both sides."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(column: pa.Array) -> pa.Array:
        rows = [None if x is None else [{"start": a, "end": b} for a, b in cut_bytes(x, delimiters, attach, min_bytes)] for x in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    raw = text.cast("binary")
    return F.transform(spans(raw), lambda s: F.struct(F.make_valid_utf8(F.substring(raw, s["start"] + 1, s["end"] - s["start"]).cast("string")).alias("text"), s["start"].alias("offset")))


def split_pattern_spans(text: Column, patterns: list[str], attach: str = "prev", min_bytes: int = 0) -> Column:
    """The same for patterns of any length; where several begin, the first listed one counts."""
    if attach not in ATTACH:
        raise ValueError(f"attach must be one of {ATTACH}")
    patterns = [p for p in patterns if p]
    if not patterns:
        return split_spans(text, "", attach, min_bytes)
    hit = "|".join(re.escape(p) for p in patterns)
    cut = _placed(_pieces(text, f"(?s:(?:{hit})|(?:(?!{hit}).)+)"))
    is_hit = lambda s: s["text"].isin(patterns)
    if attach == "none":
        spans = F.filter(cut, lambda s: ~is_hit(s))
    elif attach == "prev":
        spans = _placed(_pieces(text, f"(?s:(?:(?!{hit}).)*(?:{hit})|.+?\\z)"))
    else:
        spans = _placed(_pieces(text, f"(?s:(?:{hit})(?:(?!{hit}).)*|(?:(?!{hit}).)+)"))
    return accumulated(spans, text, min_bytes)


def segments(df: DataFrame, spans: Column, *keep: str | Column) -> DataFrame:
    """One row for each span: ``keep``, idx, text, offset, length."""
    return (
        df.select(*keep, F.posexplode(spans).alias("idx", "span"))
        .select(*keep, "idx", F.col("span.text").alias("text"), F.col("span.offset").alias("offset"), F.octet_length("span.text").alias("length"))
    )


def split(df: DataFrame, delimiters: str = "\n.?", attach: str = "prev", min_bytes: int = 0, key: str = "doc_id") -> DataFrame:
    return segments(df, split_spans(F.col("text"), delimiters, attach, min_bytes), key)


def split_patterns(df: DataFrame, patterns: list[str], attach: str = "prev", min_bytes: int = 0, key: str = "doc_id") -> DataFrame:
    return segments(df, split_pattern_spans(F.col("text"), patterns, attach, min_bytes), key)
