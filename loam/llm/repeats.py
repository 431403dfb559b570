"""What the two substring operators share: winnowed anchors, classes of equal surroundings, spans per document.

A document row is known by (``d``, ``th``): its doc_id, where null ranks with the largest number, and a hash of its
text. Rows that agree in both are repeats of each other and get the same result; their spans are listed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.spans import SpanHasher, Texts, ranges, text_batches, winnow
from loam.llm.store import discard, written

LAST_ID = 2**63 - 1
RUNS = "d long, th long, start int, n int, anchor long, seg long"
SPANS = "array<struct<start:int,n:int>>"
#: Bits of the table that says which rows may have spans: 64 in each of its rows, 262,144 at most.
PLACES = 1 << 24


def keyed_docs(docs: DataFrame) -> DataFrame:
    """(d, th, text, doc_id), a null text as the empty one."""
    text, id_ = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(F.coalesce(id_, F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"), id_.alias("doc_id"))


class Units:
    """The elements of a batch of texts, words or bytes, with what hashing spans of them needs."""

    def __init__(self, unit: str, seed: int):
        self.unit, self.bytes_hasher, self.hasher = unit, SpanHasher(seed), SpanHasher(seed + 1)

    def load(self, texts: list[bytes]) -> None:
        self.texts = Texts(texts)
        over_bytes = self.bytes_hasher.prefix_bytes(self.texts.data)
        if self.unit == "bytes":
            self.prefix, self.first, self.last = over_bytes, self.texts.start, self.texts.end
            self.hasher = self.bytes_hasher
        else:
            self.word_start, self.word_end, bound = self.texts.words()
            self.prefix = self.hasher.prefix(self.bytes_hasher.spans(over_bytes, self.word_start, self.word_end))
            self.first, self.last = bound[:-1], bound[1:]


def anchored_runs(keyed: DataFrame, unit: str, k: int, t: int, seed: int = 11) -> DataFrame:
    """Every window of ``t`` units of every text, as runs that share an anchor and so stand in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit, seed)
        for batch in batches:
            d, th = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, _, texts in text_batches(batch):
                units.load(texts)
                owner, start, n, anchor, seg = winnow(units.hasher, units.prefix, units.first, units.last, k, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (d[lo + owner], th[lo + owner], start.astype(np.int32), n.astype(np.int32), anchor.view(np.int64), seg.view(np.int64))],
                    ["d", "th", "start", "n", "anchor", "seg"],
                )

    return keyed.select("d", "th", "text").mapInArrow(run, RUNS)


def with_wanted(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Each document that represents classes, with the list of them. ``classes`` has anchor, seg, weight and rep
    (d, th, start, n)."""
    wanted = classes.groupBy(F.col("rep.d").alias("d"), F.col("rep.th").alias("th")).agg(
        F.collect_list(F.struct("anchor", "seg", "weight", F.col("rep.start").alias("start"), F.col("rep.n").alias("n"))).alias("wanted")
    )
    return keyed.join(wanted, ["d", "th"]).select("text", "wanted")


def wanted_arrays(batch: pa.RecordBatch):
    """Row index and the columns anchor, seg, weight, start, n of all classes wanted in a batch."""
    wanted = batch.column(1)
    owner = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
    return owner, *(wanted.flatten().field(i).to_numpy() for i in range(5))


def class_windows(keyed: DataFrame, classes: DataFrame, unit: str, t: int, seed: int = 29) -> DataFrame:
    """(anchor, seg, weight, j, wh): the hash of every window of every class, taken from one text that has it. Rows
    that repeat the text's doc_id and text repeat its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit, seed)
        for batch in batches:
            owner, anchor, seg, weight, start, n = wanted_arrays(batch)
            for lo, hi, texts in text_batches(batch):
                units.load(texts)
                here = np.flatnonzero((owner >= lo) & (owner < hi))
                rep = np.repeat(here, n[here])
                at = ranges(units.first[owner[here] - lo] + start[here], n[here].astype(np.int64))
                wh = units.hasher.spans(units.prefix, at, at + t)
                j = at - (units.first[owner[rep] - lo] + start[rep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchor[rep], seg[rep], weight[rep], j.astype(np.int32), wh.view(np.int64))],
                    ["anchor", "seg", "weight", "j", "wh"],
                )

    return with_wanted(keyed, classes).mapInArrow(run, "anchor long, seg long, weight long, j int, wh long")


def shared_runs(runs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The runs of ``wanted`` anchors, written. Both sides of the join are plain exchanges, so that adaptive execution
    can split the rows of a hot anchor over many tasks."""
    anchors = written(wanted, f"{name}-anchors")
    shared = written(runs.join(anchors, "anchor"), f"{name}-shared")
    discard(anchors)
    return shared


def spans_per_document(spans: DataFrame, t: int) -> DataFrame:
    """(d, th, spans) out of rows with a list each: the maximal runs (start, n) of windows of ``t`` units that overlap or
    touch. Repeats of a row bring equal lists, which count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, n = span_arrays(batch.column(2))
            order = np.lexsort((start, owner))
            owner, start, end = owner[order], start[order].astype(np.int64), (start + n)[order].astype(np.int64)
            # A running maximum of the ends within each document: owners are made to ascend by a step above all ends.
            step = owner * (int(end.max(initial=0)) + t + 1)
            reach = np.maximum.accumulate(end + step) if len(end) else end
            first = np.ones(len(start), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (start[1:] + step[1:] > reach[:-1] + t - 1)
            at = np.flatnonzero(first)
            last = np.append(at[1:], len(start)) - 1
            starts, size = start[at], (reach[last] - step[last]) - start[at] if len(at) else start[at]
            bound = np.searchsorted(owner[at], np.arange(batch.num_rows + 1)) if len(at) else np.zeros(batch.num_rows + 1, int)
            flat = pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(size.astype(np.int32))], ["start", "n"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), flat)], ["d", "th", "spans"])

    listed = spans.groupBy("d", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return listed.mapInArrow(run, f"d long, th long, spans {SPANS}")


def span_list(*pairs: Column) -> Column:
    return F.array(*[F.struct(pairs[i].cast("int").alias("start"), pairs[i + 1].cast("int").alias("n")) for i in range(0, len(pairs), 2)])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every row of ``docs``."""
    return keyed_docs(docs).join(spans, ["d", "th"], "left").select("doc_id", "text", "spans")


def with_few_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """As ``with_spans``, where most rows have none: those outside a table of ``PLACES`` bits need no exchange.

    Rows that share a bit with a row of ``spans`` are joined in vain; the more of them, the fuller the table."""
    place = F.xxhash64("d", "th").bitwiseAND(F.lit(PLACES - 1))
    bit, at = F.expr("shiftleft(1L, cast(xxhash64(d, th) & 63L AS int))"), F.shiftright(place, 6)
    bits = written(spans.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")), "span-bits")
    keyed = keyed_docs(docs).withColumn("at", at).join(F.broadcast(bits), "at", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    some = keyed.where(may).join(spans, ["d", "th"], "left").select("doc_id", "text", "spans")
    return some.unionByName(keyed.where(~may).select("doc_id", "text", F.lit(None).cast(SPANS).alias("spans")))


def span_arrays(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, start and n of all spans in a column."""
    size = spans.value_lengths().fill_null(0).to_numpy()
    flat = spans.flatten()
    return np.repeat(np.arange(len(spans)), size), flat.field(0).to_numpy(), flat.field(1).to_numpy()
