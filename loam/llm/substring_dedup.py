"""Substring dedup by seed and extend: repeated passages of 50 words or more are removed from later documents.

Seeds are winnowed: of every window of 50 words the 10-gram of least hash is its anchor, so two equal windows
always share one. Documents join on anchors that occur in two or more of them. The occurrences of an anchor
fall into classes that agree on everything their windows cover; where all agree the whole run is a repeat.
Otherwise each class extends the seed to both sides, word by word within the window's reach, and every
extension to a full window is compared with all other classes at once by its hash, so pairs of documents are never
listed. All documents of a class but its first lose its windows anyway, so only the first one's are looked up. Windows
that start in a document with a smaller doc_id too are then joined to maximal repeats, each at least as long as a
window, and the document loses their words. A bit table of fixed size spares most texts without spans the exchange that
brings the spans to the texts.

Hot anchors, classes and windows meet in aggregates with map-side combining, and in joins of two plain exchanges that
adaptive execution splits.

Defined results: a null or empty text has no words; texts under 50 words lose nothing; of rows that repeat one
doc_id none is "smaller" than the other; a null doc_id ranks with the largest number; two documents that start a
passage alike need no order but that of their ids (ties do not arise otherwise); a text is hashed whole, at about 40
bytes of memory a byte, whatever its length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.repeats import anchored_runs, class_windows, keyed_docs, shared_runs, span_arrays, span_list, spans_per_document, with_few_spans
from loam.llm.spans import Texts, keep_mask, text_batches
from loam.llm.store import discard, written

WINDOW, GRAM = 50, 10


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(d, th, spans): for each document, maximal runs (start, n) of windows that start in an earlier document too."""
    keyed = keyed_docs(docs)
    runs = written(anchored_runs(keyed, "words", gram, window), "substring-runs")
    anchors = runs.groupBy("anchor").agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("seg").alias("s0"), F.max("seg").alias("s1")
    ).where("lo < hi").drop("hi")
    shared = shared_runs(runs, anchors, "substring")
    discard(runs)
    plain = shared.where("s0 = s1 and d > lo").select("d", "th", span_list(F.col("start"), F.col("n")).alias("spans"))
    mixed = shared.where("s0 <> s1").select("d", "th", "start", "n", "anchor", "seg")
    classes = mixed.groupBy("anchor", "seg").agg(F.min(F.struct("d", "th", "start", "n")).alias("rep")).withColumn("weight", F.col("rep.d"))
    classes = written(classes, "substring-classes")
    windows = written(class_windows(keyed, classes, "words", window), "substring-windows")
    # All windows of a class start in its first document, so only that one asks which of them start earlier elsewhere.
    firsts = windows.groupBy("anchor", "wh").agg(F.min("weight").alias("first"), F.max("weight").alias("last"))
    many = written(firsts.where("first < last").drop("last"), "substring-firsts")
    met = windows.join(many, ["anchor", "wh"]).where("first < weight")
    earlier = met.groupBy("anchor", "seg").agg(F.collect_set("j").alias("earlier"))
    extended = written(classes.select("anchor", "seg", "weight").join(earlier, ["anchor", "seg"], "left"), "substring-extended")
    discard(windows, many, classes)
    one = lambda j: F.struct((F.col("start") + j).alias("start"), F.lit(1).alias("n"))
    whole_or_some = F.when(F.col("d") > F.col("weight"), span_list(F.col("start"), F.col("n"))).otherwise(F.transform("earlier", one))
    partly = mixed.join(extended, ["anchor", "seg"]).select("d", "th", whole_or_some.alias("spans"))
    spans = written(spans_per_document(plain.union(partly.where(F.size("spans") > 0)), window), "substring-spans")
    discard(shared, extended)
    return spans


def remove_spans(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): kept words joined by one space."""
    return with_few_spans(docs, spans).mapInArrow(_remover(window, False), "doc_id long, n_words long, n_removed long, kept_text string")


def _remover(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, n = span_arrays(batch.column(2))
            for lo, hi, texts in text_batches(batch):
                all_ = Texts(texts)
                first, last, bound = all_.words()
                a, b = np.searchsorted(owner, [lo, hi])
                keep = keep_mask(len(first), bound[owner[a:b] - lo] + start[a:b], n[a:b] + window - 1)
                n_words, out = np.diff(bound), []
                kept = np.diff(np.append(0, np.cumsum(keep))[bound])
                for i, text in enumerate(texts):
                    if kept[i] == n_words[i]:
                        words = text.split()
                    else:
                        at = np.flatnonzero(keep[bound[i] : bound[i + 1]]) + bound[i]
                        words = [all_.raw[x:y] for x, y in zip(first[at].tolist(), last[at].tolist())]
                    joined = b" ".join(words)
                    out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_words - kept, pa.int64()), pa.array(out, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"],
                )

    return run


def substring_digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return with_few_spans(docs, repeated_spans(docs)).mapInArrow(
        _remover(WINDOW, True), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
