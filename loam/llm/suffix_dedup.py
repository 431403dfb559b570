"""Suffix-array dedup: every byte covered by a 200-byte string that occurs twice in the corpus is removed.

Strings are compared by merging Burrows-Wheeler transforms. The suffixes are first parted by content: a
200-byte string belongs to the bucket of its canonical anchor (its 32-byte gram of least hash), so equal
strings share a bucket and buckets are independent. Within a bucket the stretches around the anchor form a
small collection; equal stretches are held once with their number. Each task cuts its collection into shards,
gives every shard its own suffix order and transform, and merges two transforms at a time: the interleave
starts as "all of the one, then all of the other", and each round reads both transforms in the present order
and deals the entries out stably by symbol, which refines the order by one symbol of context. The symbol stands for
the 25 bytes before the suffix, so 8 rounds reach 200 bytes; no suffix is compared or sorted again. Any fixed order
of symbols gives the same intervals, so symbols are ordered by a 64-bit hash of their bytes. The borders that each
round opens between entries give the common prefix lengths in symbols; runs of entries without a border after 200
bytes are the repeated intervals.

Stretches that agree wholly in all places their anchor occurs form one interval by themselves and need no merge.
A bucket of more than ``BUCKET_CLASSES`` different stretches (one passage in very many surroundings) is not
gathered into a task: its strings are counted by hash with map-side combining.

Defined results: a null text is the empty text; texts under 200 bytes lose nothing; repeated rows are repeats of
each other and lose all their long strings; bytes are removed whatever characters they cut; a null doc_id ranks with
the largest number, which only decides whose copy of a stretch is read; ties do not arise, as all places of a string
are removed; a text is hashed whole, at about 40 bytes of memory a byte; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.repeats import anchored_runs, class_windows, keyed_docs, shared_runs, span_arrays, span_list, spans_per_document, wanted_arrays, with_spans, with_wanted
from loam.llm.spans import SpanHasher, keep_mask, ranges, text_batches
from loam.llm.store import discard, written

DEPTH, GRAM, STEP = 200, 32, 25
#: Different stretches in one bucket that a task takes at most: 3 MB, which merge in about two seconds.
BUCKET_CLASSES = 8_000
#: Bytes of stretches that a task merges at a time.
MERGE_BYTES = 1 << 20
SHARDS = 2


def stable_order(key: np.ndarray) -> np.ndarray:
    """Stable sorting order of integers below 2**32: key and place share one number, which sorts fast."""
    packed = (key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Collection:
    """Strings end to end. Suffixes of one residue class modulo STEP form chains: the suffix STEP bytes earlier."""

    def __init__(self, strings: list[bytes], step: int = STEP):
        self.step = step
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.first = np.cumsum(self.size) - self.size
        # A string starts after a gap of step zero bytes, so the symbol before a suffix never reaches over it.
        pad = b"\0" * step
        data = np.frombuffer(pad + pad.join(strings) + pad, np.uint8)
        self.first = self.first + step * (1 + np.arange(len(strings)))
        hasher = SpanHasher(53)
        # What stands in the step bytes from each place on; past the end reading goes on at the start.
        self.words = hasher.grams(hasher.prefix_bytes(np.concatenate([data, data[: step - 1]])), step)


def suffix_order(rank: np.ndarray, step: int, depth: int) -> np.ndarray:
    """The order of one shard's suffixes, read cyclically, by ``depth`` bytes or more: ranks of step bytes, doubled."""
    n, reach = len(rank), step
    rank = rank.astype(np.int32)
    order = stable_order(rank)
    while reach < depth:
        second = np.roll(rank, -reach)
        order = stable_order(second)
        order = order[stable_order(rank[order])]
        new = np.ones(n, bool)
        a, b = rank[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        reach *= 2
    return order


def transform(rank: np.ndarray, order: np.ndarray, step: int) -> np.ndarray:
    """The shard's transform: for each suffix in order, the rank of the ``step`` bytes before it (cyclic)."""
    return rank[order - step]


def merge(transforms: list[np.ndarray], symbols: int, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of two transforms and where their merged order opens a border within ``depth`` bytes.

    Returns for each merged entry its shard (0 or 1) and a flag: it differs from the entry before it.
    """
    a, b = transforms
    a, b = a.astype(np.int32), b.astype(np.int32)
    shard = np.zeros(len(a) + len(b), bool)
    shard[len(a) :] = True
    block = np.zeros(len(shard), np.int32)
    for _ in range(-(-depth // step)):
        symbol = np.empty(len(shard), np.int32)
        symbol[~shard], symbol[shard] = a, b
        order = stable_order(symbol)
        shard, symbol, block = shard[order], symbol[order], block[order]
        border = np.ones(len(shard), bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(border, dtype=np.int32)
    return shard, border


def repeated_strings(strings: list[bytes], weight: list[int], depth: int = DEPTH, step: int = STEP) -> list[np.ndarray]:
    """For each string a flag per window start: its ``depth`` bytes stand in the strings at least twice by weight."""
    parts = [list(range(i, len(strings), SHARDS)) for i in range(SHARDS)]
    shards = [Collection([strings[i] for i in part], step) for part in parts]
    distinct, rank = np.unique(np.concatenate([s.words for s in shards]), return_inverse=True)
    ranks = np.split(rank, [len(shards[0].words)])
    orders = [suffix_order(r, step, depth) for r in ranks]
    shard, border = merge([transform(r, o, step) for r, o in zip(ranks, orders)], len(distinct), step, depth)
    # The weight of each suffix that starts a whole window, in merged order.
    counts = []
    for s, part in zip(shards, parts):
        own = np.zeros(len(s.words), np.int64)
        n = np.maximum(s.size - depth + 1, 0)
        own[ranges(s.first, n)] = np.repeat(np.array([weight[i] for i in part], np.int64), n)
        counts.append(own)
    merged = np.empty(len(shard), np.int64)
    for k in range(SHARDS):
        merged[shard == k] = counts[k][orders[k]]
    total = np.add.reduceat(merged, np.flatnonzero(border)) if len(merged) else merged
    often = (total >= 2)[np.cumsum(border) - 1]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(strings)
    for k, (s, part) in enumerate(zip(shards, parts)):
        flag = np.zeros(len(s.words), bool)
        flag[orders[k]] = often[shard == k]
        for i, first, size in zip(part, s.first.tolist(), s.size.tolist()):
            out[i] = flag[first : first + max(0, size - depth + 1)]
    return out


def class_bytes(keyed: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """(anchor, seg, weight, stretch): the bytes of every class, taken from one text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, anchor, seg, weight, start, n = wanted_arrays(batch)
            for lo, hi, texts in text_batches(batch):
                here = np.flatnonzero((owner >= lo) & (owner < hi))
                cut = [texts[o - lo][s : s + m + depth - 1] for o, s, m in zip(owner[here].tolist(), start[here].tolist(), n[here].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[here]), pa.array(seg[here]), pa.array(weight[here]), pa.array(cut, pa.binary())],
                    ["anchor", "seg", "weight", "stretch"],
                )

    return with_wanted(keyed, classes).mapInArrow(run, "anchor long, seg long, weight long, stretch binary")


def merged_spans(stretches: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(anchor, seg, inner): for each class the runs (start, n) of its repeated windows."""

    def flush(anchor: list[int], rows: dict[tuple[int, int], tuple[int, bytes]]) -> pa.RecordBatch:
        flags = repeated_strings([x for _, x in rows.values()], [w for w, _ in rows.values()], depth)
        inner = []
        for flag in flags:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
            inner.append([{"start": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
        keys = list(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(inner, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))],
            ["anchor", "seg", "inner"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], tuple[int, bytes]] = {}
        size, last = 0, None
        for batch in batches:
            for anchor, seg, weight, stretch in zip(*(c.to_pylist() for c in batch.columns)):
                if size > MERGE_BYTES and anchor != last:
                    yield flush([], rows)
                    rows, size = {}, 0
                rows[anchor, seg] = (weight, stretch)  # a document row that occurs twice brings its classes twice
                size, last = size + len(stretch), anchor
        if rows:
            yield flush([], rows)

    sorted_ = stretches.repartition("anchor").sortWithinPartitions("anchor")
    return sorted_.mapInArrow(run, "anchor long, seg long, inner array<struct<start:int,n:int>>")


def counted_spans(windows: DataFrame) -> DataFrame:
    """The same for classes of hot buckets, from the hashes of their windows."""
    often = written(windows.groupBy("anchor", "wh").agg(F.sum("weight").alias("total")).where("total > 1").drop("total"), "suffix-often")
    one = F.struct(F.col("j").alias("start"), F.lit(1).alias("n"))
    return windows.join(often, ["anchor", "wh"]).groupBy("anchor", "seg").agg(F.collect_list(one).alias("inner"))


def repeated_byte_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(d, th, spans): for each document, maximal runs (start, n) of windows that occur elsewhere too."""
    keyed = keyed_docs(docs)
    runs = written(anchored_runs(keyed, "bytes", gram, depth), "suffix-runs")
    anchors = runs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("c"), F.min("seg").alias("s0"), F.max("seg").alias("s1")
    ).where("c > 1").drop("c")
    shared = shared_runs(runs, anchors, "suffix")
    discard(runs)
    plain = shared.where("s0 = s1").select("d", "th", span_list(F.col("start"), F.col("n")).alias("spans"))
    mixed = shared.where("s0 <> s1").select("d", "th", "start", "n", "anchor", "seg")
    classes = written(
        mixed.groupBy("anchor", "seg").agg(F.min(F.struct("d", "th", "start", "n")).alias("rep"), F.count(F.lit(1)).alias("weight")),
        "suffix-classes",
    )
    hot = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_classes")).where(F.col("n_classes") > BUCKET_CLASSES).drop("n_classes"), "suffix-hot")
    merged = merged_spans(class_bytes(keyed, classes.join(hot, "anchor", "left_anti"), depth), depth)
    windows = written(class_windows(keyed, classes.join(hot, "anchor", "left_semi"), "bytes", depth).distinct(), "suffix-windows")
    inner = written(merged.unionByName(counted_spans(windows)).where(F.size("inner") > 0), "suffix-inner")
    discard(windows, classes, hot)
    moved = F.transform("inner", lambda x: F.struct((F.col("start") + x["start"]).alias("start"), x["n"].alias("n")))
    partly = mixed.join(inner, ["anchor", "seg"]).select("d", "th", moved.alias("spans"))
    spans = written(spans_per_document(plain.union(partly), depth), "suffix-spans")
    discard(shared, inner)
    return spans


def _remover(depth: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, n = span_arrays(batch.column(2))
            for lo, hi, texts in text_batches(batch):
                out = []
                for i, text in enumerate(texts, lo):
                    a, b = np.searchsorted(owner, [i, i + 1])
                    keep = keep_mask(len(text), start[a:b], n[a:b] + depth - 1)
                    left = np.frombuffer(text, np.uint8)[keep].tobytes() if a < b else text
                    n_spans = int(np.count_nonzero(np.diff(keep.view(np.int8), prepend=1) < 0))
                    out.append((len(text), len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest() if digest else left))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"],
                )

    return run


def remove_byte_spans(docs: DataFrame, spans: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept)."""
    return with_spans(docs, spans).mapInArrow(_remover(depth, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return with_spans(docs, repeated_byte_spans(docs)).mapInArrow(
        _remover(DEPTH, True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
