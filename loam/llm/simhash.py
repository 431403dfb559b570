"""SimHash near-duplicate groups: BK-trees over the fingerprints of one bucket, components by star contraction.

Fingerprints are cut into four blocks. Two fingerprints at two or fewer differing bits agree on at least two
blocks, so each pair meets in one of the six buckets "these two blocks have these values". Every bucket with
two or more different fingerprints builds a BK-tree (a child hangs below its parent at the integer Hamming
distance between them) and each member searches it, following only edges within the radius of its distance
to a node. A bucket reports links to join its members into their local groups, never all pairs; buckets above
``TREE_NODES`` are cut by four sub-blocks of the other bits in the same way, after which at most 65,536
fingerprints can share a bucket.

The trees travel by an exchange on the bucket and not by broadcast, as the fingerprints of all documents have
no size bound. Links join fingerprints, not documents: copies fall together before. Components follow by
large-star and small-star rounds, each written to the shared folder.

Documents meet fingerprints in joins of two plain exchanges, which adaptive execution splits where one fingerprint is
that of very many documents.

Defined results: a null text is the empty text; a text without words has fingerprint zero and links like any
other; a very long text counts whole, its hashes in blocks; ties (a bit set in just half the hashes) are 0; repeated
rows stay; a null doc_id is grouped but names no component unless it is alone (then null); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.spans import Texts, text_batches
from loam.llm.store import discard, written

SEED = 42
#: Fingerprints that one tree holds before its bucket is cut by further blocks.
TREE_NODES = 2_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every run of n words joined by a space; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(text, SEED)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], end[: len(words) - n] + 1)).tolist()
    last = end[n - 1 :].tolist()
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(last))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes. Hashes go through in blocks, so memory stays bounded."""
    count = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)].astype(">u8")
        count += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for lo, _, texts in text_batches(batch):
                for i, text in enumerate(texts):
                    out[lo + i] = fingerprint(shingle_hashes(text.translate(LOWER).split(), words_per_shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children keyed by their integer distance to the parent."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.nodes)
        self.nodes.append(value)
        self.children.append({})
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.nodes[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """(node, distance) of all nodes at radius or less."""
        stack = [0] if self.nodes else []
        while stack:
            at = stack.pop()
            d = (self.nodes[at] ^ value).bit_count()
            if d <= radius:
                yield at, d
            stack.extend(child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius)


class Groups:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = a = self.parent[self.parent[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join equal-group members of a bucket: at most one fewer than its members."""
    tree, groups, links = BKTree(), Groups(len(values)), []
    for i, value in enumerate(values):
        for j, _ in tree.within(value, radius):
            if groups.join(i, j):
                links.append((value, values[j]))
        tree.add(value)
    return links


def sorted_groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[object, pa.Table]]:
    """Groups of equal values in a column of a sorted partition, across batch borders."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip(np.append(0, cut), np.append(cut, len(keys))):
            if held and keys[lo] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def block_keys(bits: list[list[int]]) -> list[list[int]]:
    """The bit positions of every pair out of four blocks."""
    return [bits[a] + bits[b] for a in range(4) for b in range(a + 1, 4)]


def bucket_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints of ``fps`` (fp) that connect all at radius or less."""
    if not 0 <= radius <= 2:
        raise ValueError("two agreeing blocks of four need a radius of 0, 1 or 2")
    mask = lambda lo, n: ((1 << n) - 1) << lo
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    quarter = [mask(16 * i, 16) for i in range(4)]
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    masks = [quarter[a] | quarter[b] for a, b in pairs]

    def keyed(df: DataFrame, choices, old=None) -> DataFrame:
        keys = F.array(*[
            F.xxhash64(*([F.col(old)] if old else []), F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(choices)
        ])
        return df.select("fp", F.explode(keys).alias("bucket"))

    first = keyed(fps, masks)
    size = written(first.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    shared = first.join(size, "bucket")
    # In a bucket of too many, all bits are cut again into four; the two shared blocks then agree anyway.
    fine = [mask(4 * i, 4) | mask(16 + 4 * i, 4) | mask(32 + 4 * i, 4) | mask(48 + 4 * i, 4) for i in range(4)]
    again = keyed(shared.where(F.col("n") > TREE_NODES), [fine[a] | fine[b] for a, b in pairs], "bucket")
    members = shared.where(F.col("n") <= TREE_NODES).select("fp", "bucket").unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, group in sorted_groups(batches):
            values = sorted({x & 0xFFFFFFFFFFFFFFFF for x in group.column(1).to_pylist()})
            for x, y in tree_links(values, radius) if len(values) > 1 else ():
                a.append(signed(x))
                b.append(signed(y))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str = "components", smaller: Callable = F.least) -> DataFrame:
    """(node, root): the least node reachable over ``links`` (a, b), for every node that has a link.

    Each round points every node's larger neighbours at its least neighbour, then every node's smaller
    neighbours at the least of them, until nothing changes. Hub nodes are spread by map-side aggregation.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, name)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a")
        small = small.select("b", "m").where("b <> m").toDF("a", "b").union(low.select("a", F.col("m").alias("b")))
        spent, edges = edges, written(small.distinct(), name)
        discard(spent, least, large, low)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            )
        before = now


def simhash_groups(docs: DataFrame, words_per_shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marked = written(fingerprints(docs, words_per_shingle), "simhash")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(bucket_links(classes.select("fp"), radius), "simhash-links")
    grouped = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(grouped.select("fp", "root").join(least, "root").drop("root"), "simhash-named")
    discard(classes)
    return marked.join(named, "fp")


def simhash_digest(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
