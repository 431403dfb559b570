"""Near-duplicate groups by similarity of word shingles: SimHash fingerprints in BK-trees, each link checked exactly.

At a similarity of 0.8 two 64-bit fingerprints differ in up to about twenty bits, too many for blocks of bits to
agree. Here the shards that get a BK-tree of their own are the documents with the same least shingle under one of
``TABLES`` random orders: at similarity s a pair misses all of them with probability (1 - s) ** TABLES, 0.00006 at
0.8. Texts in a bucket of more than ``TREE_NODES`` meet in buckets of two least shingles instead, out of ``PAIRS`` of
the same and as many more orders. A pair misses all of those only if it agrees in at most one order of each of three
sets of four, with probability 0.00002 at 0.8, whatever the size of a bucket. So a text has at most ``TABLES`` and
``PAIRS`` buckets, and the rows grow with the number of texts, however large a group of similar ones is. What stays
large after that shares two least shingles, so much of it is similar, and is searched whole in one task.

Within a bucket each text searches the tree within ``RADIUS`` bits; a candidate is a text whose estimate from
``SIGNATURE`` least-shingle bytes is no lower than ``MARGIN`` below the threshold. At a similarity of 0.8 a pair is
outside the margin with probability 0.00004 and outside the radius with 0.00001 at most (sets of four and five
shingles; fingerprints are of the sets, as the similarity is). Candidates only part the bucket
into pieces that no similar pair crosses. Texts that agree with a tree member in nearly all signature bytes and bits
stay out of the tree, so a large group of close copies does not make a large tree; the search reaches as much further
as they may differ from their member. A piece that several buckets find is kept once.

Within a piece links are made on the whole shingle sets alone: two texts are passed over only if exact links join them
already, or if their sizes or estimates rule them out. So a false candidate never stands in the way of a true one. A
text meets a few members of each group of linked texts first, so a large group of similar texts costs about one
comparison each; a task holds the shingle hashes of one piece.

Exact copies fall together first. Defined results: a null text is the empty text, and all empty texts are one
group; a text of fewer words than a shingle is one shingle; a very long text counts by all its shingles; a null doc_id
ranks with the largest number; of a tie (rows that repeat doc_id and text) one row stays; an empty table gives an empty
result; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.simhash import LOWER, BKTree, Groups, components, fingerprint, shingle_hashes, sorted_groups
from loam.llm.spans import mix, text_batches
from loam.llm.store import written

SHINGLE, SIMILARITY = 5, 0.8
TABLES, ORDERS, SIGNATURE, RADIUS, MARGIN = 6, 12, 128, 26, 0.15
#: The orders that cut hot buckets, the first ``TABLES`` among them, by twos: all pairs inside three sets of four orders.
PAIRS = [(i, j) for i in range(ORDERS) for j in range(i + 1, ORDERS) if i % 3 == j % 3]
#: Share of signature bytes and number of different bits at which a text stays out of the tree.
CLOSE, CLOSE_BITS = 0.97, 2
#: Texts of a bucket up to which it is not cut again.
TREE_NODES = 1_000
#: Members of a linked group that a text meets before it is held against all.
GREETERS = 4
LAST_ID = 2**63 - 1


class Signer:
    def __init__(self):
        rng = np.random.default_rng(17)
        self.order = rng.integers(0, 2**63, ORDERS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = (rng.integers(0, 2**31, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 2**32, SIGNATURE, np.uint64).astype(np.uint32)

    def sign(self, hashes: np.ndarray) -> tuple[list[int], bytes]:
        hashes = np.unique(hashes)
        keys = np.full(ORDERS, np.uint64(2**64 - 1))
        least = np.full(SIGNATURE, np.uint32(2**32 - 1))
        for lo in range(0, len(hashes), 4096):
            part = hashes[lo : lo + 4096]
            np.minimum(keys, mix(part[:, None] * self.order).min(axis=0), out=keys)
            low = (part >> np.uint64(32)).astype(np.uint32)
            np.minimum(least, (low[:, None] * self.a + self.b).min(axis=0), out=least)
        return keys.view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(d, h, fp, keys, sig): ``h`` is a hash of the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            fps, keys, sigs = [], [], []
            for _, _, texts in text_batches(batch):
                for text in texts:
                    hashes = shingle_hashes(text.translate(LOWER).split(), shingle)
                    fp = fingerprint(np.unique(hashes))
                    k, s = signer.sign(hashes)
                    fps.append(fp - (1 << 64) if fp >> 63 else fp)
                    keys.append(k)
                    sigs.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["d", "h", "fp", "keys", "sig"],
            )

    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    return keyed.mapInArrow(run, "d long, h long, fp long, keys array<long>, sig binary")


def bucket_members(texts: DataFrame) -> DataFrame:
    """(bucket, h, fp, sig) of buckets with two texts or more, those of texts in hot ones cut by ``PAIRS`` of orders.

    Buckets are numbers of 64 bits until their last cut; only those are joined with what a task needs of a text.
    """
    shared = lambda named: written(named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    named = texts.select("h", F.posexplode(F.slice("keys", 1, TABLES)).alias("t", "key")).select("h", "t", F.xxhash64(F.lit(0), "t", "key").alias("bucket"))
    size = shared(named)
    out, hot = named.join(size.where(F.col("n") <= TREE_NODES), "bucket").select("bucket", "h"), size.where(F.col("n") > TREE_NODES)
    if not hot.isEmpty():
        tables = named.join(hot, "bucket").groupBy("h").agg(F.collect_set("t").alias("hot"))
        # A first order whose bucket is not hot needs no pair: who agrees in it has met there.
        cut = [
            F.when(F.array_contains("hot", i) & (F.array_contains("hot", j) | F.lit(j >= TABLES)) if i < TABLES else F.lit(True), F.xxhash64(F.lit(1), F.lit(p), F.col("keys")[i], F.col("keys")[j]))
            for p, (i, j) in enumerate(PAIRS)
        ]
        again = written(tables.join(texts.select("h", "keys"), "h").select("h", F.array_compact(F.array(*cut)).alias("buckets")), "near-hot")
        again = again.select("h", F.explode("buckets").alias("bucket"))
        out = out.unionByName(again.join(shared(again), "bucket").select("bucket", "h"))
    return out.join(texts.select("h", "fp", "sig"), "h").select("bucket", "h", "fp", "sig")


def tree_pieces(fp: list[int], sig: np.ndarray, similarity: float) -> list[list[int]]:
    """The groups of two or more members that chains of candidates join."""
    tree, held, groups = BKTree(), [], Groups(len(fp))
    sure, enough = CLOSE * SIGNATURE, (similarity - MARGIN - (1 - CLOSE)) * SIGNATURE
    for i, value in enumerate(fp):
        inside = False
        for d, j in sorted((d, held[node]) for node, d in tree.within(value, RADIUS + CLOSE_BITS)):
            if groups.find(i) == groups.find(j):
                continue
            same = int(np.count_nonzero(sig[i] == sig[j]))
            if same >= enough:
                groups.join(i, j)
                inside = inside or (same >= sure and d <= CLOSE_BITS)
        if not inside:
            tree.add(value)
            held.append(i)
    pieces: dict[int, list[int]] = {}
    for i in range(len(fp)):
        pieces.setdefault(groups.find(i), []).append(i)
    return [x for x in pieces.values() if len(x) > 1]


def candidate_pieces(members: DataFrame, similarity: float) -> DataFrame:
    """(piece, h, sig): sets of texts among which some may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches):
            if group.num_rows < 2:
                continue
            h, fp = group.column(1).to_numpy(), [x & 0xFFFFFFFFFFFFFFFF for x in group.column(2).to_pylist()]
            sigs = group.column(3).to_pylist()
            sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, SIGNATURE)
            pieces = tree_pieces(fp, sig, similarity)
            if pieces:
                names = np.array([xxhash.xxh64_intdigest(h[x].tobytes()) for x in pieces], np.uint64).view(np.int64)
                at = np.concatenate(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, list(map(len, pieces)))), pa.array(h[at]), pa.array([sigs[i] for i in at.tolist()], pa.binary())],
                    ["piece", "h", "sig"],
                )

    dealt = members.select("bucket", "h", "fp", "sig").repartition("bucket").sortWithinPartitions("bucket", "h")
    return dealt.mapInArrow(run, "piece long, h long, sig binary").distinct()


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(h, shingles): the different shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_batches(batch):
                sets = [np.unique(shingle_hashes(x.translate(LOWER).split(), shingle)).view(np.int64) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], ["h", "shingles"])

    return docs.select("h", "text").mapInArrow(run, "h long, shingles array<long>")


def exact_links(sets: list[np.ndarray], sig: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a Jaccard similarity of ``similarity`` or more, at most one fewer than members, that join all such."""
    size, root, links = np.array(list(map(len, sets))), np.arange(len(sets)), []
    enough = (similarity - MARGIN) * SIGNATURE
    greeters: dict[int, list[int]] = {0: [0]} if len(sets) else {}

    def meet(i: int, at: np.ndarray) -> None:
        """Links of ``i`` to those of ``at`` that no link joins to it yet."""
        at = at[(root[at] != root[i]) & (np.minimum(size[at], size[i]) >= similarity * np.maximum(size[at], size[i]))]
        same = np.count_nonzero(sig[at] == sig[i], axis=1)
        near = np.flatnonzero(same >= enough)
        at = at[near[np.argsort(-same[near], kind="stable")]]
        while len(at):
            j, at = at[0], at[1:]
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= similarity * (size[i] + size[j] - common):
                links.append((i, int(j)))
                old, new = root[i], root[j]
                root[root == old] = new
                greeters[new] = (greeters[new] + greeters.pop(old, []))[-GREETERS:]
                at = at[root[at] != root[i]]

    for i in range(1, len(sets)):
        meet(i, np.array([j for some in greeters.values() for j in some]))
        others = np.flatnonzero(root[:i] != root[i])
        if len(others):
            meet(i, others)
        known = greeters.setdefault(root[i], [])
        if len(known) < GREETERS:
            known.append(i)
    return links


def verified(pieces: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that join the texts of each piece whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches):
            h = group.column(1).to_pylist()
            sig = np.frombuffer(b"".join(group.column(2).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            sets = []
            for chunk in group.column(3).chunks:
                values, bound = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
                sets.extend(values[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()))
            links = [(h[i], h[j]) for i, j in exact_links(sets, sig, similarity)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).join(pieces.select("h").distinct(), "h").dropDuplicates(["h"])
    sets = written(shingle_sets(texts, shingle), "near-sets")
    dealt = pieces.join(sets, "h").select("piece", "h", "sig", "shingles").repartition("piece").sortWithinPartitions("piece", "h")
    links = dealt.mapInArrow(run, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(d, h, n, root): for each different (doc_id, text), its number of rows and its group; ``d`` has null as the largest."""
    marks = written(signatures(docs, shingle), "near-marks")
    texts = marks.dropDuplicates(["h"]).select("h", "fp", "keys", "sig")
    pieces = written(candidate_pieces(bucket_members(texts), similarity), "near-pieces")
    roots = components(verified(pieces, docs, shingle, similarity), "near-links")
    rows = marks.groupBy("d", "h").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(roots, F.col("h") == F.col("node"), "left").select("d", "h", "n", F.coalesce("root", "h").alias("root"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest doc_id."""
    groups = near_duplicate_groups(docs.select("doc_id", "text"), shingle, similarity)
    first = groups.groupBy("root").agg(F.min(F.struct("d", "h", "n")).alias("one")).select("one.*").toDF("__near_d", "__near_h", "__near_n")
    d, h = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(first, (d == F.col("__near_d")) & (h == F.col("__near_h")))
    once = kept.where("__near_n = 1").select(*docs.columns)
    # Rows that repeat both doc_id and text are one row of their group.
    return once.unionByName(kept.where("__near_n > 1").dropDuplicates(["__near_d", "__near_h"]).select(*docs.columns))
