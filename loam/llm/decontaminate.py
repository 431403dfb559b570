"""Benchmark decontamination: n-gram seeds find passages near test items, Smith-Waterman alignment scores them.

Words are lower-cased, freed of ASCII punctuation and parted at ASCII whitespace. Every run of three words of an item
is a seed; an item of fewer words is one seed. A first sweep over whole documents keeps the places of seeds, through a
table of ``BUCKETS`` bytes that holds how long the items of a seed may be, and cuts out what stands around each place as
far as those items reach. Each passage joins every item of which it holds a seed: items part the seeds they share by
length and content, but counts over the corpus do not choose among one item's seeds, as literal leaks make just the
seeds that an edited copy kept look common. Joined pairs are aligned word by word with gaps and mismatches, but for
those whose common words cannot reach the threshold. The score is the best local alignment over the item's own length:
1 for a whole literal copy; edits lower it by what they touch.

Only the table travels to the documents; all else are joins on a seed's hash.

Defined results: null or empty texts and items match nothing; an item of fewer than three words is found wherever its
words stand in order; a very long text is swept whole and gives passages, a very long item reaches as far as it is long;
of a tie between passages the later one is reported; of repeated rows of one doc_id the best score counts; a null
doc_id is reported as null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.spans import SpanHasher, Texts, text_batches
from loam.llm.store import discard, written

GRAM, THRESHOLD = 3, 0.4
BUCKETS = 1 << 24
MATCH, MISMATCH, GAP = 2, -1, -1
ALIGN_ROWS = 256
PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def plain(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode().translate(PLAIN)


class Grams:
    """Hashes of the word n-grams of a batch of texts, for each length in ``lengths``."""

    def __init__(self, *lengths: int):
        self.lengths, self.bytes_hasher, self.hasher = lengths, SpanHasher(3), SpanHasher(4)

    def load(self, texts: list[bytes]) -> None:
        """``at`` (word index), ``owner`` (text), ``size`` and ``hash`` of all n-grams, in the order of their places."""
        self.texts = Texts(texts)
        self.start, self.end, self.bound = self.texts.words()
        over = self.bytes_hasher.prefix_bytes(self.texts.data)
        prefix = self.hasher.prefix(self.bytes_hasher.spans(over, self.start, self.end))
        place = np.arange(len(self.start))
        owner = np.repeat(np.arange(len(texts)), np.diff(self.bound))
        left = self.bound[1:][owner] - place if len(place) else place
        each = [place[left >= n] for n in self.lengths]
        self.at = np.concatenate(each) if each else place[:0]
        self.size = np.repeat(np.array(self.lengths, np.int64), list(map(len, each))) if each else place[:0]
        order = np.argsort(self.at, kind="stable")
        self.at, self.size = self.at[order], self.size[order]
        self.owner = owner[self.at]
        self.hash = self.hasher.spans(prefix, self.at, self.at + self.size)


def item_seeds(items: DataFrame, gram: int = GRAM) -> DataFrame:
    """(item_id, seed, item, n_words, size): ``size`` is the words of the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(*range(1, gram + 1))
        for batch in batches:
            for lo, _, texts in text_batches(batch):
                texts = [plain(x) for x in texts]
                grams.load(texts)
                joined = [b" ".join(x.split()).decode() for x in texts]
                words = np.diff(grams.bound)
                own = grams.size == np.minimum(words, gram)[grams.owner]
                owner = grams.owner[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(lo + owner)), pa.array(grams.hash[own].view(np.int64)), pa.array([joined[i] for i in owner.tolist()], pa.string()),
                        pa.array(words[owner], pa.int64()), pa.array(grams.size[own].astype(np.int32)),
                    ],
                    ["item_id", "seed", "item", "n_words", "size"],
                )

    found = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, seed long, item string, n_words long, size int")
    return found.distinct()


def reach_table(seeds: DataFrame) -> np.ndarray:
    """For each bucket of seeds the bits that the words of its longest item take, 0 where there is no seed.

    One number for each bucket in use reaches the driver, at most ``BUCKETS`` of them whatever the items.
    """
    bucket, bits = F.pmod(F.col("seed"), F.lit(BUCKETS)), F.length(F.bin("n_words"))
    used = seeds.select(bucket.alias("b"), bits.alias("bits")).groupBy("b").agg(F.max("bits").alias("bits"))
    got = used.select((F.col("b") * 64 + F.col("bits")).cast("int").alias("x")).toArrow().column(0).to_numpy()
    table = np.zeros(BUCKETS, np.uint8)
    table[got >> 6] = got & 63
    return table


def seeded_passages(docs: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, first, passage, seeds): stretches around places of seeds, each as far to both sides as its items may
    reach; stretches that overlap or touch are one."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, grams = sent.value, Grams(*sizes)
        for batch in batches:
            for lo, _, texts in text_batches(batch):
                grams.load([plain(x) for x in texts])
                bits = table[grams.hash.view(np.int64) % BUCKETS]
                hit = np.flatnonzero(bits)
                owner, reach = grams.owner[hit], np.int64(1) << bits[hit].astype(np.int64)
                begin = np.maximum(grams.at[hit] - reach, grams.bound[owner])
                end = np.minimum(grams.at[hit] + grams.size[hit] + reach, grams.bound[owner + 1])
                order = np.argsort(begin, kind="stable")
                hit, owner, begin, end = hit[order], owner[order], begin[order], end[order]
                upto = np.maximum.accumulate(end)
                new = np.ones(len(hit), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] > upto[:-1])
                cut = np.append(np.flatnonzero(new), len(hit))
                rows = []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    i = owner[a]
                    words = grams.texts.raw[grams.start[begin[a]] : grams.end[upto[b - 1] - 1]]
                    rows.append((lo + i, begin[a] - grams.bound[i], words.decode("utf-8", "replace"), np.unique(grams.hash.view(np.int64)[hit[a:b]])))
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.int64()))],
                    ["doc_id", "first", "passage", "seeds"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, first long, passage string, seeds array<long>")


def align(items: list[list[int]], passages: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of pairs of word sequences, and the passage index just after each."""
    rows, wide = max(map(len, items), default=0), max(map(len, passages), default=0)
    a = np.full((len(items), rows), -1)
    b = np.full((len(items), wide), -2)
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    score = np.zeros((len(items), wide + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    slope = -GAP * np.arange(wide + 1)
    for k in range(rows):
        fit = np.where(a[:, k : k + 1] == b, MATCH, MISMATCH)
        step = np.zeros_like(score)
        np.maximum(score[:, :-1] + fit, score[:, 1:] + GAP, out=step[:, 1:])
        # Gaps along the passage: the best start to the left, less one GAP a word.
        step = np.maximum(np.maximum.accumulate(np.maximum(step, 0) + slope, axis=1) - slope, 0)
        score = step.astype(np.int32)
        top = score.argmax(axis=1)
        value = score[np.arange(len(items)), top]
        end = np.where(value > best, top, end)
        best = np.maximum(best, value)
    return best, end


def aligned(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of the (doc_id, first, passage, item_id, item) rows that score
    ``threshold`` or more. Passages and items are plain words, parted at ASCII whitespace as everywhere here."""

    def reachable(item: list[bytes], passage: list[bytes]) -> bool:
        """No alignment matches more words of the item than the passage holds."""
        held = set(passage)
        return MATCH * sum(w in held for w in item) / (MATCH * max(1, len(item))) >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ALIGN_ROWS):
                part = batch.slice(lo, ALIGN_ROWS)
                doc, first, passage, item_id, item = (c.to_pylist() for c in part.columns)
                a, b = [x.encode().split() for x in item], [x.encode().split() for x in passage]
                some = [i for i in range(len(a)) if reachable(a[i], b[i])]
                if not some:
                    continue
                number: dict[bytes, int] = {}
                code = lambda words: [number.setdefault(w, len(number)) for w in words]
                a, b = [code(a[i]) for i in some], [code(b[i]) for i in some]
                order = sorted(range(len(a)), key=lambda i: len(b[i]))  # like lengths together
                best, end, begin = np.zeros(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                for at in range(0, len(order), 32):
                    now = order[at : at + 32]
                    s, e = align([a[i] for i in now], [b[i] for i in now])
                    # The same alignment from its end backwards gives its start.
                    _, back = align([a[i][::-1] for i in now], [b[i][:x][::-1] for i, x in zip(now, e.tolist())])
                    best[now], end[now], begin[now] = s, e, e - back
                full = np.array([MATCH * max(1, len(x)) for x in a])
                place = np.array([first[i] for i in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc[i] for i in some], pa.int64()), pa.array([item_id[i] for i in some], pa.int64()), pa.array(best / full), pa.array(place + begin), pa.array(place + end)],
                    ["doc_id", "item_id", "score", "first_word", "last_word"],
                )

    return pairs.select("doc_id", "first", "passage", "item_id", "item").mapInArrow(
        run, "doc_id long, item_id long, score double, first_word long, last_word long"
    )


def contaminated(docs: DataFrame, items: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of all pairs with a score of ``threshold`` or more."""
    seeds = written(item_seeds(items, gram), "decon-seeds")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most ``gram`` rows
    passages = written(seeded_passages(docs, reach_table(seeds), sizes), "decon-passages").withColumn("pid", F.xxhash64("doc_id", "first", "passage"))
    hits = passages.select("pid", F.explode("seeds").alias("seed"))
    pairs = written(hits.join(seeds.select("item_id", "seed"), "seed").select("pid", "item_id").distinct(), "decon-pairs")
    texts = seeds.select("item_id", "item").distinct()
    joined = passages.dropDuplicates(["pid"]).join(pairs, "pid").join(texts, "item_id")
    best = F.max(F.struct("score", "first_word", "last_word"))
    found = written(
        aligned(joined, threshold).where(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(best.alias("best"))
        .select("doc_id", "item_id", "best.score", "best.first_word", "best.last_word"),
        "decon-found",
    )
    discard(seeds, pairs)
    return found


def decontamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items)
