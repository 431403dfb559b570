"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character 3- to 5-grams and of itself, all hashed into one table; a
document is the mean of its words; a softmax over two classes sits on top. Table and softmax are trained jointly in
numpy, with steps scaled by each row's past gradients, so a misspelling never seen shares most of its n-grams with
the word it hides. As every part is linear, the trained model is one number per bucket, and a document's score is
the mean of its words' numbers: 1 MB travels to the executors whatever the corpus. All n-grams of a stretch of text
are hashed at once in numpy.

Training takes a bounded sample of labelled rows: per label at most ``TRAIN_ROWS`` rows, those of least hash, among
the rows whose CRC-32 of the doc_id is not divisible by 5. Their texts become bags of buckets where they stand, and one
task trains on the bags. The bias is corrected for the share of each label among all training labels. Scoring reads
every whole text and nothing else of a row, without a shuffle.

Defined results: a null or empty text scores by the bias alone; a very long text is scored whole, in pieces of
``PIECE`` characters that end at whitespace; without labels, or with one label only, every score is 0 or 1 for that
label (0 without any); a tie of 0.5 counts as label 1; repeated rows score alike; a null doc_id is never held out; null
labels are not learned from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.spans import mix, ranges

#: Rows of each label that training takes at most.
TRAIN_ROWS = {0: 3_500, 1: 1_500}
BUCKETS = 1 << 17
DIM, EPOCHS, RATE, SCALE = 4, 8, 0.15, 100.0
GRAMS = (3, 4, 5)
#: Characters that are hashed at a time.
PIECE = 1 << 18
FOLDS = 5
#: Whitespace as ``str.split`` takes it; all of it lies below 0x3001.
IS_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
#: An odd number whose powers weigh the characters of a gram.
BASE = np.uint64(0x9E3779B97F4A7C15)


class Subwords:
    """The buckets of all words of a text that is lower case already.

    ``word``: for each gram the word it is of, words counted from 0; ``bucket``: its place in the table; ``count``: the
    grams of each word. A word stands between ``<`` and ``>`` and is a gram itself.
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = IS_SPACE[np.minimum(codes, 0x3001)]
        edge = np.flatnonzero(np.diff(np.concatenate(([1], space.view(np.int8), [1]))))
        size = edge[1::2] - edge[::2] + 2
        self.words = len(size)
        first = np.cumsum(size) - size
        padded = np.empty(int(size.sum()), np.uint64)
        padded[first], padded[first + size - 1] = ord("<"), ord(">")
        padded[ranges(first + 1, size - 2)] = codes[~space]
        inside = np.arange(len(padded)) - np.repeat(first, size)
        left, owner = np.repeat(size, size) - inside, np.repeat(np.arange(self.words), size)
        powers = np.full(max(int(size.max(initial=0)), GRAMS[-1]) + 1, BASE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        places, buckets = [], []
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            hashed = np.full(len(at), np.uint64(n))
            for k in range(n):
                hashed += padded[at + k] * powers[k + 1]
            places.append(owner[at])
            buckets.append(self.place(hashed))
        whole = np.add.reduceat(padded * powers[inside + 1], first) if self.words else padded
        self.word = np.concatenate([*places, np.arange(self.words)])
        self.bucket = np.concatenate([*buckets, self.place(whole)])
        self.count = np.bincount(self.word, minlength=self.words)

    @staticmethod
    def place(hashed: np.ndarray) -> np.ndarray:
        return (mix(hashed) >> np.uint64(47)).astype(np.int64)  # the 17 upper bits: BUCKETS


def pieces(text: str) -> Iterator[str]:
    """A text in lower case, in pieces of about PIECE characters that part no word."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = re.compile(r"\s").search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].lower()
        at = end


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares in the mean of its words."""
    at, share, words = [np.zeros(0, np.int64)], [np.zeros(0)], 0
    for piece in pieces(text or ""):
        got = Subwords(piece)
        places, inverse = np.unique(got.bucket, return_inverse=True)
        at.append(places)
        share.append(np.bincount(inverse, 1 / got.count[got.word], len(places)))
        words += got.words
    places, inverse = np.unique(np.concatenate(at), return_inverse=True)
    return places, np.bincount(inverse, np.concatenate(share), len(places)) / max(1, words)


class SubwordModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts, hashed together up to PIECE characters."""
        total, words = np.zeros(len(texts)), np.zeros(len(texts))
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            got = Subwords("\n".join(x for _, x in held))
            value = np.bincount(got.word, self.weights[got.bucket], got.words) / np.maximum(got.count, 1)
            n = np.array([len(x.split()) for _, x in held])
            owner = np.repeat([i for i, _ in held], n)
            np.add.at(total, owner, value)
            np.add.at(words, owner, 1)
            held, size = [], 0

        for i, text in enumerate(texts):
            for piece in pieces(text or ""):
                held.append((i, piece))
                size += len(piece)
                if size >= PIECE:
                    flush()
        if held:
            flush()
        logit = self.bias + total / np.maximum(words, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], share: float | None = None, seed: int = 5) -> SubwordModel:
    """Fits table and softmax jointly. ``share`` is the share of label 1 where the sample was drawn from."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return SubwordModel(np.zeros(BUCKETS), 500.0 if len(y) and y[0] else -500.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM
    soft, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    past, past_soft = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            at, weight = bags[i]
            rows = table[at]
            hidden = SCALE * (weight @ rows) if len(at) else np.zeros(DIM)
            z = hidden @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            bias -= 0.05 * p
            if len(at):
                down = SCALE * (soft @ p)
                step = weight[:, None] * down
                past[at] += (step * step).mean(axis=1)
                grad = np.outer(hidden, p)
                past_soft += grad * grad
                table[at] = rows - RATE * step / np.sqrt(past[at])[:, None]
                soft -= RATE * grad / np.sqrt(past_soft)
    side = soft[:, 1] - soft[:, 0]
    offset = float(bias[1] - bias[0])
    if share is not None and 0 < share < 1:
        seen = float(y.mean())
        offset += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    return SubwordModel(SCALE * (table @ side), offset)


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, known: DataFrame, per_label: dict[int, int]) -> DataFrame:
    """(h, text, toxic): per label the rows of least hash, at most ``per_label``. Only chosen ids meet the documents."""
    out = None
    for label, most in per_label.items():
        ids = known.where(F.col("toxic") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        met = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by per_label
        order = F.struct(F.xxhash64("doc_id"), F.xxhash64("doc_id", "text"))
        rows = met.select(order.alias("h"), "text", F.lit(label).alias("toxic")).orderBy("h").limit(most)
        out = rows if out is None else out.unionByName(rows)
    return out


def fit(docs: DataFrame, labels: DataFrame, per_label: dict[int, int] = TRAIN_ROWS) -> SubwordModel:
    """Trains on a bounded sample; label counts cover all training labels."""
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else None

    def to_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [bag(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([at.astype(np.int32) for at, _ in made], pa.list_(pa.int32())), pa.array([w for _, w in made], pa.list_(pa.float64()))],
                    ["h", "toxic", "at", "weight"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(h["h1"], h["h2"], y, at, w) for b in batches for h, y, at, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3))]
        rows.sort(key=lambda r: (r[0], r[1], r[2]))
        model = train([(at.values.to_numpy(), w.values.to_numpy()) for _, _, _, at, w in rows], [r[2] for r in rows], share)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    chosen = training_rows(docs, known, per_label).select(F.struct(F.col("h").getField("col1").alias("h1"), F.col("h").getField("col2").alias("h2")).alias("h"), "text", "toxic")
    spread = chosen.repartition(16, F.col("h"))  # a limit leaves one partition
    bags = spread.mapInArrow(to_bags, "h struct<h1:long,h2:long>, toxic int, at array<int>, weight array<double>")
    # One task trains, so the driver holds the model only.
    got = bags.repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return SubwordModel(np.frombuffer(got["weights"]), got["bias"]) if got else train([], [], share)


def score(docs: DataFrame, model: SubwordModel, *keep: str, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id by default) and the score, as ``name``, of every row."""
    keep = keep or ("doc_id",)
    schema = docs.select(*keep).schema.add(name, "double")
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordModel(*sent.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own.scores(texts), pa.float64())], [*keep, name])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
