"""Vectorised hashing of words, bytes and spans of them, for the operators that compare passages.

A span's hash is a polynomial over its elements modulo 2**64, taken from a prefix sum, so that any
span of any length costs two lookups. ``SpanHasher`` keeps the powers of one odd base and of its
inverse. Everything works on batches of whole texts of about ``BATCH_BYTES``; a longer text is a
batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 20
#: The low bits of a gram's hash give way to its place, so that a minimum also says where it stands.
PLACE = (1 << 26) - 1
#: Whitespace bytes: 0x20 and 0x09 to 0x0D. None of them occurs inside a multi-byte character.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of a 64-bit hash over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHasher:
    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 2**64, 256, np.uint64)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.pow = self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) <= n:
            size = max(n + 1, 2 * len(self.pow), BATCH_BYTES // 2)
            for name, base in (("pow", self.base), ("inv", pow(self.base, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix_bytes(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(self.table[data])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.pow[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the elements [start, end)."""
        return mix((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k elements."""
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(a[i : i + w])."""
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:]) if len(a) > span else a[:0]
        span *= 2
    rest = w - span
    return (np.minimum(a[:-rest], a[rest:]) if len(a) > rest else a[:0]) if rest else a


class Texts:
    """A batch of texts as one byte array, a newline after each; ``start``/``end`` bound each text."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte bounds of all words, and for each text the index of its first word (one more at the end)."""
        space = IS_SPACE[self.data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        first, last = edge[::2], edge[1::2]
        return first, last, np.append(np.searchsorted(first, self.start), len(first))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers start[i] .. start[i] + count[i] - 1 for each i, one after another."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    some = count > 0
    start, count = start[some], count[some]
    if total:
        out[0] = start[0]
        out[np.cumsum(count)[:-1]] = start[1:] - (start[:-1] + count[:-1] - 1)
    return np.cumsum(out)


def winnow(hasher: SpanHasher, prefix: np.ndarray, first: np.ndarray, last: np.ndarray, k: int, t: int):
    """The canonical anchor of every window of ``t`` elements, as runs of windows that share one.

    A window's anchor is its k-gram of least hash, the first of equal ones, so it depends on the window's
    content alone: equal windows have equal anchors wherever they stand, and no two windows of one run are equal. ``first``/``last`` bound each text in elements.
    Returns, for each run: text index, first window's start within the text, number of windows, the
    anchor's hash, and the hash of all elements the run's windows cover.
    """
    grams = hasher.grams(prefix, k)
    place = np.uint64(PLACE)
    least = sliding_min((grams & ~place) | (np.arange(len(grams), dtype=np.uint64) & place), t - k + 1)
    count = np.maximum(last - first - t + 1, 0)
    idx = ranges(first, count)
    owner = np.repeat(np.arange(len(first)), count)
    if not len(idx):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = idx + (((least[idx] & place).astype(np.int64) - idx) & PLACE)
    new = np.ones(len(idx), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    n = np.diff(np.append(run, len(idx)))
    begin = idx[run]
    return owner[run], begin - first[owner[run]], n, grams[anchor[run]], hasher.spans(prefix, begin, begin + n - 1 + t)


def text_batches(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of ``batch`` and their texts as UTF-8 (null: empty), about BATCH_BYTES at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    texts = [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]
    lo = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > BATCH_BYTES:
            yield lo, i, texts[lo:i]
            lo, size = i, 0
        size += len(x) + 1
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


def keep_mask(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """False where one of the intervals [start, start + size) covers an index below n."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(start, n), 1)
    np.add.at(steps, np.minimum(start + size, n), -1)
    return np.cumsum(steps[:n]) == 0
