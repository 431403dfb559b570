"""Media columns: byte payloads as grey PNG images in a binary column, read back with cosine-transform hashes.

The encoder writes 8-bit greyscale PNG and gives every scan line the filter, sub or up, that leaves the smaller sum of
absolute differences; the decoder walks the chunks, tests every checksum, inflates the image data and undoes the
filters with numpy: sub and up by running sums, average and Paeth, which only foreign images have here, sample by
sample. The image column is stored as Parquet and read back before anything is computed of it. The feature is the sign
pattern of the lowest 8 x 8 cosine-transform coefficients of the image averaged down to 32 x 32, against their median
(the constant term is left out of the median).

Defined results: a null text is the empty text and gives the one all-255 image; a very long text is one tall image;
equal texts give equal values; of a tie between the filters sub is taken; repeated rows stay; an empty table gives an
empty result; a damaged image raises ``ValueError``; other columns are ignored. Memory: one Arrow batch and about
``PART_BYTES`` of images beside it, or one image if that is larger.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.store import written

BLOCK = 576
#: Samples in a row: 24 x 24 payload blocks lie one below the other.
WIDTH = 576
GRID, LOW = 32, 8
PART_BYTES = 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad_payload(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filter_rows(image: np.ndarray, kind: int) -> np.ndarray:
    """Scan lines of an 8-bit grey image under PNG filter 0 (none), 1 (sub), 2 (up), 3 (average) or 4 (Paeth)."""
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    up = np.zeros_like(image)
    up[1:] = image[:-1]
    if kind == 0:
        return image
    if kind == 1:
        return image - left
    if kind == 2:
        return image - up
    if kind == 3:
        return image - ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    corner = np.zeros_like(image)
    corner[1:, 1:] = image[:-1, :-1]
    return image - paeth(left, up, corner)


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))


def encode_png(payload: bytes, width: int = WIDTH, kind: int | None = None, level: int = 1) -> bytes:
    """``kind`` is one filter for all lines; None chooses sub or up line by line."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.empty((len(image), width + 1), np.uint8)
    if kind is None:
        sub, up = filter_rows(image, 1), filter_rows(image, 2)
        weight = lambda x: np.minimum(x, -x).sum(axis=1, dtype=np.int64)
        least = weight(up) < weight(sub)
        lines[:, 0] = 1 + least
        lines[:, 1:] = np.where(least[:, None], up, sub)
    else:
        lines[:, 0] = kind
        lines[:, 1:] = filter_rows(image, kind)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The image of filtered scan lines. Runs of lines with filters that need no sequential step are undone at once."""
    out = np.empty_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    at = 0
    while at < len(kinds):
        kind, end = kinds[at], at + 1
        while end < len(kinds) and kinds[end] == kind:
            end += 1
        if kind == 0:
            out[at:end] = lines[at:end]
        elif kind == 1:
            out[at:end] = np.cumsum(lines[at:end], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[at:end] = np.cumsum(lines[at:end], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(at, end):
                out[y] = _sequential(kind, lines[y].tolist(), above.tolist())
                above = out[y]
        else:
            raise ValueError(f"PNG filter {kind}")
        above = out[end - 1]
        at = end
    return out


def _sequential(kind: int, line: list[int], up: list[int]) -> np.ndarray:
    """Average and Paeth depend on the sample just undone."""
    row, a, c = [], 0, 0
    for x, b in zip(line, up):
        if kind == 3:
            a = (x + (a + b) // 2) & 255
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            a = (x + (a if p <= q and p <= r else b if q <= r else c)) & 255
        c = b
        row.append(a)
    return np.array(row, np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, non-interlaced PNG."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, sum_ = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(sum_) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", sum_)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG header")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("PNG size")
    lines = lines.reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _dct(n: int, k: int) -> np.ndarray:
    x = np.arange(n)
    return np.cos(np.pi * np.outer(np.arange(k), 2 * x + 1) / (2 * n))


def shrink(image: np.ndarray, grid: int = GRID) -> np.ndarray:
    """Mean samples on a grid x grid raster; an axis shorter than the grid repeats its samples."""
    for axis in (0, 1):
        n = image.shape[axis]
        if n < grid:
            image = np.take(image, np.arange(grid) * n // grid, axis=axis)
        else:
            edge = np.arange(grid) * n // grid
            image = np.add.reduceat(image, edge, axis=axis, dtype=np.float64)
            size = np.diff(np.append(edge, n)).astype(float)
            image = image / (size[:, None] if axis == 0 else size[None, :])
    return image


def cosine_hash(image: np.ndarray) -> str:
    low = _dct(GRID, LOW) @ shrink(image) @ _dct(GRID, LOW).T
    low = np.round(low.ravel(), 6)  # sums in another order must not flip a sign
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a PNG in a binary column. No shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            lo, held, sizes, images = 0, 0, [], []
            for i, text in enumerate(texts, 1):
                raw = text.as_py() or b""
                sizes.append(len(raw))
                images.append(encode_png(pad_payload(raw)))
                held += len(images[-1])
                if held >= PART_BYTES or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, i - lo), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])
                    lo, held, sizes, images = i, 0, [], []

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Decodes a (doc_id, n_bytes, media) table and computes the features of the samples."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, png in zip(*(batch.column(i) for i in range(3))):
                png = png.as_py()
                image = decode_png(png)
                payload = image.tobytes()
                rows.append(
                    (doc_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image))
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)

    long, text = pa.int64(), pa.string()
    kinds = [long, long, long, text, long, long, text, text]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.mapInArrow(decode, ", ".join(f"{n} {'long' if t == long else 'string'}" for n, t in zip(names, kinds)))


def media_digest(docs: DataFrame) -> DataFrame:
    return read_media(written(encode_media(docs), "media"))
