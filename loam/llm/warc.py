"""WARC archives: written as monolithic gzip streams, normalised to a gzip member per record with an offset index.

``write_archives`` lays pages out as WARC/1.1 records in files of about ``ARCHIVE_BYTES``, each one gzip stream
without inner borders. ``normalise`` inflates such a file once from end to end, rewrites every record as its own
gzip member and writes a sidecar index of offsets. ``read_archives`` opens each member at its offset alone, checks
its digest and returns the records.

Of pages with equal payloads the one with the largest page_id is the response and the others are revisits of it,
without a payload of their own. Files go to the folder all executors share, through Arrow's file systems, so it
may be a remote store; a file's name is its own for each task attempt, and only files of finished tasks are in the
manifest, so a repeated task does no harm. Memory: one record and ``PIECE`` inflated bytes at a time when normalising,
one batch of pages when writing. Every record has an id of its own; page ids travel in headers of their own.

A foreign archive may hold several gzip members: they are read one after another. One that ends inside a record or a
member is an error.

Defined results: null html is the empty payload, and empty payloads count as equal payloads; a very long payload is one
record; a null url is empty, and line breaks in a url are percent-encoded; of a tie (repeated rows with the largest
page_id) all are responses; a null page_id is smaller than any other and is never referred to; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.store import fresh_dir, written

ARCHIVE_BYTES = 16 << 20
PIECE = 1 << 18
LEVEL = 1
RECORD_ID, PAGE_ID, REFERS_TO = "WARC-Record-ID", "X-Page-ID", "X-Refers-To-Page-ID"


def classify(pages: DataFrame) -> DataFrame:
    """Adds ``refers_to``: the page_id of the response that a revisit repeats, null for responses.

    Only digests that occur twice are joined back. They are written first, so that the join is of two plain exchanges
    and adaptive execution can split the copies of one payload over many tasks.
    """
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    twice = written(
        keyed.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-twice"
    )
    revisit = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return keyed.join(twice, "sha1", "left").select("page_id", "url", "html", revisit.alias("refers_to"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"{RECORD_ID}: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        f"{PAGE_ID}: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head.append(f"{REFERS_TO}: {refers_to}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        payload = b""
    block = http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers and the payload after the HTTP headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    found = headers(head)
    block = rest[: int(found["content-length"])]
    return found, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (page_id, url, html, refers_to) rows; returns the manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        out = packer = None
        done: list[tuple[str, int]] = []
        count = size = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(packer.flush())
                out.close()
                done.append((name, count))
                out = None

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns)):
                    if out is None:
                        name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out, packer = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                    raw = record(page_id, url, html or b"", refers_to)
                    out.write(packer.compress(raw))
                    count, size = count + 1, size + len(raw)
                    if size >= archive_bytes:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    as_bytes = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")
    return written(as_bytes.mapInArrow(run, "path string, records long"), "warc-manifest")


def inflated(source) -> Iterator[bytes]:
    """The content of all gzip members of a file, at most PIECE bytes at a time; zeros between members are padding."""
    inflate, data, ended = None, b"", False
    while True:
        if not data and not ended:
            data = source.read(PIECE)
            ended = not data
        if inflate is None:
            data = data.lstrip(b"\0")
            if data:
                inflate = zlib.decompressobj(31)
            elif ended:
                return
            continue
        piece = inflate.decompress(data, PIECE)
        if piece:
            yield piece
        if inflate.eof:
            data, inflate = inflate.unused_data, None
        elif ended and not data and not piece:
            raise ValueError("the archive ends inside a gzip member")
        else:
            data = inflate.unconsumed_tail


def stream_records(source) -> Iterator[bytes]:
    """The records of an archive, read in pieces; a record's length comes from its own header."""
    held, need = bytearray(), 0
    for piece in inflated(source):
        held += piece
        while len(held) >= need:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) >= need:
                yield bytes(held[:need])
                del held[:need]
                need = 0
    if held:
        raise ValueError("the archive ends inside a record")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a gzip member for every record beside a ``.idx`` of "offset length record-id" lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = []
            for path in batch.column(0).to_pylist():
                name = f"members-{uuid.uuid4().hex}.warc.gz"
                at, lines = 0, []
                with store.open_input_stream(f"{base}/{path}", compression=None) as source, store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for raw in stream_records(source):
                        packer = zlib.compressobj(LEVEL, wbits=31)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        lines.append(f"{at} {len(member)} {headers(raw[: raw.index(b'\r\n\r\n')])[RECORD_ID.lower()]}\n")
                        at += len(member)
                with store.open_output_stream(f"{base}/{name}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    return written(_spread(manifest).mapInArrow(run, "path string"), "warc-members")


def _spread(files: DataFrame) -> DataFrame:
    """Files dealt over tasks evenly, about one to each."""
    n = max(1, min(files.count(), 4096))
    return files.select("path").repartition(n, F.xxhash64("path"))


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(members: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of normalised archives, each read by its offset; a response's payload must fit its digest."""

    def page(value: str | None) -> int | None:
        return int(value) if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{path}.idx", compression=None) as source:
                    index = [x.split(" ", 2) for x in source.read().decode().splitlines()]
                with store.open_input_file(f"{base}/{path}") as source:
                    for lo in range(0, len(index), 512):
                        rows = []
                        for offset, length, name in index[lo : lo + 512]:
                            source.seek(int(offset))
                            found, payload = parse(zlib.decompress(source.read(int(length)), 31))
                            sha = found["warc-payload-digest"].removeprefix("sha1:")
                            kind = found["warc-type"]
                            if found[RECORD_ID.lower()] != name or kind == "response" and digest(payload) != sha:
                                raise ValueError(f"{path} at {offset}: the record does not fit its index or digest")
                            rows.append((page(found[PAGE_ID.lower()]), int(found["warc-payload-length"]), sha, kind, page(found.get(REFERS_TO.lower())), payload if with_payload else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return _spread(members).mapInArrow(run, RECORDS)


def warc_digest(pages: DataFrame) -> DataFrame:
    folder = fresh_dir(pages.sparkSession, "warc")
    manifest = write_archives(classify(pages), folder)
    return read_archives(normalise(manifest, folder), folder, with_payload=False).drop("payload")
