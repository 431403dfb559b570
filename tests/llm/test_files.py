import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from helpers import brute_feature, frame, png_samples

from loam.llm import media, sharding, warc


def test_png_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 12), np.uint8)
    for kind in range(5):
        assert (media.decode_png(media.encode_png(image.tobytes(), 12, kind)) == image).all()
    mixed = np.vstack([media.filter_rows(image, k)[y] for y, k in enumerate((4, 2, 2, 3, 1))])
    assert (media.unfilter(np.array([4, 2, 2, 3, 1]), mixed) == image).all()


def test_png_damage():
    png = media.encode_png(b"\1" * 576)
    for cut in (bytes(8) + png[8:], png[:40] + bytes([png[40] ^ 1]) + png[41:], png[:-12]):
        with pytest.raises(ValueError):
            media.decode_png(cut)


def test_media(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "é" * 288, "a"), (4, "x" * 577, "a"), (4, "x" * 577, "a"), (None, "long " * 40000, "a")]
    got = {r.doc_id: r for r in media.media_digest(frame(spark, rows)).collect()}
    assert len(media.media_digest(frame(spark, rows)).collect()) == 6
    for d, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1].feature == got[2].feature and got[3].n_bytes == 576
    stored, used = {r.doc_id: bytes(r.media) for r in media.encode_media(frame(spark, rows)).collect()}, set()
    for d, png in stored.items():
        lines, kinds = png_samples(png)
        used |= set(kinds)
        assert (got[d].media_bytes, got[d].media_sha256, got[d].feature) == (len(png), hashlib.sha256(png).hexdigest(), brute_feature(lines))
    assert used == {1, 2}
    assert media.media_digest(frame(spark, [])).count() == 0


def test_warc_round_trip(spark):
    html = ["<p>é</p>", "", None, "<p>é</p>", "b" * 300_000, "a\r\n\r\nb", "<p>é</p>"]
    rows = [(i, f"http://x/{i}\r\n" if i % 2 else None, h) for i, h in enumerate(html)] + [(6, "u", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "n", "only")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    got = warc.warc_digest(pages).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw, to = (h or "").encode(), last[h or ""]
        kind = "response" if i == to or to < 0 else "revisit"
        want.append((-1 if i is None else i, len(raw), warc.digest(raw), kind, to if kind == "revisit" else -1))
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == sorted(want)
    assert warc.warc_digest(pages.limit(0)).count() == 0


def test_warc_stream_records():
    records = [warc.record(i, "u", b"x" * i * 1000, None) for i in range(9)]
    assert list(warc.stream_records(io.BytesIO(zlib.compress(b"".join(records), wbits=31)))) == records
    members = b"".join(zlib.compress(x, wbits=31) for x in (b"".join(records[:2]), b"".join(records[2:5]) + records[5][:40], records[5][40:] + b"".join(records[6:])))
    assert list(warc.stream_records(io.BytesIO(members + bytes(9)))) == records and list(warc.stream_records(io.BytesIO(b""))) == []
    for cut in (zlib.compress(b"".join(records)[:-30], wbits=31), members[:-20], members[:5]):
        with pytest.raises(ValueError):
            list(warc.stream_records(io.BytesIO(cut)))
    packed = io.BytesIO(zlib.compress(bytes(50 << 20), wbits=31))
    assert max(map(len, warc.inflated(packed))) <= warc.PIECE


def test_warc_ids_are_unique():
    ids = [warc.headers(warc.record(7, "u", b"", 9).partition(b"\r\n\r\n")[0]) for _ in range(5)]
    assert len({x["warc-record-id"] for x in ids}) == 5 and {x["x-refers-to-page-id"] for x in ids} == {"9"}


def check_shards(rows, got, shards, slack):
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    size, slots = [0] * shards, {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size) / shards
    assert max(abs(s - mean) for s in size) <= slack * mean
    return size


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(4000)] + [(9000 + i, "same text of a group") for i in range(150)] + [(None, None), (1, None), (1, "")]
    got = sharding.sharding_digest(frame(spark, [(d, t, "s") for d, t in rows])).collect()
    check_shards(rows, got, 24, 0.05)
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"same text of a group")}) == 1
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert len({r["shard"] for r in got if r["size"] == 8}) == 1
    many = [(1, "one")] * 700 + [(None, None)] * 500 + [(None, "")] * 300 + [(i, f"text {i}") for i in range(500)]
    clash = spark.createDataFrame([(d, t, 5, 6, 7, 8) for d, t in many], "doc_id long, text string, key int, shard int, salt int, size int")
    assert len(check_shards(many, sharding.sharding_digest(clash).collect(), 24, 0.1)) == 24
    assert sharding.sharding_digest(frame(spark, [])).count() == 0


def test_shards_of_a_huge_group(spark):
    rows = [(i, f"text number {i} of many") for i in range(2000)] + [(5000 + i, "one third of all rows x") for i in range(1000)]
    got = sharding.sharding_digest(frame(spark, [(d, t, "s") for d, t in rows])).collect()
    check_shards(rows, got, 24, 0.05)
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"one third of all rows x")}) <= 10


def test_slots_follow_the_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    rows = [(i, f"{i} " * (i % 50)) for i in range(3000)]
    docs = frame(spark, [(d, t, "s") for d, t in rows])
    key = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(text, 7) AS k").collect()}
    got = sharding.assign_shards(docs).collect()
    check_shards(rows, got, 24, 0.05)
    least = sum(r["size"] for r in got) / 24 / sharding.HEAVY
    light = sorted((r.shard, r.slot, key[r.doc_id]) for r in got if 8 < r["size"] <= least)
    assert len(light) > 2000 and all(a[2] <= b[2] for a, b in zip(light, light[1:]))


def test_heavy_groups_are_exact(spark):
    rng = random.Random(7)
    rows = [(rng.choice([5, -9, 2**62, rng.randrange(-(2**63), 2**63)]), rng.randint(1, 20)) for _ in range(2000)]
    total = {}
    for k, s in rows:
        b, n = total.get(k, (0, 0))
        total[k] = (b + s, n + 1)
    found = sharding.heavy_groups(spark.createDataFrame(rows, "key long, size long"), 300)
    assert sorted(found) == sorted((k, b, n) for k, (b, n) in total.items() if b > 300) and len(found) == 3


def test_splitters_are_exact(spark):
    rng = random.Random(5)
    keys = [(rng.randrange(-(2**63), 2**63), rng.randint(1, 50)) for _ in range(3000)]
    total = sum(s for _, s in keys)
    targets = [total * k / 8 for k in range(1, 8)]
    found = sharding.find_splitters(spark.createDataFrame(keys, "key long, size long"), targets, total / 8 * 0.0005)
    for f, t in zip(found, targets):
        assert abs(sum(s for k, s in keys if k < f) - t) <= 60
