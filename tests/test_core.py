"""Splitting, chunking, merging: fixed examples, invariants, and a plain model against random input."""

import random

import pytest
from pyspark.sql import functions as F

from loam.functions.text import parse_escapes, parse_patterns
from loam.operators import merging, splitting
from loam.operators.chunking import chunk, chunk_spans


def pieces(text, size, delims=b"\n.?", **modes):
    raw = text.encode()
    return [raw[a:b].decode() for a, b in chunk_spans(raw, size, delims, **modes)]


def test_chunk_examples():
    assert pieces("Hello. World. Test.", 10, b".") == ["Hello.", " World.", " Test."]
    assert pieces("Line one\nLine two\nLine three", 15, b"\n") == ["Line one\n", "Line two\n", "Line three"]
    assert pieces("abcdefghij", 5, b".") == ["abcde", "fghij"]
    assert pieces("", 10) == [] and pieces("Small", 100) == ["Small"]
    assert pieces("Hello World Test", 8, b" ", prefix=True) == ["Hello", " World", " Test"]
    assert pieces("Hello World Test", 8, b" ") == ["Hello ", "World ", "Test"]
    assert pieces("Hello\n\n\nWorld", 8, b"\n", prefix=True, consecutive=True) == ["Hello", "\n\n\nWorld"]
    assert pieces("verylongword next", 6, b" ", prefix=True, forward_fallback=True) == ["verylongword", " next"]
    assert pieces("Hello▁World▁Test", 15, b"", pattern="▁".encode(), prefix=True) == ["Hello", "▁World▁Test"]
    assert pieces("abcdef", 0, b"") == list("abcdef")


@pytest.mark.parametrize("modes", [{}, {"prefix": True}, {"consecutive": True}, {"forward_fallback": True}, {"consecutive": True, "forward_fallback": True, "prefix": True}, {"pattern": b"ab"}])
def test_chunk_keeps_bytes_and_moves_on(modes):
    random.seed(1)
    for _ in range(300):
        raw = bytes(random.choice(b"ab. \n") for _ in range(random.randint(0, 60)))
        spans = chunk_spans(raw, random.randint(1, 12), b". \n", **modes)
        assert b"".join(raw[a:b] for a, b in spans) == raw
        assert all(a < b for a, b in spans)


def test_chunk_frame_with_cut_character(spark):
    rows = chunk(spark.createDataFrame([(1, "ééé"), (2, None), (3, "")], "doc_id long, text string"), 3, delimiters="").orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.text, r.offset, r.length) for r in rows] == [(1, "é�", 0, 3), (1, "�é", 3, 3)]


def texts(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.text, r.offset) for r in splitting.split(df, **options).orderBy("idx").collect()]


def test_split_examples(spark):
    assert texts(spark, "Hello. World. Test.", delimiters=".") == [("Hello.", 0), (" World.", 6), (" Test.", 13)]
    assert texts(spark, "Hello. World. Test.", delimiters=".", attach="next") == [("Hello", 0), (". World", 5), (". Test", 12), (".", 18)]
    assert texts(spark, "a..b", delimiters=".", attach="none") == [("a", 0), ("b", 3)]
    assert texts(spark, "é.x", delimiters=".") == [("é.", 0), ("x", 3)]
    assert texts(spark, "whole", delimiters="") == [("whole", 0)] and texts(spark, "") == [] and texts(spark, None) == []
    assert texts(spark, "a]b^c-d", delimiters="]^-") == [("a]", 0), ("b^", 2), ("c-", 4), ("d", 6)]


def model_min(segments, least):
    out, acc = [], b""
    for s in segments:
        if acc and not (len(acc) < least or len(s) < least):
            out.append(acc)
            acc = s
        else:
            acc += s
    return out + ([acc] if acc else [])


def test_min_bytes_model(spark):
    random.seed(2)
    rows = [(i, "".join(random.choice("abé. ") for _ in range(80))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in splitting.split(df, ".", min_bytes=9).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, text in rows:
        raw = text.encode()
        segs = [x + b"." for x in raw.split(b".")[:-1]] + ([raw.split(b".")[-1]] if raw.split(b".")[-1] else [])
        assert got.get(i, []) == [x.decode() for x in model_min(segs, 9)]


def test_split_patterns(spark):
    df = spark.createDataFrame([(1, "Hello. World. Test.")], "doc_id long, text string")
    one = lambda p, a: [r.text for r in splitting.split_patterns(df, p, a).orderBy("idx").collect()]
    assert one([". "], "prev") == ["Hello. ", "World. ", "Test."]
    assert one([". "], "next") == ["Hello", ". World", ". Test."]
    assert one([". "], "none") == ["Hello", "World", "Test."]
    assert one(["zz"], "prev") == ["Hello. World. Test."] and one([], "prev") == ["Hello. World. Test."]


def model_cut(raw, delimiters, attach):
    out, held = [], b""
    for x in raw:
        c = bytes([x])
        if c not in [bytes([d]) for d in delimiters]:
            held += c
        elif attach == "prev":
            out, held = [*out, held + c], b""
        elif attach == "next":
            out, held = [*out, held], c
        else:
            out, held = [*out, held], b""
    return [x for x in [*out, held] if x]


def test_delimiters_beyond_ascii_are_their_bytes(spark):
    random.seed(4)
    for attach in splitting.ATTACH:
        for _ in range(60):
            raw = "".join(random.choice("aé€.") for _ in range(random.randint(0, 30))).encode()
            assert [raw[a:b] for a, b in splitting.cut_bytes(raw, "é.".encode(), attach)] == model_cut(raw, "é.".encode(), attach)
    assert texts(spark, "aéb", delimiters="é") == [("a\ufffd", 0), ("\ufffd", 2), ("b", 3)] and texts(spark, None, delimiters="é") == []


def test_a_million_segments(spark):
    df = spark.createDataFrame([(1, "a. " * 200_000)], "doc_id long, text string")
    rows = merging.merge(df, splitting.split_spans(F.col("text")), 100)
    assert rows.agg(F.count("*"), F.sum("length"), F.max(F.col("offset") + F.col("length"))).first()[:] == (2000, 600_000, 600_000)


def test_merge_endpoint(spark):
    df = spark.createDataFrame([(1, ["a b", "c é", "d e f", "g"]), (2, [])], "doc_id long, chunks array<string>")
    got = [tuple(r)[1:] for r in merging.merge_chunks(df, 4).orderBy("idx").collect()]
    assert got == [(0, "a bc é", 0, 7, 4), (1, "d e fg", 7, 6, 4)]


def test_parsing():
    assert parse_escapes(r"\n\t\\\x") == "\n\t\\\\x"
    assert parse_patterns(r"a,,b\n") == ["a", "b\n"]


def model_ends(counts, budget):
    ends, at = [], 0
    while at < len(counts):
        to, used = at + 1, counts[at]
        while to < len(counts) and used + counts[to] <= budget:
            used += counts[to]
            to += 1
        ends.append(to)
        at = to
    return ends


def test_merge_model_and_examples(spark):
    random.seed(3)
    cases = [([1] * 7, 3), ([10, 15, 20, 5, 8, 12], 30), ([], 3), ([50, 60, 70], 30), ([0, 100, 0], 30)] + [([random.randint(0, 9) for _ in range(random.randint(1, 20))], 12) for _ in range(30)]
    df = spark.createDataFrame([(i, c, [str(k) for k in range(len(c))]) for i, (c, _) in enumerate(cases)], "i int, c array<int>, s array<string>")
    for budget in {b for _, b in cases}:
        rows = df.select("i", merging.merge_indices(F.col("c"), budget).alias("e"), merging.merge_splits(F.col("s"), F.col("c"), budget).alias("m")).collect()
        for r in rows:
            counts, own = cases[r.i]
            if own == budget:
                ends = model_ends(counts, budget)
                assert r.e == ends
                starts = [0, *ends[:-1]]
                assert r.m.token_counts == [sum(counts[a:b]) for a, b in zip(starts, ends)]
                assert r.m.merged == ["".join(map(str, range(a, b))) for a, b in zip(starts, ends)]


def test_merge_of_unequal_lengths(spark):
    df = spark.createDataFrame([(["a", "b"], [1])], "s array<string>, c array<int>")
    assert df.select(merging.merge_splits(F.col("s"), F.col("c"), 9).alias("m")).first().m.merged == ["a", "b"]


def test_merged_bytes_and_order(spark):
    df = spark.createDataFrame([(1, "One two. Three? Four\nfive six seven.")], "doc_id long, text string")
    rows = merging.merge(df, splitting.split_spans(F.col("text")), 3).orderBy("idx").collect()
    assert "".join(r.text for r in rows) == "One two. Three? Four\nfive six seven." and all(r.tokens <= 4 for r in rows)
