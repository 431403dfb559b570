"""Lists as long as the largest tables make them, and scores on a bound."""

import random
import time

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from loam.functions.arrays import counted, first_of
from loam.functions.vectors import jaccard, set_overlap
from loam.operators import cognitive, enriched, enrichment, signal
from loam.plans import chunks, text

SF = "/root/testdata/sf0.001"


def test_first_and_counted_equal_plain_loops(spark):
    some = random.Random(3)
    rows = [(i, [some.choice("abcdef") for _ in range(some.choice([0, 1, 2, 9, 40]))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<string>")
    for i, first, n in df.select("i", first_of(F.col("a"), lambda x: x).alias("f"), counted(F.col("a")).alias("n")).collect():
        a = rows[i][1]
        assert first == list(dict.fromkeys(a))
        assert [tuple(x) for x in n] == [(v, a.count(v)) for v in sorted(set(a))]


def test_a_list_of_many_names(spark):
    """Time in proportion: each name was held against all others, or all were copied for each."""
    n = 40_000
    text = "".join(f"- Customer#{i:09d}\n" for i in range(n))
    df = spark.createDataFrame([(1, 0, text, ["Customers"])], "doc_id int, idx int, text string, heading_path array<string>").repartition(1)
    began = time.time()
    found = df.select(enrichment.entities(F.col("text"), F.lit("en")).alias("e")).first().e
    assert [e.surface for e in found[:2]] == ["Customer#000000000", "Customer#000000001"] and len(found) == n
    words = enriched.local_metadata(df).select("keywords").first().keywords
    assert words == [f"customer#{i:09d}" for i in range(5)]
    assert time.time() - began < 60


def test_split_points_of_a_long_curve(spark):
    """The percentile is taken once, not for each candidate."""
    n = 20_000
    some = random.Random(5)
    curve = [some.random() for _ in range(n)]
    df = spark.createDataFrame([(curve, list(range(n)))], "c array<double>, k array<int>")
    began = time.time()
    got = df.select(signal.split_indices(F.col("c"), F.col("k")).alias("s")).first().s
    bound, last, want = (sorted(curve)[n // 2 - 1] + sorted(curve)[n // 2]) / 2, -9, []
    for i, v in enumerate(curve):
        if v <= bound and i >= last + 2:
            want.append(i)
            last = i
    assert got == want and time.time() - began < 60


def test_groups_at_splits(spark):
    rows = spark.createDataFrame([("a", 10 * i) for i in range(5)] + [("b", 7)], "k string, o int")
    splits = spark.createDataFrame([("a", [0, 2])], "k string, splits array<int>")
    got = {(r.k, r.o): r.g for r in signal.grouped(rows, splits, "k", "o", "g").collect()}
    assert got == {("a", 0): 0, ("a", 10): 1, ("a", 20): 1, ("a", 30): 2, ("a", 40): 2, ("b", 7): 0}


def test_deviations_on_the_bound(spark):
    """Two scores that are 0.02 apart deviate by 0.01: which side of the bound that is, the SQL's rounding tells."""
    pairs = [(i / 1000, end) for i in range(-100, 700, 5) for end in (i / 1000 + 0.02, (i - 20) / 1000)]
    rows = pd.DataFrame([(d, k, v) for d, pair in enumerate(pairs) for k, v in enumerate(pair)], columns=["doc_id", "boundary_idx", "join_score"])
    con = duckdb.connect()
    con.register("scored", rows)
    told = con.sql("""SELECT doc_id, boundary_idx, s < 0.01 OR (join_score >= m - 0.5::DOUBLE * s AND join_score <= m + 0.5::DOUBLE * s) AS near, s >= 0.01 AND join_score < m - 0.5::DOUBLE * s AS low
      FROM (SELECT *, avg(join_score) OVER d AS m, stddev_pop(join_score) OVER d AS s FROM scored WINDOW d AS (PARTITION BY doc_id))""").fetchall()
    near, low = ({(d, k) for d, k, *x in told if x[at]} for at in (0, 1))
    df = spark.createDataFrame(rows)
    assert {(r.doc_id, r.boundary_idx) for r in cognitive.ambiguous(df).where("is_ambiguous").collect()} == near
    assert {(r.doc_id, r.boundary_idx) for r in cognitive.valleys(df).where("is_valley").collect()} == low
    flags = cognitive.ordered_scores(df, "doc_id", "boundary_idx", "join_score").select("doc_id", F.posexplode(cognitive.valley_flags(F.col("scores"))).alias("k", "is"))
    assert {(r.doc_id, r.k) for r in flags.where("`is`").collect()} == low


def test_types_without_texts(spark):
    some = random.Random(7)
    names = ("orphan", "discourse", "entity", "relation", "heading", "shift", "budget")
    df = spark.createDataFrame([(*[some.choice([0.2, 0.55, 0.9]) for _ in names], 40) for _ in range(80)] + [(0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1)], ", ".join(f"{n} double" for n in names) + ", tokens_so_far int")
    none = F.array().cast("array<string>")
    typed = cognitive.typed_reasons(F.col("reasons"), F.col("shift"), none, none)
    for r in df.withColumn("reasons", cognitive.reasons()).select(typed["type"].alias("a"), cognitive.reason_types().alias("b")).collect():
        assert r.a == r.b


def test_overlap_of_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), (["a"], None), (["x", "y", "z"], ["z", "x"])], "a array<string>, b array<string>")
    assert all(r.x == r.y for r in df.select(set_overlap(F.col("a"), F.col("b")).alias("x"), jaccard(F.col("a"), F.col("b")).alias("y")).collect())


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_queries_make_what_they_ask_for(spark):
    """No enrichment for markers, no windows for languages, three packings for three candidates."""
    assert "Window" not in planned(text.detected_language(spark, SF)) and "Window" not in planned(chunks.discourse_edges(spark, SF))
    assert planned(chunks.adaptive_winner(spark, SF)).count("Relation [") == 3
    assert "format_string" not in planned(chunks.boundary_reasons(spark, SF))


def test_language_of_the_first_lines(spark):
    want = enrichment.document_language(text.line_blocks(spark, SF, ("doc_id",)))
    assert sorted(map(tuple, text.detected_language(spark, SF).collect())) == sorted(map(tuple, want.collect()))
