import duckdb
from helpers import SF, frame, words

from loam.llm.mixing import SQL, emit_copies, mix_sources, mixing_digest, source_targets


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Excess reshared by weight until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > cap * sizes[n]}
        if not over:
            out.update({n: left * weight[n] / total for n in open_})
            break
        for n in over:
            out[n] = cap * sizes[n]
            left -= out[n]
        open_ -= over
    return out


def test_targets(spark):
    for sizes in ({"a": 10, "b": 100, None: 50}, {"a": 1, "b": 1, "c": 1000, "d": 3, "é": 20}, {"a": 0, "b": 5}, {"x": 0}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_edge_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y", "t"), (None, None, "t"), (4, "w " * 50000, "t")]
    got = mixing_digest(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((d or 0, len(words(t))) for d, t, _ in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing_digest(frame(spark, [])).count() == 0


def test_near_target_and_rerun(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 3}") for i in range(3000)]
    first = mixing_digest(frame(spark, rows).repartition(7)).collect()
    again = mixing_digest(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    taken, target = {}, {}
    for r in first:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[k] - target[k]) <= 0.01 * target[k] + 40 for k in taken)


def test_ranks_over_many_cells(spark):
    """With cells of five rows each source's ranks run from 1 to its row count: copies differ by one at most."""
    rows = [(i if i % 3 else None, "w " * (i % 23) + f"x{i}", "s") for i in range(900)]
    got = mix_sources(frame(spark, rows), cell_rows=5).collect()
    rate = got[0].target / got[0].source_size
    assert len(got) == 900 and {r.copies for r in got} <= {int(rate), int(rate) + 1}
    assert abs(sum(r.copies for r in got) - 900 * rate) <= 1
    plain = mix_sources(frame(spark, rows), cell_rows=5, whole_rows=False).collect()
    assert sorted((r.doc_id or -1, r.size, r.copies) for r in got) == sorted((r.doc_id or -1, r.size, r.copies) for r in plain)


def test_copies_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8), (2, "c", "t", 9, 10)], "doc_id long, text string, source string, size int, copies int")
    out = emit_copies(mix_sources(docs))
    assert out.columns == docs.columns and set(out.collect()) <= set(docs.collect())


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted((r[0], r[1], r[2], round(r[3], 4), r[4]) for r in con.sql(SQL).fetchall())
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4), r["taken"]) for r in mixing_digest(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == want
