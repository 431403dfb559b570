import random

import corpus_pipeline
from helpers import DOCS, SF, brute_contamination, brute_score, near_brute, words

from loam.llm import mixing, toxicity


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_run(spark):
    """The stages' rows against brute force of their own: a plain model for each stage, given the trained weights."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if brute_score(model.weights, model.bias, r[1]) < 0.5]
    first = {g[0] for g in near_brute([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contamination([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in bad]
    copies = {r.doc_id: r.copies for r in mixing.mixing_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    final = corpus_pipeline.run(spark, SF).collect()
    taken, size = {}, {}
    for r in final:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    assert taken == {d: n for d, n in copies.items() if n} and bad and len(first) < len(docs.collect())
    text = {r[0]: r[1] for r in rows}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 8 for r in final) and sum(len(words(t)) for t in text.values())
    assert len(size) == 24 and max(size.values()) <= 1.5 * sum(size.values()) / 24
    assert all(sorted(r.slot for r in final if r.shard == s) == list(range(sum(r.shard == s for r in final))) for s in size)


def test_edge_tables(spark):
    """Nulls, repeats and clashing extra columns go through every stage; so does an empty table."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 4 for _ in range(30)), "en", f"s{i % 2}", 1) for i in range(30)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (3, rows[3][1], "en", "s1", 1), (90, "", "en", None, 0), (91, "word " * 30000, None, "s0", None)]
    schema = DOCS + ", size int, score double, copies int, row string, bad_id long, shard int"
    docs = spark.createDataFrame([(*r, 1, 2.0, 3, "r", 4, 5) for r in rows], schema)
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name != "sharding":
                assert out.columns == docs.columns, name
            now = spark.createDataFrame(out.collect(), out.schema)
        assert (now.count() > 0) == (frame is docs)
