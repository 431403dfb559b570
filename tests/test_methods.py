"""Scored methods on hand-made blocks, and recurrences against plain models."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam import api
from loam.operators import adaptive, cognitive, enriched, enrichment, graph, intent, metrics, segmentation, signal, topology

BLOCKS = "doc_id long, block_idx int, text string, offset_start int, offset_end int, kind string, lang string"


def blocks(spark, *texts, kinds=None, doc=1):
    rows, at = [], 0
    for i, t in enumerate(texts):
        rows.append((doc, i, t, at, at + len(t.encode()), kinds[i] if kinds else "Sentence", "en"))
        at += len(t.encode()) + 1
    return spark.createDataFrame(rows, BLOCKS)


def test_valleys_and_band(spark):
    def run(values):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "doc_id long, boundary_idx int, join_score double")
        low = {r.boundary_idx for r in cognitive.valleys(df).where("is_valley").collect()}
        band = {r.boundary_idx for r in cognitive.ambiguous(df).where("is_ambiguous").collect()}
        return low, band

    assert run([0.8, 0.7, 0.2, 0.6, 0.9])[0] == {2}
    assert run([0.90, 0.89, 0.90, 0.91])[0] == set()
    assert run([0.9, 0.55, 0.1, 0.5, 0.85])[1] == {1, 3}
    assert run([0.5, 0.5001, 0.5])[1] == {0, 1, 2}


def test_score_terms(spark):
    rows = enrichment.enrich(blocks(spark, "# Title", "It uses Big Data.", "Furthermore, Big Data grows.", kinds=["Heading", "Sentence", "Sentence"])).withColumn("sim", F.lit(0.4))
    got = {r.boundary_idx: r for r in cognitive.score_boundaries(rows, soft=10).collect()}
    a, b = got[0], got[1]
    assert (a.struct, a.orphan, a.heading, a.sim) == (0.9, 1.0, 1.0, 0.4)
    assert b.discourse == 0.9 and b.orphan == pytest.approx(0.4 + (b.entity * 2 - 1) * 0.3 if b.entity > 0.65 else b.orphan)
    assert a.budget == pytest.approx(min(max(7 / 10 - 0.5, 0), 1)) and b.tokens_so_far == 14
    assert a.reasons[0] == "high orphan risk" and "topic shift" not in " ".join(a.reasons)
    want = 0.3 * 0.4 + 0.2 * a.entity + 0.1 * 0 + 0.1 * 1 + 0.05 * 0.9 + 0.2 * 1 - 0.15 * 0.6 - 0.1 * a.budget
    assert a.join_score == pytest.approx(want)


def test_typed_reasons(spark):
    df = spark.createDataFrame([(["high orphan risk", "heading change", "budget pressure (512 tokens)"], ["A"], ["A", "B"]), ([], [], [])], "r array<string>, f array<string>, t array<string>")
    got = [r.x for r in df.select(cognitive.typed_reasons(F.col("r"), F.lit(0.25), F.col("f"), F.col("t")).alias("x")).collect()]
    assert [x.type for x in got[0]] == ["ContinuationGlue", "HeadingChange", "BudgetCeiling"]
    assert got[0][1]["from"] == "A" and got[0][1]["to"] == "A > B" and got[0][2].tokens == 512
    assert [(x.type, x.value) for x in got[1]] == [("TopicShift", 0.25)]


def model_heal(tokens, heals, hard):
    out, used = [0], tokens[0]
    for t, h in zip(tokens[1:], heals):
        if h and used + t <= hard:
            out.append(out[-1])
            used += t
        else:
            out.append(out[-1] + 1)
            used = t
    return out


def test_heal_model(spark):
    rng = random.Random(1)
    chunks, glue, want = [], [], {}
    for d in range(20):
        n = rng.randint(1, 9)
        tokens, heals = [rng.randint(1, 9) for _ in range(n)], [rng.random() < 0.6 for _ in range(n - 1)]
        want[d] = model_heal(tokens, heals, 15)
        chunks += [(d, k, f"t{k} ", k, k + 1, tokens[k], ["h"], 0.5, ["e"], ["e"], k, k) for k in range(n)]
        glue += [(d, k, h, False, None, 0.0, 0.0) for k, h in enumerate(heals)]
    c = spark.createDataFrame(chunks, "doc_id long, chunk int, text string, offset_start int, offset_end int, tokens long, heading_path array<string>, confidence double, dominant array<string>, all_entities array<string>, first_block int, last_block int")
    s = spark.createDataFrame(glue, "doc_id long, boundary_idx int, pronoun boolean, demonstrative boolean, marker string, entity double, sim double")
    got = {}
    for r in cognitive.heal(c, s, hard=15).collect():
        got.setdefault(r.doc_id, {})[r.idx] = (r.first_block, r.last_block)
    for d, groups in want.items():
        assert [got[d][g] for g in sorted(got[d])] == [(ks[0], ks[-1]) for ks in ([k for k, x in enumerate(groups) if x == g] for g in sorted(set(groups)))]


def test_rates(spark):
    signals = spark.createDataFrame(
        [(1, 0, 0.5, False, False, None, True, False), (1, 1, 0.8, True, False, None, False, True), (1, 2, 0.0, False, True, "Contrast", True, False)],
        "doc_id long, boundary_idx int, entity double, pronoun boolean, demonstrative boolean, marker string, left_heading boolean, right_heading boolean",
    )
    flags = spark.createDataFrame([(1, [True, False, True])], "doc_id long, flags array<boolean>")
    r = cognitive.evaluation_rates(signals, flags).first()
    assert (r.entity_orphan_rate, r.pronoun_boundary_rate, r.heading_attachment_rate, r.discourse_break_rate, r.n_breaks) == (0.5, 0.5, 0.0, 0.5, 2)
    assert cognitive.evaluation_rates(signals, flags).select(api.format_rates().alias("x")).first().x.startswith("entity orphan rate 50.0%")


def test_graph(spark):
    chunks = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a"]), (1, 2, ["a"])], "doc_id long, idx int, all_entities array<string>")
    got = {(r.source, r.target, r.type, r.entity) for r in graph.edges(chunks).collect()}
    assert got == {(0, 1, "adjacency", None), (1, 2, "adjacency", None), (0, 1, "entity_link", "a"), (1, 2, "entity_link", "a")}
    m = graph.metadata(chunks, chunks).first()
    assert (m.chunk_count, m.edge_count, m.shared_entity_count) == (3, 4, 1)


def test_metrics(spark):
    def frame(*texts):
        return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, idx int, text string")

    words = lambda n: "word " * n
    sc = lambda *t: metrics.size_compliance(frame(*t), "doc_id").first().sc
    assert (sc(words(300)), sc(words(5)), sc(words(400), words(3))) == (1.0, 0.0, 0.5)
    rc = lambda *t: metrics.reference_completeness(frame(*t), "doc_id").first().rc
    assert (rc("A.", "B.", "C."), rc("A.", "It is."), rc("It."), rc("A.", "They go", "Big")) == (1.0, 0.0, 1.0, 0.5)
    assert rc("A.", " it is") == 1.0
    b = spark.createDataFrame([(1, 0, 10, "Table"), (1, 20, 30, "List"), (1, 0, 99, "Heading")], "doc_id long, offset_start int, offset_end int, kind string")
    c = spark.createDataFrame([(1, 0, 0, 12), (1, 1, 12, 25)], "doc_id long, idx int, offset_start int, offset_end int")
    assert metrics.block_integrity(c, b, "doc_id").first().bi == 0.5
    assert metrics.block_integrity(c, b.where("kind = 'x'"), "doc_id").first().bi == 1.0
    assert metrics.parse_weights("sc=0.5, block_integrity=0.1")["bi"] == 0.1
    with pytest.raises(ValueError):
        metrics.parse_weights("nope=1")


def brute_partition(vectors, tokens, intents, soft, hard):
    n, best = len(vectors), (-1e9, None)
    for cuts in itertools.product([False, True], repeat=n - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
        spans = list(zip([0, *ends[:-1]], ends))
        if any(sum(tokens[a:b]) > hard and b - a > 1 for a, b in spans):
            continue
        total = 0.0
        for a, b in spans:
            c = np.mean(vectors[a:b], axis=0)
            cos = [float(c @ q / (np.linalg.norm(c) * np.linalg.norm(q))) if np.linalg.norm(c) * np.linalg.norm(q) > 1e-12 else 0.0 for q in intents]
            total += max(0.0, max(cos)) - abs(sum(tokens[a:b]) / soft - 1) * 0.1
        if total > best[0] + 1e-12:
            best = (total, spans)
    return best


def test_partition_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        vectors, intents, tokens = rng.normal(size=(n, 3)), rng.normal(size=(2, 3)), rng.integers(1, 9, n)
        spans, score = intent.best_partition(vectors, tokens, intents, 8, 14)
        total, _ = brute_partition(vectors, tokens.tolist(), intents, 8, 14)
        assert score * len(spans) == pytest.approx(total)
    with pytest.raises(ValueError):
        intent.best_partition(np.ones((1, 2)), np.ones(1), np.ones((1, 2)), 0)


def test_best_intent_and_no_intents(spark):
    df = spark.createDataFrame([([1.0, 0.0], [[0.0, 1.0], [2.0, 0.0], [1.0, 0.0]])], "v array<double>, q array<array<double>>")
    m = df.select(intent.best_intent(F.col("v"), F.col("q")).alias("m")).first().m
    assert (m.intent, m.score) == (1, 1.0)
    rows = spark.createDataFrame([(1, 0, 3, [1.0]), (1, 1, 4, [1.0])], "doc_id long, block_idx int, tokens int, embedding array<double>")
    none = spark.createDataFrame([], "doc_id long, intent_idx int, embedding array<double>")
    assert [tuple(r) for r in intent.partition(rows, none).collect()] == [(1, 0, 0, 2, 0.0)]


def test_section_tree(spark):
    rows = blocks(spark, "# A", "x", "## B", "### C", "y", "## D", kinds=["Heading", "Sentence", "Heading", "Heading", "Sentence", "Heading"])
    got = {r.node_id: (r.parent_id, r.node_type, r.level, r.start, r.end, r.tokens) for r in topology.section_tree(rows).collect()}
    assert got == {
        0: (None, "section", 0, 0, 6, 5), 1: (0, "section", 1, 0, 6, 5), 2: (1, "block", None, 1, 2, 1), 3: (1, "section", 2, 2, 5, 3),
        4: (3, "section", 3, 3, 5, 2), 5: (4, "block", None, 4, 5, 1), 6: (1, "section", 2, 5, 6, 1),
    }


def test_preview(spark):
    df = spark.createDataFrame([("a" * 199 + "é!",), ("short",)], "t string")
    assert [r.x for r in df.select(topology.preview(F.col("t")).alias("x")).collect()] == ["a" * 199 + "...", "short"]


def test_enriched_groups_and_merges(spark):
    rows = blocks(spark, "a b c", "d e", "## H", "f", "g h i j", kinds=["Sentence", "Sentence", "Heading", "Sentence", "Table"]).withColumn("heading_path", F.array(F.col("kind")))
    got = [(r.idx, r.text, r.tokens, r.heading_path) for r in enriched.initial_groups(rows, soft=4).orderBy("idx").collect()]
    assert got == [(0, "a b c", 3, ["Sentence"]), (1, "d e", 2, ["Sentence"]), (2, "## Hf", 3, ["Sentence"]), (3, "g h i j", 4, ["Table"])]
    chunks = spark.createDataFrame(
        [(1, 0, "t0", 10, ["x", "X"]), (1, 1, "t1", 10, ["y"]), (1, 2, "t2", 10, ["x", "y"]), (1, 3, "t3", 10, ["z"]), (1, 4, "t4", 95, ["z"])], "doc_id long, idx int, text string, tokens int, semantic_keys array<string>"
    )
    plan = enriched.merge_plan(chunks, hard=100)
    assert [(r.result, r.sources, r.shared_key) for r in enriched.merge_records(plan).collect()] == [(1, [1, 2], "y")]


def test_screening(spark):
    docs = spark.createDataFrame([(1, "word " * 600), (2, "few words")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 0, "x", "Sentence"), (2, 0, "# A", "Heading"), (2, 1, "## B", "Heading")], "doc_id long, block_idx int, text string, kind string")
    got = {(r.doc_id, r.method): r.included for r in adaptive.pre_screen(docs, rows, (*adaptive.METHODS, "other")).collect()}
    assert [got[1, m] for m in (*adaptive.METHODS, "other")] == [True, True, False, True, False, False]
    assert [got[2, m] for m in (*adaptive.METHODS, "other")] == [True, True, True, False, True, False]
    assert adaptive.pre_screen(docs, rows, force=True).where("included").count() == 10
    assert adaptive.pre_screen(docs, rows, has_model=False).select("method").distinct().count() == 2
    with pytest.raises(ValueError):
        adaptive.pre_screen(docs, rows, ("topo",), has_model=False)


def test_language_is_detected_where_it_is_not_known(spark):
    docs = spark.createDataFrame(
        [(1, "However, the cat is on the mat.", None), (1, "Der Hund und die Katze sind auf der Matte.", "xx"), (2, "However, x.", "English"), (None, "However, the dog is not here.", "auto")], "doc_id long, text string, lang string"
    )
    got = sorted((r.doc_id or 0, r.lang, r.marker) for r in api.prepared_blocks(docs).collect())
    assert got == [(0, "en", "Contrast"), (1, "de", None), (1, "en", "Contrast"), (2, "en", "Contrast")]


def test_one_block_lists_all_its_entities(spark):
    rows = enrichment.enrich(blocks(spark, "the Ann the Bob the Cid the Dan the Eve the Fay the Gus")).withColumn("sim", F.lit(0.5))
    chunks = cognitive.cognitive_chunks(rows)[0].collect()
    assert [sorted(c.dominant) for c in chunks] == [["ann", "bob", "cid", "dan", "eve", "fay", "gus"]]


def test_merged_entities_unite_by_name_and_records_are_renumbered(spark):
    entity = "array<struct<name:string,entity_type:string>>"
    chunks = spark.createDataFrame(
        [(1, i, f"t{i}", 0, 1, 5, "t", "s", "c", ["k"], [("A", f"T{i}"), ("B", "T")], ["q"], keys) for i, keys in enumerate((["x"], ["x"], ["y"], ["y"]))],
        f"doc_id long, idx int, text string, offset_start int, offset_end int, tokens int, title string, summary string, category string, keywords array<string>, typed_entities {entity}, hypothetical_questions array<string>, semantic_keys array<string>",
    )
    out = enriched.recombine(chunks).orderBy("idx").collect()
    assert [[(e.name, e.entity_type) for e in r.typed_entities] for r in out] == [[("A", "T0"), ("B", "T")], [("A", "T2"), ("B", "T")]]
    assert sorted((r.result, r.sources) for r in enriched.merge_records(enriched.merge_plan(chunks)).collect()) == [(0, [0, 1]), (1, [2, 3])]


def test_chunk_references(spark):
    parts = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 4), (1, 2, 4, 6)], "doc_id long, part int, start int, end int")
    links = spark.createDataFrame([(1, 0, 5), (1, 1, 3), (1, 2, 3)], "doc_id long, source int, target int")
    assert {r.part: r.chunk_references for r in topology.chunk_references(parts, links).collect()} == {0: [1, 2], 1: [0], 2: [0]}


def test_best_chunks_skips_a_failing_candidate(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, "Plain text. Two sentences.")], "doc_id long, text string")

    def run(docs, method, rows):
        if method == "cognitive":
            raise ValueError("out of order")
        return api.chunk_documents(docs, method, rows)

    chunks, report = api.best_chunks(docs, ("semantic", "cognitive", "topo"), run=run, force=True)
    told = {(r.doc_id, r.method): r for r in report.collect()}
    assert told[1, "cognitive"].failure == "ValueError: out of order" and told[1, "cognitive"].composite is None and told[1, "semantic"].composite is not None
    assert {r.doc_id: r.method for r in chunks.collect()}.keys() == {1, 2} and sum(r.won for r in told.values()) == 2
    assert all("section_classification" in r.details for r in chunks.collect() if r.method == "topo")
    assert {r.method for r in api.best_chunks(docs, ("semantic", "topo"), has_model=False)[1].collect()} == {"semantic"}
    with pytest.raises(ValueError, match="all candidate methods failed"):
        api.best_chunks(docs, ("cognitive",), run=run)


def test_job_writes_every_sink(spark, tmp_path, capsys):
    import json

    spark.createDataFrame([(1, MARKDOWN, "en"), (2, "Plain text. Two sentences.", None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "in"))
    at = lambda name: str(tmp_path / name)
    api.main(["cognitive", at("in"), at("out"), "--format", "jsonl", "--signals", at("signals"), "--graph", at("graph"), "--stats", "--soft", "40", "--hard", "60"])
    rows = [json.loads(r.value) for r in spark.read.json(at("out")).collect()]
    assert list(rows[0])[:5] == ["index", "text", "offset_start", "offset_end", "length"] and {"dominant_entities", "token_estimate", "continuity_confidence"} <= set(rows[0])
    graph_ = [json.loads(r.value) for r in spark.read.json(at("graph")).collect()]
    assert all(len(g["nodes"]) == g["metadata"]["chunk_count"] and len(g["edges"]) == g["metadata"]["edge_count"] for g in graph_) and len(graph_) == 2
    assert spark.read.json(at("signals")).count() > 0 and "avg_tokens" in capsys.readouterr().out
    api.main(["semantic", at("in"), at("plain"), "--format", "plain", "--merge", "5", "--lang", "German"])
    assert "Plain text." in "".join(r.value for r in spark.read.text(at("plain")).collect())


def test_winner_order(spark):
    s = spark.createDataFrame([(1, "a", 0, 0.5, 3), (1, "b", 1, 0.5, 2), (1, "c", 2, 0.5, 2), (2, "a", 0, 0.1, 1), (2, "b", 1, 0.9, 9)], "doc_id long, method string, ord int, composite double, chunk_count long")
    assert {r.doc_id: r.method for r in adaptive.winners(s).collect()} == {1: "b", 2: "b"}


MARKDOWN = "# Guide\n\nAlpha Beta is here. It works well. However, Gamma Delta differs.\n\n## Part\n\n- one\n- two\n\nLast Words of Alpha Beta end.\n"


@pytest.mark.parametrize("method", ["chunk", "split", "patterns", "merge"])
def test_plain_methods(spark, method):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, "Plain text. Two sentences."), (3, ""), (4, None)], "doc_id long, text string")
    out = api.chunk_documents(docs, method, **({"patterns": [". "]} if method == "patterns" else {}))
    assert {r.doc_id for r in out.select("doc_id").collect()} == {1, 2} and "text" in out.columns


def test_block_methods(spark, tmp_path):
    """All block methods on rows prepared once."""
    docs = spark.createDataFrame([(1, MARKDOWN), (2, "Plain text. Two sentences."), (3, ""), (4, None)], "doc_id long, text string")
    api.prepared_blocks(docs, lang="en").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for method in ("semantic", "cognitive", "intent", "topo", "enriched"):
        out = api.chunk_documents(docs, method, rows)
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {1, 2}, method


def test_candidates(spark):
    chunks = spark.createDataFrame([(1, 0, "a", 0, 1), (2, 0, "b", 0, 1)], "doc_id long, idx int, text string, offset_start int, offset_end int")
    screened = spark.createDataFrame([(1, "x", 0, True, ""), (2, "x", 0, False, ""), (1, "y", 1, True, ""), (2, "y", 1, True, "")], "doc_id long, method string, ord int, included boolean, reason string")
    all_ = adaptive.candidate_chunks({"x": chunks, "y": chunks}, screened)
    assert {(r.doc_id, r.method) for r in all_.collect()} == {(1, "x"), (1, "y"), (2, "y")}
    scores = spark.createDataFrame([(1, "x", 0, 0.9, 1), (1, "y", 1, 0.8, 1), (2, "y", 1, 0.1, 1)], "doc_id long, method string, ord int, composite double, chunk_count long")
    assert {(r.doc_id, r.method) for r in adaptive.adaptive_chunks(all_, scores).collect()} == {(1, "x"), (2, "y")}
    assert adaptive.report(scores, screened).where("won").count() == 2


def test_sql_functions(spark):
    names = api.register_functions(spark)
    assert spark.sql("SELECT loam_words('a b  c') w, loam_cosine(array(1D, 0D), array(1D, 0D)) c, loam_jaccard(array('a'), array('a', 'b')) j").first()[0:3] == (3, 1.0, 0.5) and len(names) == 5


def test_semantic_single_block(spark):
    from loam.operators import semantic

    rows = spark.createDataFrame([(1, 0, "One sentence only", 0, [1.0])], "doc_id long, block_idx int, text string, offset_start int, embedding array<double>")
    assert [(r.idx, r.text) for r in semantic.semantic_chunks(rows).collect()] == [(0, "One sentence only")]
    assert signal.SIM_WINDOW == 3 and segmentation.MAX_BLOCKS == 10_000
