import random
import zlib

import numpy as np
import pytest
from helpers import SF, brute_contamination, brute_score, frame

from loam.llm import decontaminate, toxicity
from loam.llm.decontaminate import GAP, MATCH, MISMATCH, align


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
    return max(map(max, h))


def test_align():
    rng = random.Random(1)
    pairs = [([rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(1, 20))]) for _ in range(80)]
    best, end = align([a for a, _ in pairs], [b for _, b in pairs])
    assert best.tolist() == [brute_align(a, b) for a, b in pairs]


def test_leaks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for k, (i, text) in enumerate(items[:10]):
        w = text.split()
        if k % 3 == 1:
            w[5], w[14] = "changed", "other"
        elif k % 3 == 2:
            del w[8]
            w.insert(15, "more")
        docs.append((k, f"{filler(40)} {' '.join(w).upper() if k == 4 else ', '.join(w) if k == 6 else ' '.join(w)} {filler(30)}"))
        want.add((k, i))
    docs += [(100 + k, filler(200)) for k in range(20)] + [(300, None), (301, ""), (None, items[0][1]), (302, items[1][1]), (302, items[1][1])]
    want |= {(None, 0), (302, 1)}
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "one two")], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, [(d, t, "s") for d, t in docs]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    whole = next(r for r in got if r.doc_id == 302)
    assert (whole.score, whole.first_word, whole.last_word) == (1.0, 0, 25)
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, [(1, "a b c", "s")]), bench.limit(0)).count() == 0


def test_common_passage_keeps_its_seeds(spark):
    """A leak in most documents is found in all of them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = " ".join(word() for _ in range(20))
    docs = [(i, " ".join(word() for _ in range(30)) + " " + item) for i in range(60)]
    got = decontaminate.contaminated(frame(spark, [(d, t, "s") for d, t in docs]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.count() == 60


def test_edited_copy_beside_verbatim_leaks(spark):
    """Verbatim leaks make the seeds that an edited copy kept the common ones of their item; the copy is found still."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(25)]
    edited = [word() if k % 5 == 4 else w for k, w in enumerate(item)]
    for leaks in (1, 30):
        docs = [(i, " ".join([word() for _ in range(30)] + item)) for i in range(leaks)]
        docs += [(100, " ".join([word() for _ in range(30)] + edited)), (101, " ".join([word() for _ in range(40)] + item[:3]))]
        bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        got = {r.doc_id: r.score for r in decontaminate.contaminated(frame(spark, [(d, t, "s") for d, t in docs]), bench).collect()}
        assert set(got) == {*range(leaks), 100}
        assert got[100] == brute_align(item, edited) / (MATCH * 25)
    stray = [(i, " ".join(word() for _ in range(20)), 0, 1, " ".join(item)) for i in range(600)] + [(600, " ".join(item), 0, 1, " ".join(item))]
    pairs = spark.createDataFrame(stray, "doc_id long, passage string, first long, item_id long, item string").coalesce(1)
    assert [r.doc_id for r in decontaminate.aligned(pairs).collect()] == [600]


def test_contamination_brute_force(spark):
    """Items of all lengths against whole documents: edited, cut and moved copies, short items, other kinds of space."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(3)) for _ in range(150)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([4, 6, 9, 15, 40])))) for i in range(12)]
    items += [(20, "Zebra"), (21, "quagga, stripe"), (22, None), (23, "..."), (24, "non\u00a0breaking kept\u3000whole here now")]
    docs = []
    for d in range(120):
        parts = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            copy = [w for w in (rng.choice(items)[1] or "").split(" ") if rng.random() > 0.12]
            parts[rng.randint(0, len(parts)) : 0] = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in copy]
        docs.append((d, " ".join(parts)))
    docs += [(200, "a zebra! ran"), (201, "quagga\x1fstripe"), (202, "quagga no stripe"), (203, "non\u00a0breaking kept\u3000whole here now"), (204, None), (205, "")]
    table = frame(spark, [(d, t, "s") for d, t in docs]).repartition(3)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contamination(docs, items)
    assert got == want and {(200, 20), (201, 21), (203, 24)} <= set(got) and len(want) > 40


def test_passages_reach_as_far_as_their_items(spark):
    """One long item does not widen the passages of a short one."""
    words = [f"w{i}" for i in range(400)]
    items = spark.createDataFrame([(1, " ".join(words[100:110])), (2, " ".join(f"z{i}" for i in range(300)))], "item_id long, text string")
    seeds = decontaminate.item_seeds(items)
    table = decontaminate.reach_table(seeds)
    got = decontaminate.seeded_passages(frame(spark, [(1, " ".join(words), "s")]), table, [3]).collect()
    assert [(r.first, len(r.passage.split())) for r in got] == [(84, 42)]


BAD = ["scumword", "vilething", "awfulness"]


def labelled(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(max(1, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_misspelt(spark):
    rows, labels = labelled(600, 4)
    extra = [(10_000, "mild words all along here " * 6 + "scumwrd vilethinng scumwordy", "s"), (10_001, "mild words all along here " * 6, "s"), (10_002, None, "s"), (10_003, "", "s"), (None, "scumword", "s")]
    got = {r.doc_id: r for r in toxicity.toxicity_digest(frame(spark, rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    truth = {d: t for d, _, t in labels}
    held = [r for d, r in got.items() if d in truth and r.held_out]
    assert len(held) > 60 and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items() if d is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert got[10_000].score > got[10_001].score and got[10_000].predicted == 1
    assert got[10_002].score == got[10_003].score and all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False


def test_toxicity_scores_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    model = toxicity.SubwordModel(rng.normal(size=toxicity.BUCKETS), -0.3)
    texts = ["Plain WORDS here", None, "", " \t ", "ÀÉ ß\u3000日本語 a", "x", "\u00a0edge\u2028case ", "İstanbul Σίσυφος", "word " * 300, "y" * 500]
    want = [brute_score(model.weights, model.bias, t) for t in texts]
    assert model.scores(texts) == pytest.approx(want)
    monkeypatch.setattr(toxicity, "PIECE", 20)
    assert model.scores(texts) == pytest.approx(want)
    at, share = toxicity.bag(texts[8])
    assert 1 / (1 + np.exp(-(model.bias + share @ model.weights[at]))) == pytest.approx(want[8])


def test_training_rows_are_bounded(spark):
    docs = frame(spark, [(i % 40, f"text {i}", "s") for i in range(400)])
    known = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, known, {0: 7, 1: 200}).collect()
    assert sum(r.toxic == 0 for r in got) == 7 and sum(r.toxic == 1 for r in got) == 200


def test_toxicity_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity_digest(docs, empty).collect()} == {0}
    assert toxicity.toxicity_digest(docs.limit(0), empty).count() == 0
