import random

import numpy as np
from helpers import brute_components, brute_lines, brute_simhash, brute_substring, brute_suffix, frame, near_brute, rows_of

from loam.llm import line_dedup, near_duplicates, repeats, simhash, substring_dedup, suffix_dedup
from loam.llm.spans import SpanHasher, keep_mask, ranges, sliding_min
from loam.llm.suffix_dedup import repeated_strings

EDGE = [(1, None, "a"), (2, "", None), (3, "x", "a"), (3, "x", "a"), (4, " \t\n", "a")]


def corpus(seed, n, unit):
    """Texts that share passages, with repeats inside, copies, and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(unit + rng.randint(-5, 30))) for _ in range(4)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))))
        out.append((i, "\n".join(parts)))
    out.append((n, "ab " * 700))
    out.append((n + 1, out[0][1]))
    out.append((n + 1, out[1][1]))
    out.append((0, "ab " * 90 + "end"))
    return out


def test_span_hashes():
    h = SpanHasher(1)
    data = np.frombuffer(b"abcabcabc" * 50, np.uint8)
    p = h.prefix_bytes(data)
    assert len(set(h.spans(p, np.array([0, 3, 6, 300]), np.array([5, 8, 11, 305])).tolist())) == 1
    assert len(set(h.grams(p, 4).tolist())) == 3
    assert sliding_min(np.array([5, 3, 4, 1, 9]), 3).tolist() == [3, 1, 1] and sliding_min(np.array([1]), 3).tolist() == []
    assert ranges(np.array([4, 9, 1]), np.array([2, 0, 3])).tolist() == [4, 5, 1, 2, 3]
    assert keep_mask(6, np.array([1, 2]), np.array([2, 2])).tolist() == [True, False, False, False, True, True]


def test_substring_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 40, 50)
        got = sorted(map(tuple, substring_dedup.substring_digest(frame(spark, [(d, t, "s") for d, t in rows]).repartition(5)).collect()))
        assert got == sorted(brute_substring(rows))
        assert any(r[2] for r in got)


def test_substring_edges(spark):
    got = substring_dedup.substring_digest(frame(spark, EDGE)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (4, 0, 0)]
    assert substring_dedup.substring_digest(frame(spark, [])).count() == 0
    long = " ".join(map(str, range(60)))
    got = substring_dedup.substring_digest(frame(spark, [(None, long, "a"), (5, long, "a"), (None, long, "a")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 60), (0, 60), (5, 0)]


def test_suffix_brute_force(spark):
    for seed in (3, 4):
        rows = corpus(seed, 40, 40)
        got = sorted(map(tuple, suffix_dedup.suffix_digest(frame(spark, [(d, t, "s") for d, t in rows]).repartition(5)).collect()))
        assert got == sorted(brute_suffix(rows))
        assert any(r[2] for r in got)


def test_suffix_hot_buckets(spark, monkeypatch):
    """The way for buckets too large for a task gives the same rows."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_CLASSES", 1)
    rows = corpus(5, 40, 40)
    got = sorted(map(tuple, suffix_dedup.suffix_digest(frame(spark, [(d, t, "s") for d, t in rows])).collect()))
    assert got == sorted(brute_suffix(rows))


def test_suffix_edges(spark):
    got = suffix_dedup.suffix_digest(frame(spark, EDGE)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0), (3, 1, 0, 0), (4, 3, 0, 0)]
    assert suffix_dedup.suffix_digest(frame(spark, [])).count() == 0
    one = suffix_dedup.suffix_digest(frame(spark, [(1, "z" * 500, "a"), (2, "q" * 200, "a"), (2, "q" * 200, "a")])).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in one) == [(1, 500, 1), (2, 200, 1), (2, 200, 1)]


def test_transform_merge():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab\0 ") for _ in range(900))
    for trial in range(30):
        strings = []
        for _ in range(rng.randint(1, 9)):
            a = rng.randint(0, 600)
            s = bytearray(base[a : a + rng.randint(150, 420)])
            s[rng.randrange(len(s))] = rng.choice(b"xyz")
            strings.append(bytes(s))
        strings += [b"a" * 300, b"\0" * 250] if trial % 5 == 0 else []
        weight = [rng.choice([1, 1, 2]) for _ in strings]
        seen = {}
        for s, w in zip(strings, weight):
            for i in range(len(s) - 199):
                seen[s[i : i + 200]] = seen.get(s[i : i + 200], 0) + w
        for s, flags in zip(strings, repeated_strings(strings, weight)):
            assert list(flags) == [seen[s[i : i + 200]] > 1 for i in range(len(s) - 199)]


def test_simhash_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "B", "cc", "Ää", "d"]) for _ in range(rng.randint(0, 5)))) for i in range(150)] + [(7, None), (200, "A b"), (201, "a B")]
    got = sorted(tuple(r) for r in simhash.simhash_digest(frame(spark, [(d, t, "s") for d, t in rows])).collect())
    fps = brute_simhash(rows)
    comp = brute_components(fps)
    assert got == sorted((d, f"{f:016x}", comp[i]) for i, (d, f) in enumerate(fps))
    assert simhash.simhash_digest(frame(spark, [])).count() == 0


def test_links_of_all_radii_and_hot_buckets(spark, monkeypatch):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = set(seeds)
    for s in seeds:
        for _ in range(8):
            values.add(s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = [(i, v) for i, v in enumerate(sorted(values))]
    want = brute_components(fps)
    signed = [(v - (1 << 64) if v >> 63 else v,) for _, v in fps]
    for nodes in (2000, 3):
        monkeypatch.setattr(simhash, "TREE_NODES", nodes)
        links = simhash.bucket_links(spark.createDataFrame(signed, "fp long"))
        root = {r.node & (2**64 - 1): r.root for r in simhash.components(links).collect()}
        ours = {}
        for i, v in fps:
            ours.setdefault(root.get(v, ("own", v)), set()).add(i)
        theirs = {}
        for i, r in want.items():
            theirs.setdefault(r, set()).add(i)
        assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(80, 300))] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    planted = []
    for k in range(40):
        t = list(texts[k])
        for _ in range(max(1, len(t) // 90)):
            t[rng.randrange(len(t))] = "edited"
        planted.append((1000 + k, " ".join(t)))
    half = [(2000 + k, " ".join(texts[k][: len(texts[k]) // 2] + ["z"] * 3 + texts[k + 1][: len(texts[k + 1]) // 2])) for k in range(20)]
    rows += planted + half + [(3000, rows[50][1]), (3000, rows[50][1]), (3001, None), (3002, "")]

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows))})
    docs = spark.createDataFrame([(d, t, "l", "s", 1, 2, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int, n int, h string")
    kept = near_duplicates.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert near_duplicates.keep_one_of_each(docs.limit(0)).count() == 0


def near_groups(spark, rows):
    found = {}
    for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.root, []).append(r.d)
    return sorted(map(sorted, found.values()))


def templated(seed):
    """Edited copies of four texts, many pairs just below the threshold and some above it."""
    rng = random.Random(seed)
    rows = []
    for g in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for k in range(60):
            t = list(base)
            for at in rng.sample(range(0, 200, 8), rng.choice([3, 3, 4])):
                t[at] = f"x{k}" if rng.random() < 0.7 else "shared"
            rows.append((1000 * g + k, " ".join(t)))
    return rows


def test_near_duplicates_in_templated_groups(spark):
    """False candidates just below the threshold do not stand in the way of pairs above it."""
    rows = templated(21)
    want = near_brute(rows)
    assert len(want) == 64
    assert near_groups(spark, rows) == want


def test_near_duplicates_at_the_threshold(spark):
    """Pairs at 0.80 and little above, and a passage repeated in one text of a pair, are found as by brute force."""
    rng = random.Random(14)
    rows = [(d + 10_000 * k, text) for k, seed in enumerate((12, 13, 15)) for d, text in templated(seed)]
    for k in range(20):
        body, passage = ([f"v{rng.randrange(5000)}" for _ in range(n)] for n in (300, 100))
        rows += [(90_000 + 2 * k, " ".join(body + passage)), (90_001 + 2 * k, " ".join(body + 20 * passage))]
    assert near_groups(spark, rows) == near_brute(rows)


def test_lines(spark):
    rows = [(i, f"Copyright {i} by Some Great Company of 19{i:02d}\nown line number {'abcdefghij'[i]} alone {'klmnopqrst'[i]}\n\nshared line here") for i in range(5)] + [(10, None), (11, ""), (12, "shared line here"), (12, "shared line here")]
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring_lines(frame(spark, [(d, t, "s") for d, t in rows])).collect()}
    for i in range(5):
        assert got[(i, f"own line number {'abcdefghij'[i]} alone {'klmnopqrst'[i]}\n")] == (4, 2)
    assert got[(10, None)] == (0, 0) and got[(11, "")] == (1, 0) and got[(12, "")] == (1, 1)
    assert line_dedup.line_digest(frame(spark, [])).count() == 0


def test_repeated_rows_stay_linear(spark):
    """Spans of rows that repeat doc_id and text, or lack a doc_id, are listed once, whatever their number."""
    text = " ".join(f"w{i % 97}x{i}" for i in range(120))
    rows = [(1, text, "s")] + [(7, text, "s")] * 400 + [(None, text, "s")] * 400 + [(2**63 - 1, text, "s")]
    docs = frame(spark, rows).repartition(6)
    for spans in (substring_dedup.repeated_spans(docs), suffix_dedup.repeated_byte_spans(docs)):
        listed = [len(r.spans) for r in spans.collect()]
        assert 2 <= len(listed) <= 3 and max(listed) == 1
    got = substring_dedup.substring_digest(docs).collect()
    assert sorted((r.n_removed, r.doc_id is None) for r in got if r.doc_id != 1) == [(120, False)] * 401 + [(120, True)] * 400
    assert [r.n_removed for r in got if r.doc_id == 1] == [0] and sum(r.doc_id == 2**63 - 1 for r in got) == 1


def test_very_long_text_and_clashing_columns(spark):
    """A text of 1.5 MB beside its own tail; columns named like helpers are ignored."""
    rng = random.Random(31)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(250_000))
    rows = [(1, long), (2, long[-90_000:]), (3, "short"), (4, None)]
    docs = spark.createDataFrame([(d, t, 1, 2, "x", 3, "y", 0) for d, t in rows], "doc_id long, text string, d int, th int, spans string, anchor int, line string, fp int")
    got = {r.doc_id: r for r in substring_dedup.substring_digest(docs).collect()}
    assert [tuple(got[d])[1:] for d in (1, 2, 3, 4)] == [x[1:] for x in brute_substring(rows)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_digest(docs).collect()}
    assert [(got[d].n_bytes, got[d].n_removed, got[d].n_spans) for d in (1, 2, 3, 4)] == [(len(long), 90_000, 1), (90_000, 90_000, 1), (5, 0, 0), (0, 0, 0)]
    assert line_dedup.line_digest(docs).count() == 4
    assert {r.doc_id: r.component_id for r in simhash.simhash_digest(docs).collect()}.keys() == {1, 2, 3, 4}


def test_near_duplicates_in_cut_buckets(spark, monkeypatch):
    """Buckets cut by further orders lose no pair, and a large group of similar texts is one group."""
    monkeypatch.setattr(near_duplicates, "TREE_NODES", 5)
    rng = random.Random(41)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = templated(33)
    for k in range(150):
        t = list(base)
        t[rng.randrange(150)] = f"y{k}"
        rows.append((50_000 + k, " ".join(t)))
    assert near_groups(spark, rows) == near_brute(rows)


def test_exact_links_join_what_brute_force_joins():
    rng = random.Random(5)
    signer = near_duplicates.Signer()
    for trial in range(20):
        base = np.array(rng.sample(range(10**6), 60), np.uint64)
        sets = []
        for k in range(40):
            s = base.copy()
            s[rng.sample(range(60), rng.choice([3, 5, 6, 7, 8]))] = np.array([10**7 + 100 * k + x for x in range(rng.choice([3, 5, 6, 7, 8]))][:1], np.uint64)
            sets.append(np.unique(s))
        sig = np.frombuffer(b"".join(signer.sign(near_duplicates.mix(s.copy()))[1] for s in sets), np.uint8).reshape(-1, 128)
        links = near_duplicates.exact_links(sets, sig, 0.8)
        assert len(links) < len(sets)
        group, want = list(range(40)), list(range(40))
        for i, j in links:
            group = [group[j] if g == group[i] else g for g in group]
        for i in range(40):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                    want = [want[j] if g == want[i] else g for g in want]
        assert [group.index(g) for g in group] == [want.index(g) for g in want]


def test_lines_brute_force(spark):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "x1", "22", "delta"]
    rows = []
    for d in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 6]))) for _ in range(rng.randint(0, 4))]
        lines += [f"Order {rng.randrange(99)} of the shop was sent to {rng.choice(['Ann', 'Bob', 'Cy', 'Di', 'Ed'])} today"] * rng.randint(0, 2)
        rows.append((d if rng.random() < 0.9 else None, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\t\n \x0b"), (5, rows[5][1]), (103, "long " * 20000 + "\nOrder 7 of the shop was sent to Zoe today")]
    got = sorted(map(tuple, line_dedup.line_digest(frame(spark, [(d, t, "s") for d, t in rows]).repartition(4)).collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str) and any(r[2] for r in got)
    clash = spark.createDataFrame([(1, "a", 7, "b", 9)], "doc_id long, text string, line int, template string, leaf int")
    assert rows_of(line_dedup.drop_recurring_lines(clash)) == [{"doc_id": 1, "line": 7, "template": "b", "leaf": 9, "text": "a", "n_lines": 1, "n_dropped": 0}]


def test_near_duplicate_buckets_grow_with_the_texts(spark, monkeypatch):
    """A text has at most 24 buckets however many are similar to it, and twice the similar texts give twice the rows."""
    monkeypatch.setattr(near_duplicates, "TREE_NODES", 5)
    rng = random.Random(43)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(160):
        t = list(base)
        t[rng.randrange(150)] = f"y{k}"
        rows.append((k, " ".join(t)))
    made = []
    for n in (80, 160):
        texts = near_duplicates.signatures(spark.createDataFrame(rows[:n], "doc_id long, text string"), 5).select("h", "fp", "keys", "sig")
        made.append(near_duplicates.bucket_members(texts).count())
    assert made[0] <= 24 * 80 and made[1] <= 24 * 160 and made[1] <= 2.1 * made[0]


def test_substring_lists_only_windows_that_start_earlier(spark, monkeypatch):
    """Passages too short for a window share anchors but list no window; nor do windows of a document's own class."""
    rng = random.Random(51)
    new = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    phrase, passage = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(70))
    rows = [(i, f"{new(60)} {phrase} {new(60)}") for i in range(12)] + [(100, f"{new(60)} {passage} {new(60)}"), (101, f"{new(60)} {passage} {new(60)}")]
    listed = []

    def written(df, name):
        out = substring_dedup.store_written(df, name)
        if name == "substring-extended":
            listed.extend(len(r[-1] or []) for r in out.collect())
        return out

    monkeypatch.setattr(substring_dedup, "store_written", substring_dedup.written, raising=False)
    monkeypatch.setattr(substring_dedup, "written", written)
    got = sorted(map(tuple, substring_dedup.substring_digest(frame(spark, [(d, t, "s") for d, t in rows])).collect()))
    assert got == sorted(brute_substring(rows)) and [r[2] for r in got[-2:]] == [0, 70]
    # 21 windows of the passage start in 100 already; those inside one run of equal classes need no list.
    assert listed and sum(listed) <= 21


def test_texts_without_spans_need_no_exchange(spark, monkeypatch):
    """The rows are those of the plain join, also where many share a bit."""
    rows = corpus(9, 40, 50) + [(None, None), (None, "x"), (7, "")]
    docs = frame(spark, [(d, t, "s") for d, t in rows])
    spans = substring_dedup.repeated_spans(docs)
    want = sorted(repeats.with_spans(docs, spans).collect(), key=str)
    assert any(r.spans for r in want) and not all(r.spans for r in want)
    for places in (64, 128, 1 << 24):
        monkeypatch.setattr(repeats, "PLACES", places)
        assert sorted(repeats.with_few_spans(docs, spans).collect(), key=str) == want
    few = repeats.with_few_spans(docs, spans.limit(0))
    assert few.count() == len(rows) and few.where("spans is not null").count() == 0


def exchanged_rows(plan):
    """Rows that the exchanges of an executed plan wrote."""
    here = plan.metrics().apply("shuffleRecordsWritten").value() if plan.metrics().contains("shuffleRecordsWritten") else 0
    return here + sum(exchanged_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_substring_exchanges_few_texts_at_last(spark):
    """The query's last step moves the texts that lose words, and hardly any other."""
    rng = random.Random(52)
    new = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = new(70)
    rows = [(i, new(80), "s") for i in range(200)] + [(300, f"{new(9)} {passage}", "s"), (301, f"{passage} {new(9)}", "s")]
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        df = substring_dedup.substring_digest(frame(spark, rows))
        got = {r.doc_id: r.n_removed for r in df.collect()}
        moved = exchanged_rows(df._jdf.queryExecution().executedPlan())
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert len(got) == 202 and {d for d, n in got.items() if n} == {301}
    assert 1 <= moved <= 20
