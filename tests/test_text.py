import pytest
from pyspark.sql import functions as F

from loam.functions.lexicons import parse_language
from loam.operators import enrichment, segmentation
from loam.operators.segmentation import markdown_blocks

SAMPLE = """# Title

Intro here. More text.

## Part

| a | b |
|---|---|
| 1 | 2 |

- one
- two

  still two

> quoted
lazy

```py
x = 1

# no heading
```

<div>
html
</div>

***

Setext
======

    indented
    code

Last one. The end
"""


def test_markdown_blocks():
    got = [(k, SAMPLE[a:b]) for a, b, k in markdown_blocks(SAMPLE)]
    assert got == [
        ("Heading", "# Title"), ("Paragraph", "Intro here. More text."), ("Heading", "## Part"), ("Table", "| a | b |\n|---|---|\n| 1 | 2 |"),
        ("List", "- one\n- two\n\n  still two"), ("BlockQuote", "> quoted\nlazy"), ("CodeBlock", "```py\nx = 1\n\n# no heading\n```"),
        ("Heading", "Setext\n======"), ("CodeBlock", "indented\n    code"), ("Paragraph", "Last one. The end"),
    ]


def test_blocks_and_offsets(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "Plain é. Two!"), (3, ""), (4, None)], "doc_id long, text string")
    rows = segmentation.blocks(df).orderBy("doc_id", "block_idx").collect()
    raw = {1: SAMPLE.encode(), 2: "Plain é. Two!".encode()}
    for r in rows:
        assert raw[r.doc_id][r.offset_start : r.offset_end].decode() == r.text
    assert [(r.kind, r.text) for r in rows if r.doc_id == 2] == [("Sentence", "Plain é. "), ("Sentence", "Two!")]
    stats = {r.doc_id: r for r in segmentation.block_stats(segmentation.blocks(df)).collect()}
    assert stats[1].n_heading == 3 and stats[1].n_sentence == 4 and stats[1].n_blocks == 12
    assert segmentation.blocks(df, max_blocks=3, oversized="skip").select("doc_id").distinct().count() == 1
    assert segmentation.oversized_documents(df, max_blocks=3).first().n_blocks == 12
    with pytest.raises(Exception, match="document 1 has 12 blocks"):
        segmentation.blocks(df, max_blocks=3).collect()
    with pytest.raises(ValueError):
        segmentation.blocks(df, oversized="cut")


def test_lines_end_at_line_breaks_only(spark):
    text = "para one\x0c# not heading\u2028# nor this\x85x é\r# Real\r\n\nend\x0b here."
    got = [(k, text[a:b]) for a, b, k in markdown_blocks(text)]
    assert got == [("Paragraph", "para one\x0c# not heading\u2028# nor this\x85x é"), ("Heading", "# Real"), ("Paragraph", "end\x0b here.")]
    rows = segmentation.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert all(text.encode()[r.offset_start : r.offset_end].decode() == r.text for r in rows)


def test_sentences_against_icu(spark):
    """The JVM's ICU gives the same borders on the small documents table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ours = {r.doc_id: [s.text for s in r.s] for r in docs.select("doc_id", segmentation.sentence_spans(F.col("text")).alias("s")).collect()}
    icu = spark._jvm.com.ibm.icu
    it = icu.text.BreakIterator.getSentenceInstance(icu.util.ULocale.ROOT)
    for r in docs.limit(40).collect():
        it.setText(r.text)
        at, want = it.first(), []
        while (to := it.next()) != -1:
            want.append(r.text.encode("utf-16-le")[2 * at : 2 * to].decode("utf-16-le"))
            at = to
        assert ours[r.doc_id] == [x for x in want if any(c.isalnum() for c in x)]


def check(spark, expr, rows):
    df = spark.createDataFrame([(t, lang) for t, lang, _ in rows], "text string, lang string")
    assert [r.x for r in df.select(expr.alias("x")).collect()] == [w for *_, w in rows]


def test_starts(spark):
    text, lang = F.col("text"), F.col("lang")
    check(spark, enrichment.discourse_marker(text, lang), [("  However, x", "en", "Contrast"), ("Außerdem gilt", "de", "Continuation"), ("因此，x", "zh", "Causation"), ("However", "en", None), ("However, x", "auto", None), ("z.b. x", "de", "Exemplification"), ("zxb. x", "de", None)])
    check(spark, enrichment.starts_with_pronoun(text, lang), [("It is", "en", True), ("'They' go", "en", True), ("Item", "en", False), ("Они тут", "ru", True), ("", "en", False), ("x", "zh", False)])
    check(spark, enrichment.starts_with_demonstrative(text, lang), [("This one", "en", True), ("Thistle", "en", False), ("The same x", "en", True), ("dieser Tag", "de", True), ("", "en", False)])


def test_spans(spark):
    text, lang = F.col("text"), F.col("lang")
    check(spark, enrichment.capitalised_spans(text, lang), [("Paris is big. Rome too, but New York City wins", "en", ["New York City"]), ("we saw Paris", "en", ["Paris"]), ("The Big House", "en", ["Big House"]), ("John The Great came", "en", ["John The Great"]), ("", "en", []), ("A Bc", "en", ["Bc"])])
    check(spark, enrichment.noun_phrases(text, lang), [("Big - House is The New Car", "en", ["Big House", "New Car"]), ("Alone here", "en", [])])
    check(spark, enrichment.capitalised_spans(text, lang), [
        (None, "en", None), ("see ... Foo", "en", []), ("see .- Foo", "en", ["Foo"]), ("ran!\u3000Foo", "en", []), (".Foo x", "en", []), ("x .Foo", "en", ["Foo"]),
        ("in A. Rome Of X.Y", "en", ["Rome Of X.Y"]), ("da \u00c9", None, ["\u00c9"]), ("we Foo, bar (Qux)", "en", ["Foo", "Qux"]),
    ])
    check(spark, enrichment.noun_phrases(text, lang), [(None, "en", None), ("x Foo ... !? Bar - y Baz", "en", ["Foo Bar"]), ("Foo The Bar Baz", "en", ["Bar Baz"])])
    check(spark, enrichment.katakana_spans(text), [("これはコンピューター。", "ja", ["コンピュータ"]), ("ア", "ja", [])])
    check(spark, enrichment.latin_spans(text), [("使用Python3和SQL语言编写程序代码内容", "zh", ["Python3", "SQL"]), ("mostly latin 字", "zh", [])])


def test_long_runs_of_capitals(spark):
    n = 20_000
    df = spark.createDataFrame([("Foo ", "Foo - ", "en")], "a string, b string, lang string").select(F.repeat("a", F.lit(n)).alias("a"), F.repeat("b", F.lit(n)).alias("b"), "lang")
    got = df.select(enrichment.capitalised_spans(F.col("a"), F.col("lang")), enrichment.noun_phrases(F.col("b"), F.col("lang"))).first()
    assert [[len(x) for x in xs] for xs in got] == [[4 * n - 1], [4 * n - 1]]


def test_entities(spark):
    df = spark.createDataFrame([("This Engine works. It uses Big Data", ["engine"])], "text string, t array<string>")
    got = df.select(enrichment.entities(F.col("text"), F.lit("en"), F.col("t")).alias("e")).first().e
    assert [(e.normalized, e.type) for e in got] == [("this engine", "Named"), ("big data", "Named"), ("engine", "Named"), ("engine", "Demonstrative")]


def test_language(spark):
    check(spark, enrichment.detect_language(F.col("text")), [("the cat is on the mat", "", "en"), ("der Hund und die Katze", "", "de"), ("これは", "", "ja"), ("한국어", "", "ko"), ("中文", "", "zh"), ("", "", "en")])
    assert parse_language("German") == "de" and parse_language("auto") == "auto"
    with pytest.raises(ValueError):
        parse_language("klingon")


def test_heading_continuity(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a"]), (["a", "b"], ["a", "c"]), (["a"], []), (["a", "b"], ["a"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(enrichment.heading_continuity(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 1.0, 0.5, 0.0, 0.5]
