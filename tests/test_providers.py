import json

import pytest
from pyspark.sql import functions as F

from loam.providers import http, local
from loam.sources import readers, writers
from loam.streaming import documents as streaming


def test_urls():
    ok = lambda host: ["93.184.216.34"]
    assert http.check_public_url("https://api.example.com/v1", ok)
    for url, found in (("ftp://x", ok), ("http://x", lambda h: ["10.0.0.1"]), ("http://x", lambda h: ["127.0.0.1"]), ("http://x", lambda h: ["::1"]), ("http://x", lambda h: ["169.254.1.1"])):
        with pytest.raises(ValueError):
            http.check_public_url(url, found)


def test_clients():
    calls = []

    def transport(url, headers, body):
        calls.append((url, headers, body))
        if url.endswith("/token"):
            return {"access_token": f"t{len(calls)}", "expires_in": 100}
        if "rerank" in url:
            return {"results": [{"index": 1, "relevance_score": 0.9}], "rankings": [{"index": 0, "logit": 0.0}], "result": {"response": [{"id": 0, "score": 0.2}]}}
        if url.endswith("/chat/completions"):
            return {"choices": [{"message": {"content": '{"a": 1}'}}]}
        return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], "embeddings": [[1.0], [2.0]], "result": {"data": [[1.0], [2.0]]}}

    assert http.OpenAIEmbeddings("k", transport=transport)(["a", "b"]) == [[1.0], [2.0]]
    assert http.OllamaEmbeddings(transport=transport)(["a", "b"]) == http.CloudflareEmbeddings("t", "acc", transport=transport)(["a", "b"])
    now = [0.0]
    cred = http.ClientCredentials("http://x/token", "i", "s", transport, clock=lambda: now[0])
    first = cred.token()
    assert cred.token() == first
    now[0] = 50.0
    assert cred.token() != first
    assert http.ScoreReranker("cohere", "http://x/rerank", "m", transport=transport)("q", ["a", "b"]) == [0.5, 0.9]
    assert http.ScoreReranker("nvidia", "http://x/rerank", "m", cred, transport)("q", ["a"]) == [0.5]
    assert http.ScoreReranker("cloudflare", "http://x/rerank", "m", transport=transport)("q", ["a"]) == [0.2]
    assert json.loads(http.Completion("k", "m", transport=transport)("s", "u", {})) == {"a": 1}
    assert http.reranker("onnx:/Models/X") == ("onnx", "/Models/X") and http.reranker("Cohere") == ("cohere", None)


def test_columns(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i int, text string")
    lengths = df.select(http.embed_column(F.col("text"), lambda: lambda texts: [[float(len(t))] for t in texts]).alias("v")).collect()
    assert [r.v for r in lengths] == [[2.0], [0.0]]
    scored = http.rerank_pairs(df.withColumn("b", F.lit("x")), lambda: lambda q, ts: [0.25], "text", "b")
    assert {r.score for r in scored.collect()} == {0.25}

    def client():
        def answer(system, user, schema):
            if "bad" in user:
                raise ValueError
            return '{"a": 5}'

        return answer

    texts = spark.createDataFrame([("a long enough text for it",), ("bad but long enough text",), ("short",)], "t string")
    assert [r.x and r.x.a for r in texts.select(http.complete_column(F.col("t"), "s", {}, "a int", client).alias("x")).collect()] == [5, None, None]


def test_rerank_failures_and_requests(spark):
    def client():
        def rank(query, texts):
            if query == "bad":
                raise OSError("down")
            return [len(t) / 10 for t in texts]

        return rank

    pairs = spark.createDataFrame([("a", "xx"), ("a", "xxxx"), ("bad", "x"), ("b", "x")], "l string, r string").coalesce(1)
    assert [r.score for r in http.rerank_pairs(pairs, client, "l", "r").collect()] == [0.2, 0.4, None, 0.1]


def test_onnx_reranker(monkeypatch, tmp_path):
    class Coded:
        def __init__(self, pair):
            self.ids, self.attention_mask, self.type_ids = [len(pair[0]), len(pair[1])], [1, 1], [0, 1]

    class Session:
        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, feed):
            assert set(feed) == {"input_ids", "attention_mask"}
            return [(feed["input_ids"][:, 1] - feed["input_ids"][:, 0]).astype("float32")[:, None]]

    tokenizer = type("T", (), {"encode_batch": staticmethod(lambda pairs: [Coded(p) for p in pairs])})
    client = http.make_reranker(f"onnx:{tmp_path}/Model")
    assert client.folder == f"{tmp_path}/Model"
    with pytest.raises(FileNotFoundError):
        client("a", ["b"])
    client._loaded = (tokenizer, Session())
    assert client("ab", ["ab", "abcd"]) == pytest.approx([0.5, 0.8807970779778823])
    assert len(client.pairs([("a", "b")] * 150)) == 150
    with pytest.raises(ValueError):
        http.make_reranker("oauth")
    assert http.make_reranker("cohere", "key").kind == "cohere"


def test_settings_and_token_check(tmp_path):
    (tmp_path / ".env").write_text("# keys\nexport A_KEY='from file'\nB=2\n")
    file = str(tmp_path / ".env")
    assert http.setting("A_KEY", "given", {"A_KEY": "env"}, file) == "given" and http.setting("A_KEY", None, {"A_KEY": "env"}, file) == "env"
    assert http.setting("A_KEY", None, {}, file) == "from file" and http.setting("C", None, {}, file) is None
    good = http.CloudflareEmbeddings("t", "a", ask=lambda url, head: {"success": True, "result": {"status": "active"}})
    good.verify()
    with pytest.raises(ValueError):
        http.CloudflareEmbeddings("t", "a", ask=lambda url, head: {"success": False}).verify()


def test_hash_embedding(spark):
    df = spark.createDataFrame([("a a b",), ("",)], "t string")
    a, b = [r.v for r in df.select(local.hash_embedding(F.col("t")).alias("v")).collect()]
    assert sorted(x for x in a if x) == [1.0, 2.0] and len(a) == 64 and sum(b) == 0
    assert local.vector_problems(spark.createDataFrame([([1.0],), (None,)], "embedding array<double>"), 2).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff end")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    docs, large = readers.read_text_files(spark, str(tmp_path), max_bytes=50)
    assert [r.text for r in docs.collect()] == ["café � end"] and large.count() == 1
    chunks = spark.createDataFrame([(1, 0, "a", 0, 1), (1, 1, "b", 1, 1)], "doc_id long, idx int, text string, offset int, length int")
    assert json.loads(writers.json_arrays(chunks).first().value)["count"] == 2
    writers.write_plain(chunks, str(tmp_path / "plain"))
    writers.write_jsonl(chunks, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "plain")).collect()) == ["a", "b"]
    assert readers.read_json(spark, str(tmp_path / "lines"), chunks.select("doc_id", "text").schema).count() == 2
    lines = writers.curve_lines(spark.createDataFrame([(1, [0.5], [0.25])], "doc_id long, curve array<double>, smoothed array<double>"))
    assert lines.first().line == "0\t0.500000\t0.250000"


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b. c d. e"), (2, "x")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_documents(spark, str(tmp_path / "in"), docs.schema)
    q = streaming.each_batch(stream, lambda b: b.select("doc_id"), str(tmp_path / "out"), str(tmp_path / "log"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_rolling_dictionary(spark, tmp_path):
    keys = spark.createDataFrame([("k", 1, 0), ("k", 2, 3), ("z", 1, 1)], "semantic_key string, doc_id long, idx int")
    keys.write.parquet(str(tmp_path / "in"))
    stream = streaming.key_dictionary(spark.readStream.schema(keys.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("update").format("memory").queryName("rolling").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {r.semantic_key: (sorted(r.places), r.n) for r in spark.table("rolling").collect()}
    assert got == {"k": (["1:0", "2:3"], 2), "z": (["1:1"], 1)}


def test_model_operators(spark):
    from loam.operators import topology
    from loam.providers import model

    def client():
        def answer(system, user, schema):
            fields = schema["properties"]
            if "relations" in fields:
                return '{"relations": [{"subject": "a", "predicate": "is", "object": "b"}]}'
            if "intents" in fields:
                return '{"intents": [{"query": "what is it", "intent_type": "factual"}]}'
            if "sections" in fields:
                return '{"sections": [{"section_id": 1, "classification": "splittable"}, {"section_id": 0, "classification": "odd"}]}'
            if "chunks" in fields:
                return '{"chunks": [{"section_ids": [1], "block_range": [0, 2]}]}'
            if "title" in fields:
                return json.dumps({"title": user, "semantic_keys": [f"K{len(system)}"], "keywords": ["w"]})
            return '{"synopsis": "short"}'

        return answer

    docs = spark.createDataFrame([(1, "a text that is long enough"), (2, "short")], "doc_id long, text string")
    got = docs.select("doc_id", model.relations(F.col("text"), client).alias("r"), model.synopsis(F.col("text"), client).alias("s")).orderBy("doc_id").collect()
    assert got[0].r[0].confidence == 1.0 and got[0].s == "short" and got[1].r == [] and got[1].s is None
    asked = model.intents(docs, client, local.hash_embedding).collect()
    assert [(r.doc_id, r.query) for r in asked] == [(1, "what is it")]
    blocks = spark.createDataFrame([(1, 0, "# Heading here", "Heading"), (1, 1, "Body text.", "Sentence")], "doc_id long, block_idx int, text string, kind string")
    tree = topology.section_tree(blocks)
    assert {r.node_id: r["class"] for r in model.inspect_sections(tree, client).collect()} == {0: "atomic", 1: "splittable", 2: "atomic"}
    assert [(r.start, r.end) for r in model.refine_partition(tree, client).collect()] == [(0, 2)]
    chunks = spark.createDataFrame([(1, 1, "second"), (1, 0, "first"), (2, 0, "other")], "doc_id long, idx int, text string")
    rows = {(r.doc_id, r.idx): r for r in model.rolling_metadata(chunks, client).collect()}
    assert rows[1, 0].title == "first" and rows[1, 0].semantic_keys != rows[1, 1].semantic_keys and rows[2, 0].keywords == ["w"]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, None, ["x"])], "doc_id long, a string, b array<string>")
    assert json.loads(writers.rows_as_json(df).first().value) == {"doc_id": 1, "b": ["x"]}
