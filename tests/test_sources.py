import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import batchio
from loomgraph.sources import files
from loomgraph.sources.stores import Store, checked_vectors
from loomgraph.streaming import incremental


def test_store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/kv", ["k"])
    assert s.read() is None
    s.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    s.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"))
    assert {r.k: r.v for r in s.read().collect()} == {"a": 1, "b": 3, "c": 4}
    keys = spark.createDataFrame([("a",), ("z",)], "k string")
    assert [r.k for r in s.missing(keys).collect()] == ["z"] and s.get(keys, ["v"]).count() == 1
    s.drop()
    assert s.read() is None


def test_vectors_must_be_complete(spark):
    v = spark.createDataFrame([("a", [1.0])], "id string, vec array<double>")
    assert checked_vectors(v, v.select("id"), "id").count() == 1
    with pytest.raises(ValueError, match="without a vector"):
        checked_vectors(v, spark.createDataFrame([("b",)], "id string"), "id")


def test_batches(spark, tmp_path):
    good = {"custom_id": "x", "response": {"status_code": 200, "body": {"id": "1", "choices": [{"finish_reason": "length", "message": {"content": "hi"}}], "usage": {"input_tokens": 3, "output_tokens": 4}}}, "error": None}
    bad = {"custom_id": "y", "response": {"status_code": 429}, "error": None}
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(bad) + "\n{broken\n")
    p = {r.custom_id: r for r in batchio.response_text(files.read_responses(spark, f"{tmp_path}/r.jsonl")).filter("custom_id IS NOT NULL").collect()}
    assert p["x"].text == "hi" and p["x"].retryable and p["x"].prompt_tokens == 3 and not p["y"].ok and p["y"].retryable
    req = spark.createDataFrame([("x", "POST", "/v1", '{"max_tokens": 2048}'), ("z", "POST", "/v1", "{}")], batchio.REQUEST)
    again = batchio.retries(req, batchio.response_text(files.read_responses(spark, f"{tmp_path}/r.jsonl")), 1024, 8192).collect()
    assert [(r.custom_id, r.max_completion_tokens) for r in again] == [("x", 4096)]
    assert batchio.validate(req)["rows"] == 2
    with pytest.raises(ValueError, match="more than one url"):
        batchio.validate(req.withColumn("url", F.col("custom_id")))


def test_cached_calls(spark):
    r = spark.createDataFrame([(1, "m", "a"), (2, "m", "a"), (3, "m", "b")], "request_id int, model string, messages string")
    cache = r.filter("request_id = 3").select(batchio.cache_key(F.col("model"), F.col("messages")).alias("args_hash"), F.lit("kept").alias("ret"), "model")
    out, new = batchio.cached_calls(r, cache, lambda ms: [m.upper() for m in ms])
    assert {x.request_id: (x.ret, x.cache_hit) for x in out.collect()} == {1: ("A", False), 2: ("A", False), 3: ("kept", True)}
    assert new.count() == 1


def test_graphml_round_trip(spark, tmp_path):
    n = spark.createDataFrame([('"A & B"', "x", "d<1>"), ("C", "y", None)], "entity_name string, entity_type string, description string")
    e = spark.createDataFrame([('"A & B"', "C", 2.5, "r")], "src string, tgt string, weight double, description string")
    lines = [r.xml for r in files.write_graphml_lines(n, e).orderBy("part").collect()]
    (tmp_path / "g.graphml").write_text("\n".join([files.GRAPHML_HEAD, *lines, files.GRAPHML_TAIL]))
    nodes, edges = files.read_graphml(spark, f"{tmp_path}/g.graphml")
    got = {r.id: r.attributes for r in nodes.collect()}
    assert got['"A & B"']["description"] == "d<1>" and got["C"]["entity_type"] == "y"
    assert edges.first().attributes["weight"] == "2.5"


def test_contexts_and_queries(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(["one", {"text": "two"}, {"context": " "}]))
    (tmp_path / "b.txt").write_text("three\nlines")
    assert sorted(r.content for r in files.read_contexts(spark, f"{tmp_path}/*").collect()) == ["one", "three\nlines", "two"]
    (tmp_path / "q").mkdir()
    (tmp_path / "q/q.jsonl").write_text('{"input": "x"}\n\n{"query": "y", "query_id": 7}\n')
    assert {r.query: r.query_id for r in files.read_queries(spark, f"{tmp_path}/q").collect()} == {"x": 0, "y": 7}


def test_incremental_inserts(spark, tmp_path):
    docs, chunks = Store(spark, f"{tmp_path}/d", ["doc_key"]), Store(spark, f"{tmp_path}/c", ["chunk_id"])
    df = spark.createDataFrame([(1, "alpha beta"), (2, " alpha beta "), (3, "gamma"), (4, None)], "doc_id bigint, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = incremental.stream_documents(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), docs, chunks, f"{tmp_path}/cp")
        q.awaitTermination(120)
        incremental.insert_documents(df, docs, chunks)
    assert docs.read().count() == 2 and chunks.read().count() == 2
