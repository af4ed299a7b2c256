import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import batchio, community, evaluate, graph, limits, paths, retrieval, scaffold, summaries, vectors
from loomgraph.operators.order import positions
from loomgraph.sources import files, stores
from loomgraph.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_positions(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "n int, t string")
    assert {r.n: r.pos for r in positions(df, [F.desc("n")], first=1).collect()} == {n: 101 - n for n in range(101)}
    assert positions(df.limit(0), [F.asc("n")]).count() == 0


def test_summaries_applied(spark):
    nodes = spark.createDataFrame([("A", "x", "first", "chunk-1")], "entity_name string, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([("A", "B", 2.0, "near", "chunk-1")], "src string, tgt string, weight double, description string, source_id string")
    ents = spark.createDataFrame([(1, "7", "S", "summary", "whole"), (1, "7", "A", "other", "second"), (1, "7", " ", "summary", "blank")], "level int, cluster string, entity_name string, entity_type string, description string")
    rels = spark.createDataFrame([(1, "7", "S", "A", "holds", 8.0), (2, "9", "B", "A", "near", 0.0), (2, "9", None, "A", "x", 1.0)], "level int, cluster string, src_id string, tgt_id string, description string, weight double")
    n, e, counts = summaries.apply_summaries(nodes, edges, ents, rels)
    assert rows(n) == [("A", "x", "first<SEP>second", "chunk-1<SEP>cluster-1-7"), ("B", "UNKNOWN", "", "cluster-2-9"), ("S", "summary", "whole", "cluster-1-7")]
    assert rows(e) == [("A", "B", 3.0, "near", "chunk-1<SEP>cluster-2-9"), ("A", "S", 8.0, "holds", "cluster-1-7")]
    assert tuple(counts.first()) == (2, 1)
    again = summaries.apply_summaries(n, e, ents, rels)
    assert tuple(again[2].first()) == (0, 0)
    assert tuple(summaries.apply_summaries(nodes, edges, ents.limit(0), rels.limit(0))[2].first()) == (0, 0)


def test_clusters(spark):
    n = spark.createDataFrame([("A", json.dumps([{"level": 0, "cluster": "1"}, {"level": 1, "cluster": "2"}])), ("B", "[broken"), ("C", None), ("D", '[{"level": 0, "cluster": "1"}]')], "entity_name string, clusters string")
    m = summaries.cluster_nodes(n)
    assert rows(m) == [(0, "1", "A"), (0, "1", "D"), (1, "2", "A")]
    e, r = summaries.summarize(m)
    assert rows(e.select("entity_name", "description")) == [("L0_C1_A_D", "Summary node for: A, D.")] and r.count() == 2
    big = spark.createDataFrame([(0, "1", f"n{i:03}", 10) for i in range(100)] + [(0, "2", "lone", 999)], "level int, cluster string, node string, tokens int")
    kept = summaries.within_tokens(big, 500)
    sizes = {x.cluster: x["count"] for x in kept.groupBy("cluster").count().collect()}
    assert sizes == {"1": 40, "2": 1}  # 100, 80, 64, 51, 40: the first of at most 500 tokens; one member always stays


def test_split_plan(spark):
    b = spark.createDataFrame([("c", 8, 0.5, True), ("d", 9, 0.5, False), ("e", 2, 0.9, True)], "community string, n_nodes int, entropy double, should_split boolean")
    m = spark.createDataFrame([("c", f"n{i}", "xy"[i % 2]) for i in range(8)], "community string, node string, kind string")
    v = spark.createDataFrame([(f"n{i}", [1.0, 0.01 * i, 0.0] if i < 4 else [0.0, 0.01 * i, 1.0]) for i in range(8)], "id string, vec array<double>")
    fit = lambda df, k, vec, most: df.select(k, (F.get(vec, F.lit(2)) > 0.5).cast("int").alias("cluster"), F.lit(1.0).alias("p"))
    assert [(r.community, r.label, r.size, r.entropy, r.named) for r in summaries.split_plan(b, m, v, fit=fit).orderBy("label").collect()] == [("c", 0, 4, 1.0, ["n0", "n1", "n2", "n3"]), ("c", 1, 4, 1.0, ["n4", "n5", "n6", "n7"])]
    assert summaries.split_plan(b.limit(0), m, v).count() == 0


def test_scaffold(spark):
    ent = spark.createDataFrame([(0, "Mill", "b", "grinds corn", ["c1"], 0, []), (1, "Pond", "w", "holds water", ["c2", "c1"], 0, []), (2, "Mill", "z", "later", ["c3", "c1"], 2, ["x"]), (3, "Oven", "o", "bakes bread", None, 0, None)], "pos int, entity_name string, entity_type string, description string, chunks array<string>, layer int, members array<string>")
    e = scaffold.upsert_entities(ent)
    assert {r.entity_name: (r.entity_type, r.description, r.chunks, r.layer, r.members) for r in e.collect()}["Mill"] == ("b", "grinds corn", ["c1", "c3"], 2, ["x"])
    rel = spark.createDataFrame([(0, "Pond", "Mill", "feeds", 2.0, ["c1"]), (1, "Mill", "Pond", "x", 1.0, ["c2"]), (2, "Mill", "Oven", "flour", 1.0, ["c9"]), (3, None, "Oven", "y", 1.0, None)], "pos int, src_id string, tgt_id string, description string, weight double, chunks array<string>")
    r = scaffold.upsert_relations(rel)
    assert rows(r) == [("Mill", "Oven", 1.0, "flour", ["c9"]), ("Mill", "Pond", 3.0, "feeds", ["c1", "c2"])]
    m = spark.createDataFrame([("one", "Pond"), ("one", "Oven"), ("two", "Nothing")], "community string, node string")
    ch = spark.createDataFrame([("c1",), ("c2",), ("c9",)], "chunk_id string")
    q = spark.createDataFrame([("q", "who bakes bread by the water"), ("z", "zzz")], "query_id string, query string")
    got = {}
    for x in scaffold.retrieve(e, r, m, ch, q, 2).orderBy("query_id", "section", "rank").collect():
        got.setdefault((x.query_id, x.section), []).append(x.item)
    assert set(got[("q", "entities")]) == {"Oven", "Pond"} and got[("q", "communities")] == ["one"]
    assert set(got[("q", "bridges")]) == {"Mill|Oven", "Mill|Pond"} and set(got[("q", "chunks")]) == {"c1", "c2", "c9"}
    assert got[("z", "entities")] == ["Mill", "Oven"]


def test_stores(spark, tmp_path):
    s = stores.Store(spark, f"{tmp_path}/kv", ["id"])
    k = spark.createDataFrame([(1,), (2,)], "id int")
    assert s.get(k).count() == 0 and s.missing(k).count() == 2
    s.upsert(spark.createDataFrame([(1, 9, "late"), (1, 5, "zearly"), (2, 1, "x")], "id int, at int, v string"), [F.col("at")])
    assert rows(s.read().select("id", "v")) == [(1, "late"), (2, "x")]
    s.upsert(spark.createDataFrame([(2, 7, "a"), (2, 7, "b"), (3, 0, None)], "id int, at int, v string"))
    assert rows(s.get(spark.createDataFrame([(2,), (3,), (9,)], "id int"), ["v"])) == [(2, "b"), (3, None)]
    v = stores.VectorStore(spark, f"{tmp_path}/vec")
    v.add(spark.createDataFrame([("a", "red apple"), ("b", "blue boat")], "id string, content string"))
    v.add(spark.createDataFrame([("b", "red apple pie"), ("c", "green grass")], "id string, content string"))
    q = vectors.embed(spark.createDataFrame([("q", "red apple")], "query_id string, t string"), "query_id", "t").withColumnRenamed("vec", "qvec")
    assert [r.id for r in v.query(q, 2).orderBy("dense_order").collect()] == ["a", "b"]
    v.drop()
    assert v.read() is None


def test_edge_requests_and_cache(spark):
    e = spark.createDataFrame([("A", "B", "r"), ("A", "C", None)], "src string, tgt string, description string")
    n = spark.createDataFrame([("A", "da"), ("B", "long " * 3000)], "entity_name string, description string")
    r = stores.edge_requests(e, n, "m").orderBy("tgt").collect()
    assert len({x.custom_id for x in r}) == 2 and r[0].text_hash != r[0].embedded_text_hash and len(r[0].input.split()) == 2048 and r[1].text_hash == r[1].embedded_text_hash
    req = stores.edge_requests(e, n, "m")
    out = spark.createDataFrame([(r[0].custom_id, [1.0], None), (r[1].custom_id, None, "status 500"), ("stray", [2.0], None)], "custom_id string, vec array<float>, error string")
    old = spark.createDataFrame([("A", "B", "old", "old", [9.0]), ("X", "Y", "h", "h", [3.0])], "src string, tgt string, text_hash string, embedded_text_hash string, vec array<float>")
    good, bad = stores.import_embeddings(out, req, old)
    assert {(x.src, x.tgt): x.vec for x in good.collect()} == {("A", "B"): [1.0], ("X", "Y"): [3.0]} and rows(bad) == rows(spark.createDataFrame([(r[1].custom_id, "status 500"), ("stray", "no metadata")], "a string, b string"))
    hit, miss = stores.edge_cache_misses(req, good)
    assert hit.count() == 1 and [x.tgt for x in miss.collect()] == ["C"]


def test_files(spark, tmp_path):
    with open(tmp_path / "q.jsonl", "w") as f:
        f.write("\n".join(['{"query": "a"}', "", '{"input": "b", "query_id": 7}', '{"question": " "}', '{"question": "c"}'] + [json.dumps({"query": f"x{i}"}) for i in range(3000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        q = {r.query: r.query_id for r in files.read_queries(spark, f"{tmp_path}/q.jsonl").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (q["a"], q["b"], q["c"], q["x0"], q["x2999"]) == (0, 7, 4, 5, 3004) and len(q) == 3003
    n = spark.createDataFrame([("A & B", "x<y", 'd"q'), ("C", None, None)], "entity_name string, entity_type string, description string")
    e = spark.createDataFrame([("A & B", "C", 2.5, "one"), ("A & B", "C", 1.0, "two")], "src string, tgt string, weight double, description string")
    files.write_graphml(n, e, f"{tmp_path}/g")
    whole = "\n".join(r.value for p in ("0-head", "1-nodes", "2-edges", "3-tail") for r in spark.read.text(f"{tmp_path}/g/{p}").collect())
    (tmp_path / "g.graphml").write_text(whole)
    rn, re_ = files.read_graphml(spark, f"{tmp_path}/g.graphml")
    assert {r.id: r.attributes["description"] for r in rn.collect()} == {"A & B": 'd"q', "C": None} or rn.count() == 2
    assert sorted(r.attributes["weight"] for r in re_.collect()) == ["1.0", "2.5"]
    assert {r.part: json.loads(r.json) for r in files.node_link(n.limit(1), e.limit(1)).collect()}["links"]["source"] == "A & B"
    files.write_rows(e, f"{tmp_path}/rows.csv", "csv")
    files.write_rows(e, f"{tmp_path}/rows.jsonl")
    assert spark.read.json(f"{tmp_path}/rows.jsonl").count() == spark.read.option("header", True).csv(f"{tmp_path}/rows.csv").count() == 2
    assert files.markdown_table(e.select("src", "weight").orderBy("weight")).splitlines()[2] == "| A & B | 1 |"
    with pytest.raises(ValueError):
        files.markdown_table(e, 1)
    pn, pe = files.property_graph(n, e, spark.createDataFrame([(0, "k", "C"), (0, "k", "gone")], "level int, community string, node string"), spark.createDataFrame([(0, "k", "l")], "level int, parent string, child string"))
    assert rows(evaluate.kind_counts(pn, pe)) == [("edge", "HAS_SUBCOMMUNITY", 1), ("edge", "IN_COMMUNITY", 1), ("edge", "RELATES_TO", 2), ("node", "Community", 1), ("node", "Entity", 2)]


def test_question_corpora(spark):
    p = spark.createDataFrame([("q", ["x", "y"], [("t1", "one", True), ("t2", "two", False)])], "question string, answers array<string>, paragraphs array<struct<title: string, paragraph_text: string, is_supporting: boolean>>")
    assert rows(files.qa_queries(p)) == [("q", "y", ["t1"])] and rows(files.qa_passages(p, "paragraphs")) == [("t1", "one"), ("t2", "two")]
    c = spark.createDataFrame([("q", "a", [("t", ["s1", "s2"]), ("u", None)], [("t", 0), ("t", 1)])], "question string, answer string, context array<struct<title: string, sentences: array<string>>>, supporting_facts array<struct<title: string, sentence: int>>")
    assert rows(files.qa_queries(c, "pairs")) == [("q", "a", ["t"])] and rows(files.qa_passages(c, "pairs")) == [("t", "s1 s2")]
    h = spark.createDataFrame([("q", [], [("t", "x")])], "question string, answers array<string>, ctxs array<struct<title: string, text: string>>")
    assert rows(files.qa_queries(h, "hits")) == [("q", None, [])] and rows(files.qa_passages(h, "hits")) == [("t", "x")]
    with pytest.raises(ValueError):
        files.qa_queries(h, "other")


def test_graph_tables(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, tgt string")
    turned = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "b")], "src string, tgt string")
    assert graph.identity(e).first() == graph.identity(turned).first() != graph.identity(e.limit(1)).first()
    m = spark.createDataFrame([(1, "N", "t1", "x", "s2"), (0, "N", "t2", "y", "s1"), (2, "N", "t1", "x", "s1"), (3, "M", "t", " ", None)], "pos int, entity_name string, entity_type string, description string, source_id string")
    assert rows(graph.merge_nodes_in_order(m)) == [("M", "t", None, None), ("N", "t1", "y<SEP>x", "s1<SEP>s2")]
    subs = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "c", "d")], "level int, parent string, child string")
    root = spark.createDataFrame([(0, "a")], "level int, community string")
    assert [r.community for r in graph.below(subs, root).orderBy("level").collect()] == ["a", "b", "c"]
    p = spark.createDataFrame([("q", ["a", "b", "c"])], "query_id string, path array<string>")
    c = spark.createDataFrame([("q", "a", "b", 0.5)], "query_id string, src string, tgt string, cost double")
    assert tuple(paths.path_edge_metrics(p, c).first()) == ("q", 2, 0.75, 1.0, 0.25)


def test_index_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Green Mill grinds Corn by Clay Pond."), (2, "Clay Pond feeds Green Mill.")], "doc_id bigint, text string")
    ix = retrieval.build_index(docs)
    n = {r.name: r.n for r in stores.materialize(ix, f"{tmp_path}/ix").collect()}
    again = stores.load_index(spark, f"{tmp_path}/ix")
    assert n["chunks"] == again.chunks.count() == 2 and again.edges.count() == n["edges"] > 0
    q = vectors.embed(spark.createDataFrame([("q", "mill by the pond")], "query_id string, query string"), "query_id", "query").withColumnRenamed("vec", "qvec")
    ctx = retrieval.retrieve(again, q, "naive", retrieval.QueryOptions(threshold=-1.0))
    text = retrieval.render(ctx, again.chunks.select(F.lit("chunks").alias("section"), F.col("chunk_id").alias("item"), F.col("content").alias("text"))).first().context
    assert text.startswith("-----Chunks-----\n0,") and "grinds Corn" in text


def test_batches(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "custom_id string, text string")
    m = spark.createDataFrame([("a", 3)], "custom_id string, n int")
    assert rows(batchio.with_metadata(p, m, {"n": 0})) == [("a", "x", 3, None), ("b", "y", 0, "no metadata")]
    r = spark.createDataFrame([(str(i), str(i)) for i in range(20)], "custom_id string, body string")
    out = {x.custom_id: (x.ok, x.text) for x in limits.run_requests(r, lambda b: str(10 // int(b)), 4).collect()}
    assert out["5"] == (True, "2") and out["0"][0] is False and "ZeroDivisionError" in out["0"][1] and len(out) == 20
    assert limits.variants(["baseline", "hi", "hi_mcts"]) == ["naive", "hi", "hi_mcts"] and len(limits.variants(["all"])) == 12
    with pytest.raises(ValueError):
        limits.variants(["nothing"])


def test_packed_descriptions(spark):
    m = spark.createDataFrame([(0, "c", f"n{i}") for i in range(6)] + [(0, "small", "x")], "level int, community string, node string")
    n = spark.createDataFrame([(f"n{i}", 10) for i in range(6)] + [("x", 3)], "entity_name string, tokens int")
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 10) for i in range(5)], "src string, tgt string, tokens int")
    plain = {r.community: r for r in community.packed_descriptions(m, n, e, 60).collect()}
    assert (plain["c"].n_nodes, plain["c"].n_edges, plain["c"].truncated) == (3, 3, True) and (plain["small"].n_nodes, plain["small"].truncated) == (1, False)
    r = spark.createDataFrame([(0, "c", "d", 20, 1.0), (0, "c", "e", 10, 0.5), (0, "c", "f", 90, 0.4), (0, "small", "g", 5, 1.0)], "level int, parent string, child string, tokens int, occurrence double")
    led = {x.community: x for x in community.packed_descriptions(m, n, e, 60, r).collect()}
    assert (led["c"].n_nodes, led["c"].n_edges, led["c"].used_tokens) == (1, 1, 50)  # two reports of 30 tokens, then 15 each for nodes and edges
    assert led["small"].used_tokens == plain["small"].used_tokens == 3


def test_command_line(capsys):
    from loomgraph.__main__ import main

    main(["list"])
    assert "mode_hi" in capsys.readouterr().out.split()
    main(["sizes", "/root/testdata/sf0.001"])
    assert "| region | 5 |" in capsys.readouterr().out
    main(["run", "edge_degree_rank", "/root/testdata/sf0.001", "--limit", "2"])
    assert len(capsys.readouterr().out.strip().splitlines()) == 4
    with pytest.raises(SystemExit):
        main(["run", "nothing", "x"])


def test_streams(spark, tmp_path):
    day = lambda h: dt.datetime(2026, 1, 1, h)
    df = spark.createDataFrame([("r", " A", day(1), "s", 1.0), ("r", "a", day(2), "s", 2.0), ("r", None, day(2), "t", 3.0), ("r", None, day(2), "t", 4.0)], "run_id string, custom_id string, at timestamp, stage string, v double")
    df.write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def run(x, name, mode="append"):
        q = x.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert run(incremental.stream_once(src(), "run_id", "custom_id", "at", "1 day"), "once").count() == 3
    assert rows(run(incremental.stream_telemetry(src(), "at", "stage", "v"), "tele", "complete").select("stage", "calls", "latency_sum")) == [("s", 1, 1.0), ("s", 1, 2.0), ("t", 2, 7.0)]


def test_packets(spark):
    a = spark.createDataFrame([(q, v, f"q{q}", f"{v}{q}") for q in range(6) for v in ("hi", "x", "y") if (q, v) != (5, "y")], "query_id int, variant string, query string, answer string")
    p, h = evaluate.annotation_packet(a, ["query_id"], "variant", [("hi", "x"), ("hi", "y")], 3)
    behind = {r.packet_id: (r.variant_a, r.variant_b) for r in h.collect()}
    assert p.count() == 11 and all(r.answer_a == behind[r.packet_id][0] + str(r.query_id) and r.answer_b == behind[r.packet_id][1] + str(r.query_id) for r in p.collect()) and len({x for x in behind.values()}) == 4
    b = spark.createDataFrame([("win", q, float(q)) for q in range(6)] + [("loss", q, float(-q)) for q in range(6)], "bucket string, query_id int, score double")
    s = {r.query_id: r.bucket for r in evaluate.selected_queries(b, a, "query_id", {"win": 2, "loss": 1}, 5, 1).collect()}
    assert (s[5], s[4], s[0]) == ("win", "win", "loss") and len(s) == 5 and list(s.values()).count("random") == 2


@pytest.mark.parametrize("budget", [20, 60, 400])
def test_packed_descriptions_of_many_edges(spark, budget, monkeypatch):
    """Against lists put together one by one; no list of a community's edges is longer than what its nodes can have within the budget."""
    import itertools
    import random

    r = random.Random(budget)
    names = [f"n{i:02}" for i in range(40)]
    edges = [(u, v, r.choice([1, 3, 8, 30])) for u, v in itertools.combinations(names, 2) if r.random() < 0.5] + [("n00", "n00", 5), ("n01", "out", 2)]
    members = [(0, f"0-{i % 3}", x) for i, x in enumerate(names)] + [(1, f"1-{i % 9}", x) for i, x in enumerate(names) if i % 3 < 2]
    tokens = {x: r.randrange(1, 6) for x in names}
    deg = {x: sum((u == x) + (v == x) for u, v, _ in edges) for x in [*names, "out"]}
    want = {}
    for c in {m[:2] for m in members}:
        own = {m[2] for m in members if m[:2] == c}
        n = list(itertools.accumulate(tokens[x] for x in sorted(own, key=lambda x: (-deg[x], x))))
        e = list(itertools.accumulate(t for u, v, t in sorted(edges, key=lambda x: (-deg[x[0]] - deg[x[1]], *x)) if {u, v} & own))
        a, b = ([x for x in y if x <= budget / 2] for y in (n, e))
        want[c] = (len(a), len(b), max(a, default=0) + max(b, default=0), n[-1] > budget / 2 or e[-1] > budget / 2)
    made = []
    real = community.written
    monkeypatch.setattr(community, "written", lambda df, name: (made.append(name), real(df, name))[1])
    got = community.packed_descriptions(
        spark.createDataFrame(members, "level int, community string, node string"), spark.createDataFrame(list(tokens.items()), "entity_name string, tokens int"), spark.createDataFrame(edges, "src string, tgt string, tokens int"), budget
    )
    assert {(x.level, x.community): (x.n_nodes, x.n_edges, x.used_tokens, x.truncated) for x in got.collect()} == want
    assert made == ["degrees", "edges"]  # ranked by node, once for all levels
