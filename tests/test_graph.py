import itertools
import math

import pytest

from loomgraph.operators import community, evaluate, graph, hierarchy, retrieval, vectors
from loomgraph.operators.paths import Net, PathOptions, bridge_paths, relaxed_costs, segment, through
from loomgraph.plans import catalog

SQUARE = [("A", "B"), ("B", "D"), ("A", "C"), ("C", "E"), ("E", "D")]


def net(costs, default):
    return Net([(u, v, costs.get(u + v, default), 0) for u, v in SQUARE])


def line(names):
    return Net([(a, b, 0.1, 0) for a, b in itertools.pairwise(names)])


def test_strategies():
    assert segment(Net([("A", "B", None, 0), ("B", "C", None, 0)]), "A", "C", PathOptions())[:2] == (["A", "B", "C"], "unweighted")
    o = PathOptions(strategy="query_weighted")
    assert segment(net({"AB": 10, "BD": 10}, 1), "A", "D", o)[0] == list("ACED")
    assert segment(net({"AB": 1, "BD": 9}, 3), "A", "D", PathOptions(strategy="minmax"))[0] == list("ACED")
    assert segment(net({"AB": 1, "BD": 9}, 3), "A", "D", PathOptions(strategy="minmax_budgeted", max_path_edges=2))[:2] == (list("ABD"), "minmax_budgeted")


def test_tree_search():
    o = PathOptions(strategy="mcts", hops=2, max_hops=3, max_path_edges=6, iterations=32)
    p, d, info = segment(line("ABCDEFG"), "A", "G", o)
    assert p == list("ABCDEFG") and info["candidate_hops"] == 3 and info["radius_expanded"]
    p, d = through(line("ABCDEFGHI"), ["A", "I"], o)
    assert p == ["I"] and d[0]["decision"] == "mcts_no_path" and d[0]["reason"] == "candidate_subgraph_disconnected"
    p, d, info = segment(net({"AB": 9, "BD": 9}, 0.1), "A", "D", PathOptions(strategy="mcts", max_path_edges=4, iterations=64))
    assert p == list("ACED") and d in ("mcts", "mcts_weighted_fallback") and info["candidate_nodes"] == 5 and not info["radius_expanded"]


def all_paths(n, s, t, seen=()):
    if s == t:
        yield (*seen, t)
    for v in n.near[s]:
        if v not in seen and s != t:
            yield from all_paths(n, v, t, (*seen, s))


def test_costs_against_all_paths():
    edges = [(u, v, ((ord(u) * 7 + ord(v) * 3) % 10 + 1) / 10, 1) for u, v in itertools.combinations("ABCDEFG", 2) if (ord(u) + ord(v)) % 3]
    n = Net(edges)
    cost = lambda p: [n.cost(a, b) for a, b in itertools.pairwise(p)]
    for s, t in itertools.permutations("ABCDEFG", 2):
        every = list(all_paths(n, s, t))
        assert math.isclose(sum(cost(n.cheapest(s, t))), min(sum(cost(p)) for p in every))
        assert max(cost(n.bottleneck(s, t))) == min(max(cost(p)) for p in every)
        assert len(n.shortest(s, t)) == min(map(len, every))


def test_budget_stop_and_unreachable():
    p, d = through(line("ABCDEFG"), ["A", "C", "G"], PathOptions(strategy="minmax_budgeted", max_total_edges=3))
    assert p == list("ABC") and d[1]["decision"] == "budget_stop"
    p, d = through(line("AB"), ["A", "Z", "B"], PathOptions())
    assert p == ["Z", "B"] and [x["decision"] for x in d] == ["no_path", "no_path"]
    assert through(line("AB"), ["A"], PathOptions()) == (["A"], [])


def test_bridge_paths_and_relaxation(spark):
    e = spark.createDataFrame(SQUARE, "src string, tgt string")
    k = spark.createDataFrame([("q", ["A", "D"]), ("r", ["B"])], "query_id string, keys array<string>")
    c = spark.createDataFrame([("q", u, v, 10.0 if "B" in (u, v) else 1.0) for u, v in SQUARE], "query_id string, src string, tgt string, cost double")
    got = {r.query_id: r.path for r in bridge_paths(e, k, PathOptions(strategy="query_weighted"), c).collect()}
    assert got == {"q": list("ACED"), "r": ["B"]}
    o = spark.createDataFrame([("A",)], "node string")
    assert {r.node: r.cost for r in relaxed_costs(c, o, 5).collect()}["D"] == 3.0


@pytest.mark.parametrize("strategy", ["unweighted", "query_weighted", "minmax", "minmax_budgeted"])
def test_searches_against_one_net(spark, strategy):
    """Searches by joins give what the search on one small graph gives, whatever the detour."""
    names = [f"n{i:02}" for i in range(40)]
    at = [(names[i], names[j], 1 + (i * 7 + j * 13) % 23) for i, j in itertools.combinations(range(40), 2) if j == i + 1 or (i * j) % 11 == 3] + [("x", "y", 3)]
    costs = [(q, u, v, (c * (1 + q) % 29 + 1) / 32) for q in range(3) for u, v, c in at]
    keys = [(q, [names[(q * 7 + 13 * k) % 40] for k in range(4)] + ["x", "", names[q]]) for q in range(3)]
    o = PathOptions(strategy=strategy, max_path_edges=4, max_total_edges=30)
    e = spark.createDataFrame([(u, v) for u, v, _ in at], "src string, tgt string")
    k = spark.createDataFrame([(str(q), x) for q, x in keys] + [("lone", ["x"]), ("none", [])], "query_id string, keys array<string>")
    c = spark.createDataFrame([(str(q), *x) for q, *x in costs], "query_id string, src string, tgt string, cost double")
    got = {r.query_id: r for r in bridge_paths(e, k, o, c).collect()}
    assert got["lone"].path == ["x"] and got["none"].path == []
    for q, ks in keys:
        n = Net([(u, v, cost, 0) for i, u, v, cost in costs if i == q])
        path, dec = through(n, ks, o)
        mine = [(d.source, d.target, d.decision, d.path_edges) for d in got[str(q)].decisions]
        weigh = lambda p, n=n: [n.cost(a, b) for a, b in itertools.pairwise(p)]
        assert [m[:3] for m in mine] == [(d["source"], d["target"], d["decision"]) for d in dec]
        if strategy == "query_weighted":  # ties in cost may be broken otherwise
            assert sum(c for a, b in itertools.pairwise(got[str(q)].path) for c in [n.near[a].get(b, (0, 0))[0]]) == pytest.approx(sum(c for a, b in itertools.pairwise(path) for c in [n.near[a].get(b, (0, 0))[0]]))
        else:
            assert got[str(q)].path == path and [m[3] for m in mine] == [d["path_edges"] for d in dec] and weigh(path[:2])


def test_merges(spark):
    m = spark.createDataFrame([("COMPOST", "concept", "d1", "c1", 0), ("COMPOST", "matter", "d2", "c2", 1), ("SOIL", "x", "d", None, 2)], "entity_name string, entity_type string, description string, source_id string, pos int")
    n = {r.entity_name: r for r in graph.merge_nodes(m).collect()}
    assert n["COMPOST"].entity_type == "concept" and n["COMPOST"].description == "d1<SEP>d2" and n["COMPOST"].source_ids == ["c1", "c2"]
    r = spark.createDataFrame([("C", "S", 8.0, "a", "c1"), ("S", "C", 3.0, "b", "c2"), (None, "S", 1.0, "x", "c")], "src_id string, tgt_id string, weight double, description string, source_id string")
    assert [(x.src, x.tgt, x.weight) for x in graph.merge_edges(r).collect()] == [("C", "S", 11.0)]
    z = spark.createDataFrame([("C", "S", 0.0, "a", "c1")], r.schema)
    assert graph.merge_edges(z, True).first().weight == 1.0


def test_components_degrees_triangles(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("z", "z")], "src string, tgt string")
    c = {r.node: r.component for r in graph.components(e).collect()}
    assert {c[f"n{i:03}"] for i in range(61)} == {"n000"} and c["y"] == "x" and c["z"] == "z"
    assert graph.largest_component(e).count() == 61
    assert {r.node: r.degree for r in graph.degrees(e).collect()}["z"] == 2
    t = graph.triangle_stats(spark.createDataFrame(list(itertools.combinations("abcd", 2)), "src string, tgt string")).first()
    assert (t.triangles, t.transitivity, t.sparsity) == (4, 1.0, 0.0)


def test_two_cliques(spark):
    e = [(a, b, 1.0) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("d", "w", 1.0)]
    c = {r.node: r.community for r in community.modularity_communities(spark.createDataFrame(e, "src string, tgt string, weight double")).collect()}
    assert len({c[x] for x in "abcd"}) == 1 and len({c[x] for x in "wxyz"}) == 1 and c["a"] != c["z"]


def test_sparsity_entropy_split(spark):
    s = evaluate.cluster_sparsity(spark.createDataFrame([(0, "a")] * 3 + [(0, "b")] * 2, "level int, label string"), "level", "label").first()
    assert s.sparsity == pytest.approx(0.6)
    e = {r.g: r.entropy for r in graph.normalized_entropy(spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (2, "B")], "g int, k string"), ["g"], "k").collect()}
    assert e[1] == 0 and e[2] > 0.9


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<double>")
    assert [r.vec_id for r in vectors.topk(v, q, 2).orderBy("dense_order").collect()] == [1, 3]
    assert vectors.topk(v.limit(0), q, 2).count() == 0
    h = spark.createDataFrame([("q", "A", 0.9, 0), ("q", "B", 0.8, 1)], "query_id string, id string, score double, dense_order int")
    assert [r.id for r in vectors.rerank(h, None, 2, 2, "id").orderBy("final_order").collect()] == ["A", "B"]
    s = spark.createDataFrame([("q", "B", 2.0)], "query_id string, id string, rerank_score double")
    assert [r.id for r in vectors.rerank(h, s, 2, 2, "id").orderBy("final_order").collect()] == ["B", "A"]


def test_soft_clusters(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id bigint, v array<double>")
    assert hierarchy.soft_clusters(same, "id", "v").select("id").distinct().count() == 5
    two = spark.createDataFrame([(i, [1.0, 0.01 * i, 0.0] if i % 2 else [0.0, 0.01 * i, 1.0]) for i in range(40)], "id bigint, v array<double>")
    c = {(r.id % 2, r.cluster) for r in hierarchy.soft_clusters(two, "id", "v", 3).filter("p > 0.5").collect()}
    assert {k for k, _ in c} == {0, 1} and len({x for _, x in c}) >= 2


def test_more_than_six_clusters(spark):
    at = [(math.cos(g * math.pi / 5), math.sin(g * math.pi / 5)) for g in range(10)]
    rows = [(i, [at[i % 10][0] + 0.01 * math.sin(i), at[i % 10][1] + 0.01 * math.cos(3 * i), 1.0]) for i in range(400)]
    c = hierarchy.soft_clusters(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v").filter("p > 0.5").collect()
    assert len({r.cluster for r in c}) == len({(r.id % 10, r.cluster) for r in c}) == 10


def test_layers_end_by_their_rules(spark, monkeypatch):
    def pairs(df, key, vec, most):
        return df.selectExpr(key, f"CAST(greatest(row_number() OVER (ORDER BY {key}) - 2, 0) AS int) AS cluster", "1.0D AS p")

    monkeypatch.setattr(hierarchy, "soft_clusters", pairs)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "id bigint, v array<double>")
    got = hierarchy.layers(df, "id", "v", sparsity_at=2.0, change_at=-1.0).groupBy("layer").count().collect()
    assert {r.layer: r["count"] for r in got} == {i: 8 - i for i in range(6)}


def test_relaxation_to_the_end(spark):
    at = [(f"n{i:02}", f"n{j:02}", ((i * 7 + j * 3) % 10 + 1) / (100 if j == i + 1 else 10)) for i, j in itertools.combinations(range(14), 2) if j == i + 1 or (i + j) % 5 == 0]
    n = Net([(u, v, c, 0) for u, v, c in at])
    e = spark.createDataFrame([*at, ("x", "y", 1.0)], "src string, tgt string, cost double")
    o = spark.createDataFrame([("n00",), ("n13",)], "node string")
    for bottleneck, search, fold in ((False, n.cheapest, sum), (True, n.bottleneck, max)):
        got = {(r.origin, r.node): r.cost for r in relaxed_costs(e, o, bottleneck=bottleneck).collect()}
        ways = {(s, t): search(s, t) for s in ("n00", "n13") for t in n.near if s != t}
        assert max(map(len, ways.values())) > 5
        want = {k: fold(n.cost(a, b) for a, b in itertools.pairwise(p)) for k, p in ways.items()}
        assert got == pytest.approx(want | {("n00", "n00"): 0.0, ("n13", "n13"): 0.0})


def test_reranking_changes_the_order(spark):
    docs = spark.createDataFrame([(1, "Green Compost feeds Clay Soil. Worms like Rain."), (2, "Clay Soil holds Rain. Old Barns stand in Fog.")], "doc_id bigint, text string")
    ix = retrieval.build_index(docs)
    q = spark.createDataFrame([("q", "what does rain do to clay soil")], "query_id string, query string")
    q = vectors.embed(q, "query_id", "query").withColumnRenamed("vec", "qvec").join(q, "query_id")
    o = retrieval.QueryOptions(threshold=-1.0)
    order = lambda o, r=None: [x.node for x in retrieval.entity_hits(ix, q, o, r).orderBy("dense_order").collect()]
    plain, again = order(o), order(retrieval.QueryOptions(threshold=-1.0, rerank=True))
    assert sorted(plain) == sorted(again) and plain != again and again[0] == "CLAY SOIL"
    longest = order(retrieval.QueryOptions(threshold=-1.0, rerank=True), lambda queries, texts: [float(len(t)) for t in texts])
    assert [len(x) for x in longest] == sorted(map(len, longest), reverse=True)
    with pytest.raises(ValueError):
        retrieval.entity_hits(ix, q.drop("query"), retrieval.QueryOptions(rerank=True))


def test_edge_costs_of_all_queries(spark, tmp_path):
    vec = {i: [math.sin(i + j) for j in range(4)] for i in range(301)}
    items = [(i % 40, i * i % 7, float(i % 5 + 1)) for i in range(120)]
    spark.createDataFrame(list(vec.items()), "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(items, "l_partkey bigint, l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    weight, degree = {}, {}
    for p, s, x in items:
        weight[p, s] = weight.get((p, s), 0.0) + x
    for p, s in weight:
        for v in (f"p{p}", f"s{s}"):
            degree[v] = degree.get(v, 0) + 1
    ends = {(p, s): degree[f"p{p}"] + degree[f"s{s}"] for p, s in weight}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    want = {(q, f"p{p}", f"s{s}"): 1 - cos(vec[p], vec[q]) + 0.15 * ends[p, s] / max(ends.values()) + 0.05 / (1 + w) for q in (0, 100, 200, 300) for (p, s), w in weight.items()}
    got = {(r.query_id, r.src, r.tgt): r.cost for r in catalog.QUERIES["edge_cost"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_splits_go_on(spark, monkeypatch):
    def halves(e, scope=None):
        n = e.selectExpr(f"{scope or 'left(src, 1)'} AS s", "explode(array(src, tgt)) AS node").distinct()
        half = "IF(node LIKE 'z%', 1, ntile(2) OVER (PARTITION BY s ORDER BY node))" if scope else "1"
        return n.selectExpr("*", f"{half} AS h").selectExpr("node", "min(node) OVER (PARTITION BY s, h) AS community")

    monkeypatch.setattr(community, "modularity_communities", halves)
    e = [(f"{g}{i:02}", f"{g}{j:02}", 1.0) for g in "az" for i, j in itertools.combinations(range(16), 2)]
    c = community.hierarchical_communities(spark.createDataFrame(e, "src string, tgt string, weight double"), 2).groupBy("level", "community").count().collect()
    assert sorted((r.level, r["count"]) for r in c) == [(0, 16)] * 2 + [(1, 8)] * 2 + [(2, 4)] * 4 + [(3, 2)] * 8
