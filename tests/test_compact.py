"""Searches inside tasks give the paths of searches by joins."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import compact, graph, paths, retrieval


def drawn(n: int, m: int, seed: int) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


def local(e: list[tuple[int, int]], n: int, costs: list[int]) -> compact.Graph:
    g = compact.Graph([f"n{i:03}" for i in range(n)], *(np.array(x, np.int32) for x in zip(*e, strict=True)), weight=np.array(costs))
    g.cost = g.weight.astype(np.int32)
    g._lowest()
    return g


@pytest.mark.parametrize("seed", range(6))
def test_paths_of_small_graphs(seed):
    """Against all simple paths; few different costs, so that ties abound."""
    n = 9
    e = [x for x in drawn(n, 14, seed) if x[1] != 8] + [(8, 8)]
    r = random.Random(seed)
    c = [r.choice([1, 2, 3]) for _ in e]
    g, cost = local(e, n, c), {}
    for (u, v), x in zip(e, c, strict=True):
        cost[u, v] = cost[v, u] = x

    def every(s, t, path):
        if s == t:
            yield path
        for v in range(n):
            if (s, v) in cost and v not in path and s != t:
                yield from every(v, t, [*path, v])

    pairs = [p for p in itertools.permutations(range(n), 2)]
    caps = dict(zip(pairs, g.ceilings(pairs), strict=True))
    for s, t in pairs:
        p = list(every(s, t, [s]))
        w = lambda x: [cost[a] for a in zip(x, x[1:], strict=False)]
        assert g.shortest(s, t) == (min(p, key=lambda x: (len(x), x)) if p else [])
        assert g.cheapest(s, t) == (min(p, key=lambda x: (sum(w(x)), len(x), x)) if p else [])
        assert caps[s, t] == (min(max(w(x)) for x in p) if p else None)
        if p:
            assert g.shortest(s, t, caps[s, t]) == min((x for x in p if max(w(x)) <= caps[s, t]), key=lambda x: (len(x), x))
            assert paths._short(g, s, t, caps[s, t], 1)[0] == ([s, t] if (s, t) in cost else g.shortest(s, t))
    assert (g.dist == compact.FAR).all()


@pytest.mark.parametrize("strategy", ["query_weighted", "mcts"])
def test_in_tasks_as_by_joins(spark, strategy):
    r = np.random.default_rng(1)
    n, e = 16, drawn(16, 30, 5)
    names = [f"n{i:03}" for i in range(n)]
    edges = spark.createDataFrame([(names[u], names[v], float(r.integers(1, 4)), int(r.integers(1, 9))) for u, v in e], "src string, tgt string, weight double, tokens int")
    vec = spark.createDataFrame([(names[i], [float(x) for x in r.normal(size=6)] if i else [0.0] * 6) for i in range(n)], "id string, vec array<float>")
    ev = edges.select("src", "tgt").join(vec.select(F.col("id").alias("src"), F.col("vec").alias("a")), "src").join(vec.select(F.col("id").alias("tgt"), F.col("vec").alias("b")), "tgt")
    ev = ev.select("src", "tgt", F.zip_with(retrieval.unit("a"), retrieval.unit("b"), lambda x, y: (x + y) / 2).alias("vec"))
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in r.normal(size=6)]) for i in range(2)], "query_id string, qvec array<double>")
    keys = spark.createDataFrame([(f"q{i}", [names[j] for j in r.permutation(n)[:5]] + ["", "lost"][: 2 * i]) for i in range(2)] + [("lone", ["n001"])], "query_id string, keys array<string>")
    o = paths.PathOptions(strategy=strategy, max_path_edges=2)
    costs = paths.EndCosts(edges, vec, q, 1.0, 0.15, 0.05, lambda e, b: graph.block_costs(e, edges, ev, b.join(q, "query_id"), paths.UNIT))
    got = [{x.query_id: (x.path, [tuple(d) for d in x.decisions]) for x in paths.bridge_paths(edges, keys, o, costs, small).collect()} for small in (0, paths.SMALL)]
    assert len(got[0]) == 3 and got[0] == got[1]


@pytest.mark.parametrize("seed", range(3))
def test_tree_search_over_arrays(seed):
    """The candidate edges are the cheapest of each node, and the search over arrays finds what the search over a Net finds."""
    n, r = 60, random.Random(seed)
    e = [x for x in drawn(n, 700, seed) if x[1] < n - 1] + [(n - 2, n - 1)]
    g = local(e, n, [r.randrange(1, 30) for _ in e])
    g.tokens = np.ones(len(g.near), np.int32)
    o = paths.PathOptions(strategy="mcts", top_neighbours=2, iterations=12)
    assert max(g.degree) > 8
    u, k = g.candidates(list(range(n)), 1, 2)
    assert sorted(zip(u.tolist(), g.near[k].tolist(), strict=True)) == sorted((i, v) for i in range(n) for _, v in sorted((int(g.cost[a]), int(g.near[a])) for a in range(g.first[i], g.first[i + 1]))[:2])
    net = paths.Net((g.names[a], g.names[b], c * paths.UNIT, 1) for a, b, c in zip(u.tolist(), g.near[k].tolist(), g.cost[k].tolist(), strict=True))
    arrays = compact.Candidates(g, k, paths.UNIT)
    found = 0
    for s, t in itertools.permutations(range(0, n, 7), 2):
        want, got = paths.TreeSearch(net, g.names[s], g.names[t], o).run(), paths.TreeSearch(arrays, s, t, o, g.names).run()
        assert ([g.names[i] for i in got[0]], *got[1:]) == want
        found += len(want[0]) > 2
    assert found


def test_ceilings_of_many_edges(monkeypatch):
    """Against merging the edges one by one; the cheapest edges are enough for near pairs, and no path is searched for a bound."""
    n, r = 303, random.Random(7)
    e = drawn(n - 3, 12_000, 7) + [(n - 3, n - 2)]  # n - 1 has no edge
    c = [r.randrange(1, 900) for _ in e]
    c[-2] = 5000
    g = local([*e, (n - 1, n - 1)], n, [*c, 1])
    pairs = [tuple(r.sample(range(n), 2)) for _ in range(200)] + [(n - 3, n - 2), (0, n - 1)]
    com, want = list(range(n)), {}
    for x, u, v in sorted((x, u, v) for (u, v), x in zip(e, c, strict=True)):
        a, b = com[u], com[v]
        com = [a if y == b else y for y in com]
        for p in pairs:
            if com[p[0]] == com[p[1]]:
                want.setdefault(p, x)
    monkeypatch.setattr(g, "cheapest", None)
    tops = []
    forest = g._forest
    monkeypatch.setattr(g, "_forest", lambda lo, hi, com: (tops.append(hi), forest(lo, hi, com))[1])
    assert g.ceilings(pairs) == [want.get(p) for p in pairs]
    assert len(tops) > 2 and tops[0] < 200
    tops.clear()
    assert g.ceilings([e[c.index(1)]]) == [1] and len(tops) == 1
