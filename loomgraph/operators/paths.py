"""Bridge paths between the key entities of a query.

`search` finds the paths of all segments of many queries at once, over the whole graph, by joins: labels spread from both ends and are
given up where they can't be better any more. `Net` is the same on one small graph, for tests; the tree search, which is
sequential, runs on it inside a task, over a candidate graph that joins have pruned. `relaxed_costs` gives distances to all nodes."""

from __future__ import annotations

import heapq
import itertools
import math
import random
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from loomgraph.operators import compact
from loomgraph.operators.graph import both_ways
from loomgraph.session import cut, written


@dataclass(frozen=True)
class PathOptions:
    """Defaults of the retrieval parameters."""

    strategy: str = "unweighted"  # unweighted, query_weighted, minmax, minmax_budgeted, mcts
    max_path_edges: int = 120
    max_total_edges: int = 220
    fallback: str = "weighted"
    length_penalty: float = 0.02
    iterations: int = 96
    exploration: float = 1.2
    hops: int = 2
    max_hops: int = 4
    top_neighbours: int = 12
    widening: float = 2.0
    widening_power: float = 0.5
    rollout_top: int = 3
    rollout_depth: int = 4
    epsilon: float = 0.1
    token_budget: int = 12500
    token_penalty: float = 0.15
    target_reward: float = 1.0


class Net:
    """An undirected graph with edge costs (1 where unknown) and edge token counts. Neighbours are visited in name order."""

    def __init__(self, edges):
        self.near: dict[str, dict[str, tuple[float, int]]] = {}
        self.costed = False
        for u, v, cost, tokens in edges:
            known = cost is not None and not math.isnan(cost)
            self.costed |= known
            w = (float(cost) if known else 1.0, int(tokens or 0))
            self.near.setdefault(u, {})[v] = w
            self.near.setdefault(v, {})[u] = w
        self.near = {u: dict(sorted(x.items())) for u, x in self.near.items()}

    def cost(self, u: str, v: str) -> float:
        return self.near[u][v][0]

    def shortest(self, s: str, t: str, ceiling: float = math.inf) -> list[str]:
        """Fewest edges, over edges of cost up to the ceiling; empty if there is no path."""
        if s not in self.near or t not in self.near:
            return []
        came, todo = {s: s}, deque([s])
        while todo:
            u = todo.popleft()
            if u == t:
                out = [t]
                while out[-1] != s:
                    out.append(came[out[-1]])
                return out[::-1]
            for v, (c, _) in self.near[u].items():
                if v not in came and c <= ceiling:
                    came[v] = u
                    todo.append(v)
        return []

    def cheapest(self, s: str, t: str, far: dict[str, int] | None = None) -> list[str]:
        if s not in self.near or t not in self.near:
            return []
        best, came, todo = {s: 0.0}, {s: s}, [(0.0, s)]
        while todo:
            d, u = heapq.heappop(todo)
            if d > best[u]:
                continue
            if u == t:
                break
            for v, (c, _) in self.near[u].items():
                if d + c < best.get(v, math.inf):
                    best[v], came[v] = d + c, u
                    heapq.heappush(todo, (d + c, v))
        if t not in came:
            return []
        out = [t]
        while out[-1] != s:
            out.append(came[out[-1]])
        return out[::-1]

    def bottleneck(self, s: str, t: str, most_edges: int | None = None) -> list[str]:
        """The shortest path at the least cost ceiling that still leaves one (of at most most_edges). A higher ceiling only
        adds edges, so the ceiling is found by bisection over the distinct costs."""
        levels = sorted({c for x in self.near.values() for c, _ in x.values()})
        lo, hi, found = 0, len(levels) - 1, []
        while lo <= hi:
            mid = (lo + hi) // 2
            p = self.shortest(s, t, levels[mid])
            if p and (most_edges is None or len(p) - 1 <= most_edges):
                found, hi = p, mid - 1
            else:
                lo = mid + 1
        return found

    @property
    def size(self) -> int:
        return len(self.near)

    def has(self, u: str) -> bool:
        return u in self.near

    def around(self, s: str, t: str, radius: int, most: int) -> Net:
        """The `most` cheapest edges of each node within the radius of s or t that lead to such nodes."""
        inside = set(self.ball(s, radius)) | set(self.ball(t, radius))
        edges = []
        for u in sorted(inside):
            kept = sorted(((c, v, n) for v, (c, n) in self.near.get(u, {}).items() if v in inside))[:most]
            edges += [(u, v, c, n) for c, v, n in kept]
        return Net(edges)

    def ball(self, centre: str, radius: int) -> dict[str, int]:
        far, todo = {centre: 0}, deque([centre])
        while todo:
            u = todo.popleft()
            if far[u] < radius:
                for v in self.near.get(u, ()):
                    if v not in far:
                        far[v] = far[u] + 1
                        todo.append(v)
        return far


class TreeSearch:
    """Monte-Carlo tree search for a path of high utility (1 - cost) from source to target. net: a Net, or compact.Candidates, whose nodes are
    numbers in order of their names."""

    def __init__(self, net: Net | compact.Candidates, s, t, o: PathOptions, names: list[str] | None = None):
        self.full, self.s, self.t, self.o = net, s, t, o
        self.called = f"{s}|{t}" if names is None else f"{names[s]}|{names[t]}"

    def candidate(self) -> tuple[Net | compact.Around | None, int, bool, dict]:
        """The cheapest neighbours within the least radius around both ends that connects them, and all their distances from the target."""
        o = self.o
        for radius in range(o.hops, max(o.hops, o.max_hops) + 1):
            sub = self.full.around(self.s, self.t, radius, o.top_neighbours)
            if sub.has(self.s) and sub.has(self.t):
                far = sub.ball(self.t, sub.size)  # once a segment, not once an expansion
                if self.s in far:
                    return sub, radius, radius > o.hops, far
        return None, max(o.hops, o.max_hops), o.max_hops > o.hops, {}

    def reward(self, net: Net, path: list[str]) -> float:
        steps = list(zip(path, path[1:], strict=False))
        if not steps:
            return 0.0
        gain = sum(max(0.0, 1 - net.cost(u, v)) for u, v in steps) / len(steps)
        words = sum(net.near[u][v][1] for u, v in steps)
        reached = self.o.target_reward if path[-1] == self.t else 0.0
        return gain + reached - self.o.length_penalty * len(steps) - self.o.token_penalty * min(1.0, words / max(1, self.o.token_budget))

    def options(self, net: Net, far: dict, path) -> Iterator:
        """The ways on from a path, nearest to the target first, then cheapest, then in order."""
        u, seen = path[-1], set(path)
        if u not in self.ranked:
            near = net.near[u]
            self.ranked[u] = sorted((v for v in near if v in far), key=lambda v: (far[v], near[v][0], v))
        return (v for v in self.ranked[u] if v not in seen)

    def run(self) -> tuple[list, str, dict]:
        o = self.o
        net, radius, grown, far = self.candidate()
        size = net.size if net is not None else 0
        info = {"candidate_hops": radius, "radius_expanded": grown, "candidate_nodes": size}
        if net is None:
            return [], "mcts_no_path", info | {"reason": "candidate_subgraph_disconnected"}
        self.rng = random.Random(f"{self.called}|{size}")
        self.ranked: dict = {}
        plain = net.cheapest(self.s, self.t, far)
        usable = bool(plain) and len(plain) - 1 <= o.max_path_edges
        goal = self.reward(net, plain) if usable else math.inf
        visits: dict[tuple, int] = {}
        value: dict[tuple, float] = {}
        kids: dict[tuple, list[str]] = {}
        best, top, done = [], -math.inf, 0
        for done in range(1, o.iterations + 1):  # noqa: B007
            path, trail = (self.s,), [(self.s,)]
            while path[-1] != self.t and len(path) - 1 < o.max_path_edges:
                width = max(1, int(o.widening * max(1, visits.get(path, 0)) ** o.widening_power))
                have = kids.setdefault(path, [])
                fresh = next((v for v in self.options(net, far, path) if v not in have), None) if len(have) < width else None
                if fresh is not None:
                    have.append(fresh)
                    path = (*path, fresh)
                    trail.append(path)
                    break
                if not have:
                    break
                n = math.log(max(1, visits.get(path, 0)) + 1)
                here = path
                path = max(((*here, v) for v in have), key=lambda p: (value.get(p, 0.0) / max(1, visits.get(p, 0)) + o.exploration * math.sqrt(n / (1 + visits.get(p, 0))), p))
                trail.append(path)
            walk = list(path)
            for _ in range(o.rollout_depth):
                if walk[-1] == self.t or len(walk) - 1 >= o.max_path_edges:
                    break
                opts = list(itertools.islice(self.options(net, far, walk), o.rollout_top))
                if not opts:
                    break
                walk.append(self.rng.choice(opts) if self.rng.random() < o.epsilon else opts[0])
            r = self.reward(net, walk)
            if walk[-1] == self.t and r > top:
                best, top = walk, r
            for p in trail:
                visits[p] = visits.get(p, 0) + 1
                value[p] = value.get(p, 0.0) + r
            if best and top >= goal:
                break
        info["iterations"] = done
        if best and (not usable or top >= goal):
            return best, "mcts", info
        if usable:
            return plain, "mcts_weighted_fallback", info
        return (best, "mcts", info) if best else ([], "mcts_no_path", info | {"reason": "no_path_within_limits"})


def segment(net: Net, s: str, t: str, o: PathOptions) -> tuple[list[str], str, dict]:
    """(path, decision, details) between two entities by the chosen strategy; without any known cost it is unweighted."""
    if net.costed and o.strategy == "mcts":
        return TreeSearch(net, s, t, o).run()
    if net.costed and o.strategy == "query_weighted":
        p = net.cheapest(s, t)
        return p, "query_weighted" if p else "no_path", {}
    if net.costed and o.strategy == "minmax":
        p = net.bottleneck(s, t)
        return p, "minmax" if p else "no_path", {}
    if net.costed and o.strategy == "minmax_budgeted":
        most = max(1, o.max_path_edges)
        p = net.bottleneck(s, t, most)
        if p:
            return p, "minmax_budgeted", {}
        p = net.cheapest(s, t) if o.fallback == "weighted" else []
        if p and len(p) - 1 <= most:
            return p, "weighted_fallback", {}
        p = net.shortest(s, t)
        return p, "unweighted_fallback" if p else "no_path", {}
    p = net.shortest(s, t)
    return p, "unweighted" if p else "no_path", {}


def through(net: Net, keys: list[str], o: PathOptions) -> tuple[list[str], list[dict]]:
    """The path through the key entities in order, and a decision for each segment. An unreachable target is appended alone; the
    budgeted strategies stop before a segment that takes the whole path over its limit."""
    keys = list(dict.fromkeys(k for k in keys if k))
    path: list[str] = keys[:] if len(keys) < 2 else []
    out = []
    for s, t in zip(keys, keys[1:], strict=False):
        p, decision, info = segment(net, s, t, o)
        n, so_far = max(0, len(p) - 1), max(0, len(path) - 1)
        if o.strategy in ("minmax_budgeted", "mcts") and 0 < o.max_total_edges < so_far + n:
            out.append({"source": s, "target": t, "decision": "budget_stop", "path_edges": n} | info)
            break
        out.append({"source": s, "target": t, "decision": decision, "path_edges": n} | info)
        if not p:
            if not path or path[-1] != t:
                path.append(t)
        else:
            path += p[1:] if path else p
    return path, out


# ---------------------------------------------------------------- searches by joins

#: Costs are whole numbers of this part of one, so that sums don't depend on their order.
UNIT = 1e-6
#: Queries whose costs stand side by side in one array; more are answered in blocks.
BLOCK = 64
#: How far beyond the cheapest open label a search for bottlenecks expands in one round, in cost units.
SLACK = 20_000
#: Ceilings tried at once where a path has to be short too.
ARMS = 15
#: Edges up to which a graph is searched inside tasks, each of which has the whole graph: by costs, and by numbers of edges alone.
SMALL, SMALL_PLAIN = 8_000_000, 16_000_000
LABEL = "struct<cost: bigint, hops: int, path: array<string>>"


def segments(keys: DataFrame) -> DataFrame:
    """query_id, seg, source, target: consecutive key entities, each entity once and blank ones left out."""
    k = keys.select(F.col("query_id").cast("string").alias("query_id"), F.array_distinct(F.filter("keys", lambda x: F.coalesce(x, F.lit("")) != "")).alias("k")).filter(F.size("k") > 1)
    return k.select("query_id", F.posexplode(F.arrays_zip(F.slice("k", F.lit(1), F.size("k") - 1).alias("s"), F.slice("k", F.lit(2), F.size("k") - 1).alias("t"))).alias("seg", "p")).select("query_id", "seg", F.col("p.s").alias("source"), F.col("p.t").alias("target"))


def _lowest(sym: DataFrame) -> DataFrame:
    """u, low: for each query of the block the cost of the node's cheapest edge. sym is sorted by u inside its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a node in two batches gives two rows, of which the least counts
            if b.num_rows:
                u = b.column(0).to_numpy(zero_copy_only=False)
                c = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
                at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                low = np.minimum.reduceat(c, at)
                yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(list(low), pa.list_(pa.int32()))], names=["u", "low"])

    rows = sym.select("u", "costs").mapInArrow(run, "u string, low array<int>")
    return rows.groupBy("u").agg(F.reduce(F.slice(F.collect_list("low"), 2, 1 << 30), F.element_at(F.collect_list("low"), 1), lambda x, y: F.zip_with(x, y, lambda p, q: F.least(p, q))).alias("low"))


def search(sym: DataFrame, low: DataFrame | None, segs: DataFrame, bottleneck: bool = False) -> DataFrame:
    """sid, best (cost, hops, path): the path of least cost between the ends of each segment, then of fewest edges, then first in
    order of its nodes; no row where there is none. The whole graph is searched.

    sym: u, v[, costs (array by the query's number)], best persisted by u; without low every edge costs 1. segs: sid, q (the query's
    number), source, target[, cap (edges above it don't count)]. With bottleneck a path costs as much as its dearest edge, and only
    the cost is found.

    Labels spread from both ends, in each round from the end with fewer open labels. A label is given up if what it costs, its node's cheapest
    edge and the cheapest open label of the other end can't be better than the best path known: a better path would have an
    open label on both sides with at least that edge between them."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("node")), F.struct(F.lit(1).alias("side"), F.col("target").alias("node")))
    least = lambda c: F.array().cast("array<string>") if bottleneck else F.array(c)
    first = segs.select("sid", F.explode(ends).alias("e")).select("sid", "e.side", "e.node", F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit(0).alias("hops"), least(F.col("e.node")).alias("path")).alias("lab"))
    lab = written(first.withColumn("open", F.lit(True)).withColumn("new", F.lit(True)), "labels")
    best = None
    own = segs.select("sid", "q", (F.col("cap") if "cap" in segs.columns else F.lit(None).cast("bigint")).alias("cap"))
    add = (lambda a, b: F.greatest(a, b)) if bottleneck else (lambda a, b: a + b)
    while True:
        # paths through nodes that both ends have reached, one of them in the last round
        other = lab.select("sid", "node", F.col("side").alias("s2"), F.col("lab").alias("l2"), F.col("new").alias("n2"))
        met = lab.filter("side = 0").join(other.filter("s2 = 1"), ["sid", "node"]).filter("new OR n2")
        whole = F.struct(add(F.col("lab.cost"), F.col("l2.cost")).alias("cost"), (F.col("lab.hops") + F.col("l2.hops")).alias("hops"), (F.array().cast("array<string>") if bottleneck else F.concat("lab.path", F.slice("l2.path", F.lit(2), F.greatest(F.size("l2.path") - 1, F.lit(0))))).alias("path"))
        met = met.select("sid", whole.alias("best"))
        best = written((met if best is None else best.unionByName(met)).groupBy("sid").agg(F.min("best").alias("best")), "best")
        side = lambda k, f: f(F.when(F.col("side") == k, F.col("lab.cost")))
        turn = lab.filter("open").groupBy("sid").agg(side(0, F.count).alias("n0"), side(1, F.count).alias("n1"), side(0, F.min).alias("m0"), side(1, F.min).alias("m1")).filter("n0 > 0 AND n1 > 0")
        turn = turn.select("sid", (F.col("n1") < F.col("n0")).cast("int").alias("turn"), F.when(F.col("n1") < F.col("n0"), F.col("m1")).otherwise(F.col("m0")).alias("mine"), F.when(F.col("n1") < F.col("n0"), F.col("m0")).otherwise(F.col("m1")).alias("theirs"))
        turn = turn.join(best.select("sid", F.col("best.cost").alias("known")), "sid", "left")
        turn = written(turn.filter((F.col("known").isNull()) | ((F.greatest("mine", "theirs") < F.col("known")) if bottleneck else (F.col("mine") + F.col("theirs") <= F.col("known")))), "turns")
        if turn.isEmpty():
            break
        todo = F.col("open") & (F.col("side") == F.col("turn")) & ((F.col("lab.cost") <= F.col("mine") + SLACK) if bottleneck else F.lit(True))
        now = lab.filter("open").join(turn, "sid").filter(todo).join(own, "sid").withColumnRenamed("node", "u")
        if low is not None:
            now = now.join(low, "u").withColumn("low", F.get("low", F.col("q")).cast("bigint"))
        else:
            now = now.withColumn("low", F.lit(1).cast("bigint"))
        bound = F.greatest("lab.cost", "low", "theirs") < F.col("known") if bottleneck else F.col("lab.cost") + F.col("low") + F.col("theirs") <= F.col("known")
        step = now.filter(F.col("known").isNull() | bound).select("sid", "side", "u", "lab", "q", "cap", "known").join(sym, "u")
        cost = F.get("costs", F.col("q")).cast("bigint") if "costs" in sym.columns else F.lit(1).cast("bigint")
        step = step.withColumn("w", cost).filter((F.col("cap").isNull() | (F.col("w") <= F.col("cap"))))
        weigh = F.col("w") if low is not None or bottleneck else F.lit(1).cast("bigint")
        total = add(F.col("lab.cost"), weigh)
        step = step.filter(F.col("known").isNull() | ((total < F.col("known")) if bottleneck else (total <= F.col("known"))))
        path = F.col("lab.path") if bottleneck else F.when(F.col("side") == 0, F.concat("lab.path", F.array("v"))).otherwise(F.concat(F.array("v"), "lab.path"))
        step = step.groupBy("sid", "side", F.col("v").alias("node")).agg(F.min(F.struct(total.alias("cost"), (F.lit(0) if bottleneck else F.col("lab.hops") + 1).alias("hops"), path.alias("path"))).alias("found"))
        x = lab.drop("new").join(turn, "sid", "left").withColumn("open", F.coalesce(F.col("open") & F.col("turn").isNotNull() & ~todo, F.lit(False))).drop("turn", "mine", "theirs", "known")
        x = x.join(step, ["sid", "side", "node"], "full").withColumn("new", F.col("found").isNotNull() & (F.col("lab").isNull() | (F.col("found") < F.col("lab"))))
        lab = written(x.select("sid", "side", "node", F.when(F.col("new"), F.col("found")).otherwise(F.col("lab")).alias("lab"), (F.col("new") | F.coalesce("open", F.lit(False))).alias("open"), "new"), "labels")
    return best


def shortest_paths(edges: DataFrame, segs: DataFrame, small: int = SMALL_PLAIN) -> DataFrame:
    """query_id, seg, path: the path of fewest edges of each segment (see segments), ties by its nodes' names; equal segments of many
    queries are searched once. A graph of at most `small` edges is searched inside tasks, a larger one by joins."""
    if small:
        edges = written(edges.select("src", "tgt"), "edges")
        if edges.count() <= small:
            some = written(segs.select("source", "target").distinct(), "ends")
            p = compact.in_tasks(compact.packed(edges), some, "source", _ends, "source string, target string, path array<string>")
            return segs.join(written(p, "paths"), ["source", "target"]).select("query_id", "seg", "path")
    ends = segs.select("source", "target").distinct().withColumn("sid", F.xxhash64("source", "target"))
    ends = written(ends.select("sid", F.lit(0).alias("q"), "source", "target"), "ends")
    sym = both_ways(edges.select("src", "tgt")).select("u", "v").distinct().repartition("u").persist()
    best = search(sym, None, ends)
    sym.unpersist()
    return segs.join(ends.select("sid", "source", "target"), ["source", "target"]).join(best, "sid").select("query_id", "seg", F.col("best.path").alias("path"))


def _ends(g: compact.Graph, rows: list[dict]) -> Iterator[tuple]:
    for r in rows:
        s, t = r["source"], r["target"]
        p = g.shortest(g.number[s], g.number[t]) if s in g.number and t in g.number else [] if s != t else None
        if p or p is None:
            yield s, t, [s] if p is None else [g.names[i] for i in p]


@dataclass
class EndCosts:
    """Costs of edges whose vectors are the means of their ends' unit vectors, as graph.block_costs has them. edges: src <= tgt (each pair once),
    weight, tokens; vectors: id, vec; queries: query_id, qvec; by_joins: the same costs for what is searched by joins."""

    edges: DataFrame
    vectors: DataFrame
    queries: DataFrame
    alpha: float
    beta: float
    gamma: float
    by_joins: Callable[[DataFrame, DataFrame], DataFrame]

    def __call__(self, edges: DataFrame, block: DataFrame) -> DataFrame:
        return self.by_joins(edges, block)


def _in_tasks(keys: DataFrame, costs: EndCosts, o: PathOptions) -> DataFrame:
    """bridge_paths with all segments of a query in one task."""
    alpha, beta, gamma = costs.alpha, costs.beta, costs.gamma

    def run(g: compact.Graph, rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            ks = list(dict.fromkeys(k for k in r["keys"] or [] if k))
            if len(ks) < 2:
                yield r["query_id"], ks, []
                continue
            known = r["qvec"] is not None
            if known:
                g.weigh(np.array(r["qvec"], np.float64), UNIT, alpha, beta, gamma)
            pairs = list(zip(ks, ks[1:], strict=False))
            path, out = _joined(zip(pairs, _segments(g, pairs, replace(o, strategy=o.strategy if known else "unweighted")), strict=True), o)
            yield r["query_id"], path, out

    rows = written(keys.join(costs.queries.select(F.col("query_id").cast("string").alias("query_id"), "qvec"), "query_id", "left"), "queries")
    return compact.in_tasks(compact.packed(costs.edges, costs.vectors), rows, "query_id", run, RESULT)


def _segments(g: compact.Graph, pairs: list[tuple[str, str]], o: PathOptions) -> list[tuple[list[str], str]]:
    """(path, decision) of each pair of names, with the costs of the query that g has now."""
    at = [(g.number[s], g.number[t]) if s in g.number and t in g.number else None for s, t in pairs]
    open_ = [x for x in at if x]
    found: dict[tuple[int, int], tuple[list[int], str]] = {}
    most = max(1, o.max_path_edges)
    if o.strategy == "query_weighted":
        found = {x: (g.cheapest(*x), o.strategy) for x in open_}
    elif o.strategy in ("minmax", "minmax_budgeted"):
        for x, cap in zip(open_, g.ceilings(open_), strict=True):
            p = g.shortest(*x, cap) if cap is not None else []
            found[x] = (p, o.strategy) if not p or o.strategy == "minmax" or len(p) - 1 <= most else _short(g, *x, cap, most)
    elif o.strategy == "mcts":
        return _grown(g, pairs, at, o)
    else:
        found = {x: (g.shortest(*x), "unweighted") for x in open_}
    return [([g.names[i] for i in found[x][0]], found[x][1]) if x else ([], "no_path") for x in at]


def _short(g: compact.Graph, s: int, t: int, lo: int, most: int) -> tuple[list[int], str]:
    """The shortest path at the least ceiling that leaves one of at most `most` edges, where it is above lo; without one the shortest, since
    a cheapest path isn't shorter either."""
    fits = lambda p: p and len(p) - 1 <= most
    plain = g.shortest(s, t)
    if not fits(plain):
        return plain, "unweighted_fallback"
    hi = int(g.cost.max())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(g.shortest(s, t, mid)) else (mid, hi)
    return g.shortest(s, t, hi), "minmax_budgeted"


def _grown(g: compact.Graph, pairs: list[tuple[str, str]], at: list, o: PathOptions) -> list[tuple[list[str], str]]:
    names = g.names
    _, e = g.candidates([i for x in at if x for i in x], max(o.hops, o.max_hops) + 1, o.top_neighbours)
    net = compact.Candidates(g, e, UNIT)
    found = [TreeSearch(net, *x, o, names).run()[:2] if x else ([], "mcts_no_path") for x in at]
    return [([names[i] for i in p], decision) for p, decision in found]


class Costed:
    """A block of queries on a graph: its costs by query number, laid out by node for the rounds of a search."""

    def __init__(self, edges: DataFrame, segs: DataFrame):
        self.sym = both_ways(edges).repartition("u").sortWithinPartitions("u").persist()  # u, v, tokens, costs
        self.low = written(_lowest(self.sym), "lowest")
        self.segs = segs

    def close(self) -> None:
        self.sym.unpersist()

    def _named(self, best: DataFrame, decision: str) -> DataFrame:
        return best.select("sid", F.col("best.path").alias("path"), F.lit(decision).alias("decision"))

    def cheapest(self, segs: DataFrame, decision: str) -> DataFrame:
        return self._named(search(self.sym, self.low, segs), decision)

    def shortest(self, segs: DataFrame, decision: str) -> DataFrame:
        return self._named(search(self.sym, None, segs.drop("cap")), decision)

    def capped(self, segs: DataFrame) -> DataFrame:
        """sid, best: fewest edges over edges of cost up to each segment's cap."""
        return search(self.sym, None, segs)

    def bottleneck(self, segs: DataFrame, decision: str) -> DataFrame:
        """The shortest path at the least ceiling that leaves one."""
        ceiling = search(self.sym, self.low, segs, bottleneck=True).select("sid", F.col("best.cost").alias("cap"))
        return self._named(self.capped(written(segs.join(ceiling, "sid"), "capped")), decision)

    def budgeted(self, segs: DataFrame, o: PathOptions) -> DataFrame:
        """The shortest path at the least ceiling that leaves one of at most max_path_edges, else by the fallbacks."""
        most = max(1, o.max_path_edges)
        fits = lambda p: F.size(p) - 1 <= most
        free = written(self.bottleneck(segs, "minmax_budgeted"), "free")
        out = free.filter(fits("path"))
        over = written(free.filter(~fits("path")).select("sid").join(segs, "sid"), "over")
        if over.isEmpty():
            return out
        # a higher ceiling only adds edges, so the least one that leaves a short path is found by section
        top = self.sym.select(F.array_max("costs").alias("c")).agg(F.max("c")).first()[0]
        plain = written(self.shortest(over, "unweighted_fallback"), "plain")
        able = written(over.join(plain.filter(fits("path")).select("sid"), "sid").select(*over.columns, F.lit(-1).cast("bigint").alias("lo"), F.lit(top).cast("bigint").alias("hi")), "able")
        while not able.filter("hi - lo > 1").isEmpty():
            # ARMS ceilings of each segment at once, as segments of their own
            tried = able.filter("hi - lo > 1").withColumn("arm", F.explode(F.sequence(F.lit(1), F.lit(ARMS)))).withColumn("cap", F.col("lo") + F.ceil(F.col("arm") * (F.col("hi") - F.col("lo")) / (ARMS + 1)).cast("bigint"))
            tried = written(tried.filter("cap < hi").withColumn("whole", F.col("sid")).withColumn("sid", F.xxhash64("whole", "cap")), "tried")
            ok = self.capped(tried).filter(fits(F.col("best.path"))).select("sid", F.lit(True).alias("ok"))
            seen = tried.join(ok, "sid", "left").groupBy(F.col("whole").alias("sid")).agg(F.min(F.when(F.col("ok"), F.col("cap"))).alias("good"), F.max(F.when(F.col("ok").isNull(), F.col("cap"))).alias("bad"))
            able = written(able.join(seen, "sid", "left").select(*over.columns, F.greatest("lo", F.coalesce("bad", "lo")).alias("lo"), F.least("hi", F.coalesce("good", "hi")).alias("hi")), "able")
        out = out.unionByName(self._named(self.capped(able.withColumn("cap", F.col("hi"))), "minmax_budgeted"))
        lost = over.join(able.select("sid"), "sid", "left_anti")
        if o.fallback == "weighted" and not lost.isEmpty():
            w = written(self.cheapest(lost, "weighted_fallback").filter(fits("path")), "weighted")
            out = out.unionByName(w)
            lost = lost.join(w.select("sid"), "sid", "left_anti")
        return out.unionByName(plain.join(lost.select("sid"), "sid", "left_semi"))

    def candidates(self, seeds: DataFrame, o: PathOptions) -> DataFrame:
        """q, src, tgt, cost, tokens: the cheapest neighbours of every node within max_hops of a query's keys, over these edges."""
        seen = front = written(seeds.select("q", F.col("node").alias("u")).distinct(), "front")
        out = None
        for _ in range(max(o.hops, o.max_hops) + 1):
            near = front.join(self.sym, "u").select("q", "u", "v", "tokens", F.get("costs", F.col("q")).alias("cost"))
            near = near.withColumn("n", F.row_number().over(Window.partitionBy("q", "u").orderBy("cost", "v"))).filter(F.col("n") <= o.top_neighbours)
            near = written(near.drop("n"), "near")
            out = near if out is None else out.unionByName(near)
            front = written(near.select("q", F.col("v").alias("u")).distinct().join(seen, ["q", "u"], "left_anti"), "front")
            seen = seen.unionByName(front)
            if front.isEmpty():
                break
        return out.select("q", F.col("u").alias("src"), F.col("v").alias("tgt"), (F.col("cost") * UNIT).alias("cost"), "tokens")


RESULT = "query_id string, path array<string>, decisions array<struct<source: string, target: string, decision: string, path_edges: int>>"
Costs = DataFrame | Callable[[DataFrame, DataFrame], DataFrame]


def beside(edges: DataFrame, costs: DataFrame, block: DataFrame, size: int) -> DataFrame:
    """edges with the costs of a block's queries (query_id, q) in one array by q; a missing cost is 1."""
    c = costs.select(F.col("query_id").cast("string").alias("query_id"), F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), F.round(F.col("cost") / UNIT).cast("int").alias("c")).filter("c IS NOT NULL").join(block.select("query_id", "q"), "query_id")
    m = c.groupBy("src", "tgt").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("q", "c")))).alias("m"))  # at most BLOCK entries
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(int(1 / UNIT))))
    return edges.join(m, ["src", "tgt"], "left").withColumn("costs", filled).drop("m")


def joined_path(rows: pd.DataFrame, o: PathOptions) -> tuple[list[str], list[dict]]:
    """The segments of one query (source, target, path, decision) put together as `through` does."""
    return _joined((((r.source, r.target), (list(r.path) if r.path is not None else [], r.decision)) for r in rows.sort_values("seg").itertuples()), o)


def _joined(segs: Iterator[tuple[tuple[str, str], tuple[list[str], str]]], o: PathOptions) -> tuple[list[str], list[dict]]:
    path: list[str] = []
    out = []
    for (source, target), (p, decision) in segs:
        n, so_far = max(0, len(p) - 1), max(0, len(path) - 1)
        if o.strategy in ("minmax_budgeted", "mcts") and 0 < o.max_total_edges < so_far + n:
            out.append({"source": source, "target": target, "decision": "budget_stop", "path_edges": n})
            break
        out.append({"source": source, "target": target, "decision": decision if p else "no_path", "path_edges": n})
        if not p:
            path += [] if path and path[-1] == target else [target]
        else:
            path += p[1:] if path else p
    return path, out


def bridge_paths(edges: DataFrame, keys: DataFrame, options: PathOptions = PathOptions(), costs: Costs | None = None, small: int = SMALL) -> DataFrame:
    """query_id, path, decisions. edges: src, tgt[, tokens]; keys: query_id, keys (ordered array, of at most some dozens); costs: query_id,
    src, tgt, cost, or a function of (edges, block of queries: query_id, q) that gives the edges with a column costs: an array by q
    of whole numbers of UNIT. Without costs all paths have the fewest edges.

    All segments of a block of queries are searched at once, over the whole graph, by joins; only the tree search runs inside one
    task a query, on the cheapest neighbours around its keys. With EndCosts a graph of at most `small` edges is searched inside tasks."""
    key = written(keys.select(F.col("query_id").cast("string").alias("query_id"), "keys"), "keys")
    if isinstance(costs, EndCosts) and options.strategy not in ("unweighted", "none") and small and costs.edges.count() <= small:
        return _in_tasks(key, costs, options)
    segs = written(segments(key), "segments")
    e = edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), (F.col("tokens") if "tokens" in edges.columns else F.lit(0)).cast("int").alias("tokens"))
    e = written(e.groupBy("src", "tgt").agg(F.max("tokens").alias("tokens")), "graph")
    plain = segs
    found = None
    if costs is not None and options.strategy not in ("unweighted", "none"):
        ids = sorted(r[0] for r in segs.select("query_id").distinct().collect())  # a stated set of queries
        if not callable(costs):
            known = {r[0] for r in costs.filter("cost IS NOT NULL").select(F.col("query_id").cast("string")).distinct().collect()}
            ids = [i for i in ids if i in known]
        spark = edges.sparkSession
        for lo in range(0, len(ids), BLOCK):
            part = ids[lo : lo + BLOCK]
            block = spark.createDataFrame(list(zip(part, range(len(part)), strict=True)), "query_id string, q int")
            g = Costed(written(costs(e, block) if callable(costs) else beside(e, costs, block, len(part)), "costed"), block)
            mine = segs.join(F.broadcast(block), "query_id")  # at most BLOCK rows
            mine = written(mine.select(F.xxhash64("query_id", "seg").alias("sid"), "query_id", "seg", "q", "source", "target"), "segments")
            if options.strategy == "mcts":
                one = _searched(g, mine, options)
            elif options.strategy == "query_weighted":
                one = g.cheapest(mine, "query_weighted")
            elif options.strategy == "minmax":
                one = g.bottleneck(mine, "minmax")
            else:
                one = g.budgeted(mine, options)
            one = written(mine.join(one, "sid", "left").select("query_id", "seg", "source", "target", "path", "decision"), "paths")
            g.close()
            found = one if found is None else found.unionByName(one)
        if ids:
            plain = segs.join(found.select("query_id").distinct(), "query_id", "left_anti")
    p = shortest_paths(e, plain, SMALL_PLAIN if small else 0).withColumn("decision", F.lit("unweighted"))
    rest = plain.join(p, ["query_id", "seg"], "left").select("query_id", "seg", "source", "target", "path", "decision")
    every = rest if found is None else found.unionByName(rest)

    def run(k: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:  # the keys and segments of one query
        rows = []
        for q, ks in zip(k["query_id"], k["keys"], strict=True):
            path, dec = joined_path(g, options) if len(g) else (list(dict.fromkeys(x for x in ks if x)), [])
            rows.append((q, path, dec))
        return pd.DataFrame(rows, columns=["query_id", "path", "decisions"])

    of = every.withColumnRenamed("query_id", "of_query")
    return key.groupBy("query_id").cogroup(of.groupBy("of_query")).applyInPandas(run, RESULT)


def _searched(g: Costed, segs: DataFrame, o: PathOptions) -> DataFrame:
    """sid, path, decision of the tree search: one task a query, on its pruned candidate graph."""
    seeds = segs.select("q", F.explode(F.array("source", "target")).alias("node"))

    def run(s: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        net = Net(zip(c["src"], c["tgt"], c["cost"].astype(float), c["tokens"], strict=True))
        rows = [(r.sid, *TreeSearch(net, r.source, r.target, o).run()[:2]) for r in s.itertuples()]
        return pd.DataFrame(rows, columns=["sid", "path", "decision"])

    return segs.groupBy("q").cogroup(g.candidates(seeds, o).groupBy("q")).applyInPandas(run, "sid bigint, path array<string>, decision string")


def relaxed_costs(edges: DataFrame, origins: DataFrame, rounds: int | None = None, bottleneck: bool = False) -> DataFrame:
    """origin, node, cost by joins: each round relaxes the labels that fell in the last, until none falls, or over paths of at most
    `rounds` edges. edges: src, tgt, cost of at least 0; with bottleneck the cost of a path is its dearest edge."""
    sym = cut(both_ways(edges.select("src", "tgt", "cost")))
    lab = cut(origins.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost")).distinct().withColumn("new", F.lit(True)))
    for _ in itertools.count() if rounds is None else range(rounds):
        step = lab.filter("new").select("origin", F.col("node").alias("u"), F.col("cost").alias("c")).join(sym, "u")
        total = F.greatest("c", "cost") if bottleneck else F.col("c") + F.col("cost")
        step = step.groupBy("origin", F.col("v").alias("node")).agg(F.min(total).alias("n"))
        lab = cut(lab.drop("new").join(step, ["origin", "node"], "full").select("origin", "node", F.least("cost", "n").alias("cost"), (F.col("n").isNotNull() & (F.col("cost").isNull() | (F.col("n") < F.col("cost")))).alias("new")))
        if not lab.filter("new").limit(1).count():
            break
    return lab.select("origin", "node", "cost")


def path_edge_metrics(paths: DataFrame, costs: DataFrame) -> DataFrame:
    """query_id, n_edges, mean_cost, max_cost, mean_score over the path's own edges; an edge without a cost counts 1."""
    step = F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("tgt")))
    e = paths.select("query_id", F.explode(step).alias("e")).select("query_id", "e.src", "e.tgt")
    c = e.join(costs.select(F.col("query_id").cast("string").alias("query_id"), "src", "tgt", "cost"), ["query_id", "src", "tgt"], "left").withColumn("cost", F.coalesce("cost", F.lit(1.0)))
    return c.groupBy("query_id").agg(F.count("*").alias("n_edges"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("max_cost"), F.avg(1 - F.col("cost")).alias("mean_score"))
