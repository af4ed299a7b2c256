"""Communities by modularity, their hierarchy and reports.

The engine is distributed local moving: in each round the nodes of one random half look at their neighbours' communities and take
the one of greatest modularity gain; then communities are contracted to nodes and the rounds repeat. Everything is joins and
aggregations over edges, so a component of any size, a giant one too, is spread over all tasks; what has few edges may be split to
the end inside a task, by the same moves."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators import compact
from loomgraph.operators.graph import both_ways
from loomgraph.session import cut, written

SEED = 0xDEADBEEF
#: Rounds of contraction, and of moving in each.
LEVELS, ROUNDS = 2, 3
#: Inner edges up to which a community is split inside one task, and directed ones looked at at once there.
SMALL, SLICE = 2_000_000, 1 << 19


def _move(sym: DataFrame, st: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Rounds of local moving. sym: u, v, w; st: u, d (its weight), m2 (twice its scope's weight), c (its community). A node leaves
    its community only for one of greater gain; what staying is worth without a neighbour inside is counted too."""
    for r in range(rounds):
        tot = st.groupBy("c").agg(F.sum("d").alias("tot"))
        near = sym.join(st.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("kin"))
        home = st.join(tot.withColumnRenamed("tot", "tot_own"), "c").withColumnRenamed("c", "own")
        cand = near.join(tot, "c").join(home, "u")
        stay = F.col("c") == F.col("own")
        gain = F.round(F.col("kin") - F.col("d") * (F.col("tot") - F.when(stay, F.col("d")).otherwise(0.0)) / F.col("m2"), 9)
        alone = -F.col("d") * (F.col("tot_own") - F.col("d")) / F.col("m2")
        turn = F.pmod(F.xxhash64(F.lit(seed + r), F.col("u")), F.lit(2)) == 0
        best = cand.groupBy("u", "own", "d", "m2").agg(F.max_by("c", F.struct(gain, F.hash("c"))).alias("to"), F.max(gain).alias("g"), F.coalesce(F.max(F.when(stay, gain)), F.max(alone)).alias("g0"))
        st = cut(best.select("u", "d", "m2", F.when(turn & (F.col("g") > F.col("g0")), F.col("to")).otherwise(F.col("own")).alias("c")))
    return st


def modularity_communities(edges: DataFrame, scope: str | None = None, levels: int = LEVELS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """node, community (named after its least node). edges: src, tgt, weight[, scope]; nodes of different scopes don't mix."""
    e = edges.filter("src <> tgt").select(F.col(scope).cast("string").alias("scope") if scope else F.lit("").alias("scope"), "src", "tgt", F.coalesce("weight", F.lit(1.0)).cast("double").alias("w"))
    sym = cut(both_ways(e))
    weight = sym.groupBy("u", "scope").agg(F.sum("w").alias("d"))
    st = cut(weight.join(weight.groupBy("scope").agg(F.sum("d").alias("m2")), "scope").select("u", "d", "m2", F.col("u").alias("c")))
    sym = sym.select("u", "v", "w")
    lab = None
    for k in range(levels):
        st = _move(sym, st, rounds, seed + 100 * k)
        names = st.groupBy("c").agg(F.min("u").alias("name"))
        moved = cut(st.join(names, "c").select("u", "d", "m2", F.col("name").alias("c")))
        step = moved.select("u", "c")
        lab = step.withColumnRenamed("u", "node") if lab is None else cut(lab.withColumnRenamed("c", "u").join(step, "u").select("node", "c"))
        if k + 1 < levels:
            a, b = step.withColumnRenamed("c", "cu"), step.select(F.col("u").alias("v"), F.col("c").alias("cv"))
            sym = cut(sym.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))  # inner weight stays as a loop
            st = moved.groupBy(F.col("c").alias("u")).agg(F.sum("d").alias("d"), F.first("m2").alias("m2")).withColumn("c", F.col("u"))
    names = lab.groupBy("c").agg(F.min("node").alias("community"))
    return lab.join(names, "c").select("node", "community")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: modularity of a partition."""
    e = edges.filter("src <> tgt").select("src", "tgt", F.coalesce("weight", F.lit(1.0)).alias("w"))
    c = communities.select("node", "community")
    j = e.join(c.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(c.select(F.col("node").alias("tgt"), F.col("community").alias("ct")), "tgt")
    inside = j.filter("cs = ct").groupBy(F.col("cs").alias("c")).agg(F.sum("w").alias("i"))
    deg = j.select(F.explode(F.array("cs", "ct")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    m = e.agg(F.sum("w").alias("m"))
    return deg.join(inside, "c", "left").join(F.broadcast(m)).agg(F.sum(F.coalesce("i", F.lit(0.0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"), F.count("*").alias("communities"))


def hierarchical_communities(edges: DataFrame, max_size: int = 10, small: int = 0, stored: bool = False) -> DataFrame:
    """level, community, node: level 0 covers all nodes; a community larger than max_size is split on the next level, using its
    inner edges only, until none is larger or can be split: what a split leaves whole isn't repeated on the next level. All
    oversized communities of a level are split in one run, each in its own scope.

    What has at most `small` inner edges (build_index: SMALL) is split to the end inside a task, by the same moves in the same order; only larger
    graphs and communities are moved by joins. Both give the same communities. stored: the edges are a table that needn't be written again."""
    e = edges.select("src", "tgt", "weight")
    if not stored:
        e = written(e, "edges") if small else cut(e)
    if small and e.count() <= small:
        return _split_small(e.filter("src <> tgt").withColumn("s", F.lit("")), None, 0, max_size, small)
    now = cut(modularity_communities(e).select(F.lit(0).alias("level"), F.concat(F.lit("0-"), "community").alias("community"), "node"))
    out = now
    for k in itertools.count(1):
        big = now.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") > max_size).select("community")
        m = cut(now.join(big, "community", "left_semi").select("node", "community"))
        if m.isEmpty():
            break
        a = m.select(F.col("node").alias("src"), F.col("community").alias("s"))
        inner = e.join(a, "src").join(m.select(F.col("node").alias("tgt"), F.col("community").alias("s")), ["tgt", "s"])
        if small:
            inner = cut(inner.filter("src <> tgt").select("src", "tgt", "weight", "s"))
            huge = cut(inner.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("s"))
            of = F.col("community") == F.col("s")
            out = out.unionByName(_split_small(inner.join(huge, "s", "left_anti"), m.join(huge, of, "left_anti"), k, max_size, small))
            if huge.isEmpty():
                break
            m, inner = m.join(huge, of, "left_semi"), inner.join(huge, "s", "left_semi")
        part = modularity_communities(inner, "s").withColumnRenamed("community", "sub")
        x = cut(m.join(part, "node", "left").select("node", F.col("community").alias("whole"), F.concat(F.lit(f"{k}-"), F.coalesce("sub", "node")).alias("community")))
        parted = x.groupBy("whole").agg(F.min("community").alias("a"), F.max("community").alias("b")).filter("a <> b").select("whole")
        now = cut(x.join(parted, "whole", "left_semi").select(F.lit(k).alias("level"), "community", "node"))
        out = out.unionByName(now)
    return out


def _split_small(inner: DataFrame, members: DataFrame | None, level: int, max_size: int, small: int, seed: int = SEED) -> DataFrame:
    """level, community, node from `level` on, of scopes of at most `small` edges, packed into tasks of about as many. inner: src, tgt, weight, s (its
    scope); members: node, community (the scope); without members everything is one scope that level 0 divides."""
    first = members is None
    w = F.coalesce("weight", F.lit(1.0)).cast("double").alias("w")
    edges = compact.parcels(inner.select("src", "tgt", w)) if first else inner.select("s", "src", "tgt", w)
    nodes = inner.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().withColumn("s", F.lit("")) if first else members.select("node", F.col("community").alias("s"))
    turns = [(F.pmod(F.xxhash64(F.lit(seed + 100 * k + r), "node"), F.lit(2)) == 0).cast("int") * (1 << k * ROUNDS + r) for k in range(LEVELS) for r in range(ROUNDS)]
    nodes = nodes.select("node", "s", functools.reduce(lambda x, y: x + y, turns).alias("turns"), F.hash("node").alias("h"))
    task = F.lit(0).alias("task") if first else F.pmod(F.xxhash64("s"), F.lit(max(inner.sparkSession.sparkContext.defaultParallelism, 4 * inner.count() // small))).alias("task")

    def run(n: pa.Table, e: pa.Table) -> pa.Table:
        n = n.take(pc.sort_indices(n["node"]))  # numbers in order of names, so that the least number is the least name
        names = n["node"].combine_chunks()
        at = lambda x: np.asarray(pc.index_in(x, value_set=names), np.int32)
        scope = np.asarray(n["s"].combine_chunks().dictionary_encode().indices, np.int32)
        bits = np.asarray(n["turns"])[None, None] >> np.arange(LEVELS * ROUNDS).reshape(LEVELS, ROUNDS, 1) & 1 == 1
        src, tgt, w = compact.unpacked(e, at) if first else (at(e["src"]), at(e["tgt"]), np.asarray(e["w"]))
        out = [pa.table({"level": np.zeros(0, np.int32), "community": names[:0], "node": names[:0]})]
        for k, node, com in _splits(src, tgt, w, scope, bits, np.asarray(n["h"], np.int64), level, max_size, first):
            out.append(pa.table({"level": np.full(len(node), k, np.int32), "community": pc.binary_join_element_wise(str(k), names.take(pa.array(com)), "-"), "node": names.take(pa.array(node))}))
        return pa.concat_tables(out)

    return nodes.select("*", task).groupBy("task").cogroup(edges.select("*", task).groupBy("task")).applyInArrow(run, "level int, community string, node string")


def _splits(src: np.ndarray, tgt: np.ndarray, w: np.ndarray, scope: np.ndarray, turns: np.ndarray, h: np.ndarray, level: int, max_size: int, first: bool):
    """(level, nodes, their communities' least nodes), level by level until nothing is split. Nodes are numbers in order of their names."""
    here = np.ones(len(scope), bool)
    u, v, w = np.concatenate([src, tgt]), np.concatenate([tgt, src]), np.concatenate([w, w])
    order = np.argsort(u.astype(np.int64) * len(scope) + v)
    u, v, w = u[order], v[order], w[order]
    del order
    while True:
        inside = here[u] & here[v] & (scope[u] == scope[v])
        u, v, w = u[inside], v[inside], w[inside]
        com = _parts(u, v, w, scope, turns, h)
        if not first:  # what a split leaves whole isn't repeated
            lo, hi = np.full(scope.max() + 1, len(scope)), np.full(scope.max() + 1, -1)
            np.minimum.at(lo, scope[here], com[here])
            np.maximum.at(hi, scope[here], com[here])
            here = here & (lo < hi)[scope]
        node = np.flatnonzero(here)
        if not len(node):
            return
        yield level, node, com[node]
        size = np.bincount(com[node], minlength=len(scope))
        here = here & (size > max_size)[com]
        scope, level, first = com, level + 1, False
        if not here.any():
            return


def _slices(u: np.ndarray) -> list[tuple[int, int]]:
    """(first and last place) of parts of the sorted u, none of which divides equal ones."""
    cuts = [0]
    while cuts[-1] < len(u):
        cuts.append(int(np.searchsorted(u, u[min(cuts[-1] + SLICE, len(u)) - 1], "right")))
    return list(itertools.pairwise(cuts))


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and the sums of w."""
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(w[order], start)


def _parts(u: np.ndarray, v: np.ndarray, w: np.ndarray, scope: np.ndarray, turns: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The least node of each node's community: modularity_communities over arrays, of which u is sorted. A node without edges stays alone.
    Only the edges of nodes whose turn it is are looked at, slice by slice."""
    n = len(scope)
    lab = np.arange(n)
    d = np.bincount(u, w, n)
    m2 = np.bincount(scope, d)[scope]
    for k in range(LEVELS):
        c = np.arange(n)
        cuts = _slices(u)
        for r in range(ROUNDS):
            tot, new = np.bincount(c, d, n), c.copy()
            for lo, hi in cuts:
                mine = turns[k, r][u[lo:hi]]
                if not mine.any():
                    continue
                key, kin = _summed(u[lo:hi][mine] * np.int64(n) + c[v[lo:hi][mine]], w[lo:hi][mine])
                at, to = np.divmod(key, n)
                stay = to == c[at]
                gain = np.round(kin - d[at] * (tot[to] - np.where(stay, d[at], 0.0)) / m2[at], 9)
                start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                who, long = at[start], np.diff(np.r_[start, len(at)])
                top = np.maximum.reduceat(gain, start)
                best = gain == np.repeat(top, long)
                mark = np.where(best, h[to], np.iinfo(np.int64).min)
                best &= mark == np.repeat(np.maximum.reduceat(mark, start), long)
                pick = np.minimum.reduceat(np.where(best, np.arange(len(at)), len(at)), start)
                g0 = -d[who] * (tot[c[who]] - d[who]) / np.where(m2[who] > 0, m2[who], 1.0)
                g0[np.repeat(np.arange(len(who)), long)[stay]] = gain[stay]
                go = top > g0
                new[who[go]] = to[pick[go]]
            c = new
        least = np.full(n, n)
        np.minimum.at(least, c[lab], lab)
        lab = least[c[lab]]
        if k + 1 < LEVELS and len(u):
            parts = [_summed(lab[u[lo:hi]] * n + lab[v[lo:hi]], w[lo:hi]) for lo, hi in cuts]
            key, w = _summed(*map(np.concatenate, zip(*parts, strict=True)))  # inner weight stays as a loop
            u, v = np.divmod(key, n)
            d = np.bincount(lab, d, n)
    return lab


def extractive_reports(members: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """level, community, title, summary, rating, findings: a report without a language model, from the most central nodes and
    edges. members: level, community, node; nodes: entity_name, description; edges: src, tgt, description."""
    deg = edges.select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    m = members.join(deg, "node", "left").fillna(0, ["degree"]).join(nodes.select(F.col("entity_name").alias("node"), F.col("description").alias("nd")), "node", "left")
    w = Window.partitionBy("level", "community").orderBy(F.desc("degree"), "node")
    central = m.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    head = central.groupBy("level", "community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "node", F.substring(F.coalesce("nd", F.lit("")), 1, 200).alias("d")))), lambda x: F.struct(x["node"].alias("summary"), x["d"].alias("explanation"))).alias("findings"))
    size = members.groupBy("level", "community").agg(F.count_distinct("node").alias("n"))
    names = F.transform("findings", lambda f: f["summary"])
    return head.join(size, ["level", "community"]).select(
        "level", "community", F.concat(F.lit("Community of "), F.array_join(F.slice(names, 1, 3), ", ")).alias("title"),
        F.concat(F.col("n").cast("string"), F.lit(" entities around "), F.get(names, F.lit(0)), F.lit(".")).alias("summary"),
        F.least(F.lit(10.0), F.round(F.log2(1.0 + F.col("n")), 3)).alias("rating"), "findings",
    )


def packed_descriptions(members: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int, reports: DataFrame | None = None) -> DataFrame:
    """level, community, n_nodes, n_edges, used_tokens, truncated: what fits of a community's description. Nodes and edges get half
    the budget each, most connected first; where they are cut and reports of sub-communities (level, parent, tokens, occurrence)
    exist, those come first, and nodes and edges share the rest."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node"))
    deg = written(ends.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    g = ["level", "community"]
    run = lambda w: F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0))
    half = F.lit(budget / 2)
    n = members.join(nodes.select(F.col("entity_name").alias("node"), F.col("tokens").alias("t")), "node").join(deg, "node", "left").fillna(0, ["degree"])
    n = n.withColumn("s", run(Window.partitionBy(*g).orderBy(F.desc("degree"), "node")))
    # what goes over half the budget before an edge among its node's edges does so among its community's: each node's are ranked once for all
    # levels, and the first that goes over stands too, so that no later one seems to fit
    own = edges.select("src", "tgt", F.col("tokens").alias("t")).distinct()
    own = own.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(deg.select(F.col("node").alias("tgt"), F.col("degree").alias("b")), "tgt").select("src", "tgt", "t", (F.col("a") + F.col("b")).alias("ab"))
    own = written(own, "edges")
    order = [F.desc("ab"), "src", "tgt"]
    e = own.withColumn("node", F.explode(F.array_distinct(F.array("src", "tgt")))).withColumn("s", run(Window.partitionBy("node").orderBy(*order))).filter(F.coalesce(F.col("s") - F.coalesce("t", F.lit(0)) <= half, F.lit(True)))
    e = e.join(members, "node").select(*g, "src", "tgt", "t", "ab").distinct().withColumn("s", run(Window.partitionBy(*g).orderBy(*order)))
    # all tokens of a community's edges: those of its nodes, less what stands between two of them and so counts twice
    mine = members.groupBy("node").agg(F.collect_set(F.struct(*g)).alias("of"))  # a node's communities: one a level
    at = own.select("t", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("node")).groupBy("node").agg(F.sum("t").alias("t")).join(mine, "node").select("t", F.explode("of").alias("c"))
    twice = own.filter("src <> tgt").join(mine.withColumnsRenamed({"node": "src", "of": "x"}), "src").join(mine.withColumnsRenamed({"node": "tgt", "of": "y"}), "tgt").select((-F.col("t")).alias("t"), F.explode(F.array_intersect("x", "y")).alias("c"))
    et = at.unionByName(twice).groupBy("c.level", "c.community").agg(F.sum("t").alias("et"))
    total = n.groupBy(*g).agg(F.sum("t").alias("nt")).join(et, g, "left").fillna(0, ["et"])
    total = total.withColumn("truncated", (F.col("nt") > half) | (F.col("et") > half))
    if reports is not None:
        r = reports.select("level", F.col("parent").alias("community"), F.col("tokens").alias("rt"), "occurrence", "child")
        r = r.withColumn("s", F.sum("rt").over(Window.partitionBy(*g).orderBy(F.desc("occurrence"), "child").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("s") <= budget).groupBy(*g).agg(F.max("s").alias("report"))
        total = total.join(r, g, "left")
    else:
        total = total.withColumn("report", F.lit(None).cast("long"))
    total = total.withColumn("share", F.when(F.col("truncated"), (F.lit(budget) - F.coalesce("report", F.lit(0))) / 2).otherwise(half))
    cnt = lambda x, name: x.join(total.select(*g, "share"), g).filter(F.col("s") <= F.col("share")).groupBy(*g).agg(F.count("*").alias(name), F.max("s").alias(name + "_t"))
    out = total.join(cnt(n, "n_nodes"), g, "left").join(cnt(e, "n_edges"), g, "left").fillna(0, ["n_nodes", "n_edges", "n_nodes_t", "n_edges_t"])
    return out.select(*g, "n_nodes", "n_edges", (F.col("n_nodes_t") + F.col("n_edges_t") + F.when(F.col("truncated"), F.coalesce("report", F.lit(0))).otherwise(0)).alias("used_tokens"), "truncated")
