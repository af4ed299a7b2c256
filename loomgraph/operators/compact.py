"""Searches of paths inside tasks, over a whole graph packed into arrays: for graphs that fit a task (`paths.SMALL`).

Each task has the whole graph and a part of the queries. Nodes are numbers in order of their names, so the first path in order of numbers
is the first in order of names; results are those of `paths.search`."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.session import written

#: Bytes of a packed graph in one row.
PIECE = 1 << 23
#: A weight is cost << HOP plus 1 an edge, so that sums order by cost, then by edges.
HOP = 20
FAR = np.iinfo(np.int64).max >> 1
#: Directed edges whose costs are computed at once.
SLICE = 1 << 14


def packed(edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """kind, pos, data: the graph as arrays, cut into pieces. edges: src, tgt[, tokens, weight]; vectors: id, vec."""
    names = [c for c in ("tokens", "weight") if c in edges.columns]

    def run(e: pa.Table, v: pa.Table) -> pa.Table:
        src, tgt = e["src"].combine_chunks(), e["tgt"].combine_chunks()
        every = pc.unique(pa.concat_arrays([src.unique(), tgt.unique()]))
        every = every.take(pc.sort_indices(every))
        a, b = (np.asarray(pc.index_in(x, value_set=every), np.int64) for x in (src, tgt))
        key, at = np.unique(np.minimum(a, b) * len(every) + np.maximum(a, b), return_inverse=True)
        out = {"lo": (key // max(len(every), 1)).astype(np.int32), "hi": (key % max(len(every), 1)).astype(np.int32)}
        for c in names:
            x = np.full(len(key), -np.inf)
            np.maximum.at(x, at, np.asarray(e[c].cast(pa.float64()).fill_null(0)))
            out[c] = x.astype(np.int32) if c == "tokens" else x.astype(np.float32) if np.array_equal(x, x.astype(np.float32)) else x
        if v.num_rows:
            v = v.filter(pc.and_(pc.is_valid(v["vec"]), pc.is_in(v["id"], value_set=every)))
            own = v["vec"].combine_chunks()
            out["at"] = np.asarray(pc.index_in(v["id"], value_set=every), np.int32)
            out["vec"] = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64 if pa.types.is_float64(own.type.value_type) else np.float32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("n", every.type)])) as w:
            w.write_table(pa.table({"n": every}))
        parts = {"names": sink.getvalue().to_pybytes()} | {f"{k}:{x.dtype.str}": x.tobytes() for k, x in out.items()}
        rows = [(k, i, x[lo : lo + PIECE]) for k, x in parts.items() for i, lo in enumerate(range(0, max(len(x), 1), PIECE))]
        return pa.table({"kind": [r[0] for r in rows], "pos": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    none = edges.sparkSession.createDataFrame([], "id string, vec array<float>")
    v = (vectors.select("id", "vec") if vectors is not None else none).withColumn("one", F.lit(0))
    e = edges.select("src", "tgt", *names).withColumn("one", F.lit(0))
    return written(e.groupBy("one").cogroup(v.groupBy("one")).applyInArrow(run, "kind string, pos int, data binary"), "packed")


def parcels(edges: DataFrame, most: int = 1 << 18) -> DataFrame:
    """data: the edges src, tgt, ... as coded tables of at most `most` rows, made where they are read, for a task that takes all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> pa.RecordBatch:
            t = pa.Table.from_batches(have).combine_chunks()
            for i, c in enumerate(("src", "tgt")):
                t = t.set_column(i, c, t[c].dictionary_encode())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

        have: list[pa.RecordBatch] = []
        for b in batches:
            have += [b] if b.num_rows else []
            if sum(x.num_rows for x in have) >= most:
                yield put()
                have = []
        if have:
            yield put()

    return edges.select("src", "tgt", *[c for c in edges.columns if c not in ("src", "tgt")]).mapInArrow(run, "data binary")


def unpacked(p: pa.Table, at: Callable[[pa.Array], np.ndarray]) -> list[np.ndarray]:
    """The columns of parcels as arrays, the names as the numbers that `at` gives them."""
    out: list[list[np.ndarray]] = []
    for x in p["data"]:
        t = pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks()
        cols = [t.column(i).chunk(0) for i in range(t.num_columns)] if t.num_rows else []
        out.append([at(c.dictionary)[np.asarray(c.indices)] if pa.types.is_dictionary(c.type) else np.asarray(c) for c in cols])
    return [np.concatenate(c) for c in zip(*filter(None, out), strict=True)]


def in_tasks(pieces: DataFrame, rows: DataFrame, by: str, run: Callable[[Graph, list[dict]], Iterator[tuple]], schema: str, tasks: int | None = None) -> DataFrame:
    """What run makes of the packed graph and each task's part of rows, which are spread by the column `by`."""
    n = tasks or rows.sparkSession.sparkContext.defaultParallelism
    # keys that fall into a partition each; given partitions aren't merged again
    key = {r.p: r.id for r in rows.sparkSession.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect()}
    keys = F.array(*[F.lit(k).cast("bigint") for k in key.values()])
    part = rows.withColumn("task", F.get(keys, F.pmod(F.xxhash64(by), F.lit(len(key))).cast("int"))).repartition(n, "task")
    each = pieces.withColumn("task", F.explode(keys)).repartition(n, "task")
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def go(r: pa.Table, p: pa.Table) -> pa.Table:
        got = list(run(Graph.read(p), r.drop_columns("task").to_pylist())) if r.num_rows and p.num_rows else []
        return pa.Table.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in got], schema=arrow)

    return part.groupBy("task").cogroup(each.groupBy("task")).applyInArrow(go, schema)


class Graph:
    """An undirected graph: the neighbours of node u are near[first[u]:first[u + 1]], in order."""

    def __init__(self, names: list[str], lo: np.ndarray, hi: np.ndarray, tokens: np.ndarray | None = None, weight: np.ndarray | None = None, at: np.ndarray | None = None, vec: np.ndarray | None = None):
        self.names, self.n = names, len(names)
        self.number = {x: i for i, x in enumerate(names)}
        loop = lo == hi
        key = np.concatenate([lo.astype(np.int64) * self.n + hi, hi[~loop].astype(np.int64) * self.n + lo[~loop]])
        order = np.argsort(key)
        key = key[order]
        self.near = (key % max(self.n, 1)).astype(np.int32)
        self.degree = np.bincount(key // max(self.n, 1), minlength=self.n)
        self.first = np.r_[0, np.cumsum(self.degree)]
        both = lambda x: None if x is None else np.concatenate([x, x[~loop]])[order]
        self.tokens, self.weight, self.at, self.vec = both(tokens), both(weight), at, vec
        self.ends = np.bincount(lo, minlength=self.n) + np.bincount(hi, minlength=self.n)  # a loop counts twice
        self.dist = np.full((2, self.n), FAR, np.int64)
        self.mark = np.zeros(self.n, np.int64)
        self.cost = self.low = self.base = None

    @classmethod
    def read(cls, p: pa.Table) -> Graph:
        parts: dict[str, list] = {}
        for k, _, x in sorted(zip(p["kind"].to_pylist(), p["pos"].to_pylist(), p["data"], strict=True), key=lambda r: r[:2]):
            parts.setdefault(k, []).append(x.as_buffer())  # not copied
        names = pa.ipc.open_stream(b"".join(parts.pop("names"))).read_all()["n"].to_pylist()
        arrays = {k.split(":")[0]: np.frombuffer(b"".join(parts.pop(k)), k.split(":")[1]) for k in list(parts)}
        return cls(names, **arrays)

    # ------------------------------------------------------------ costs of a query

    def weigh(self, query: np.ndarray, unit: float, alpha: float, beta: float, gamma: float) -> None:
        """Sets the costs to graph.block_costs with the mean of both ends' unit vectors as an edge's vector, in whole numbers of unit."""
        if self.base is None:
            known = np.zeros(self.n, bool)
            self.unit = np.zeros((self.n, len(query)))
            if self.vec is not None and len(self.at):
                v = self.vec.reshape(len(self.at), -1).astype(np.float64)
                size = np.sqrt((v * v).sum(axis=1, keepdims=True))
                self.unit[self.at], known[self.at] = v / np.where(size > 0, size, 1.0), True
            self.base, self.scale = np.empty(len(self.near)), np.empty(len(self.near))
            top = max((int((np.repeat(self.ends[lo:hi], self.degree[lo:hi]) + self.ends[self.near[a:b]]).max()) for lo, hi, a, b in self._slices()), default=0) or 1
            for lo, hi, a, b in self._slices():
                u, v = np.repeat(np.arange(lo, hi), self.degree[lo:hi]), self.near[a:b]
                own = beta * (self.ends[u] + self.ends[v]) / top + gamma / (1 + self.weight[a:b].astype(np.float64))
                norm = np.sqrt((((self.unit[u] + self.unit[v]) / 2) ** 2).sum(axis=1))
                both = known[u] & known[v]
                self.base[a:b] = np.where(both, alpha + own, 1.0) / unit
                self.scale[a:b] = np.where(both & (norm > 1e-12), alpha / 2 / unit / np.maximum(norm, 1e-12), 0.0)
            self.weight = None
        x = self.unit @ (query / max(np.linalg.norm(query), 1e-300))
        self.cost = np.empty(len(self.near), np.int32)
        for lo, hi, a, b in self._slices():
            c = x[self.near[a:b]]
            c += np.repeat(x[lo:hi], self.degree[lo:hi])
            c *= self.scale[a:b]
            np.subtract(self.base[a:b], c, out=c)
            np.rint(c, out=c)
            self.cost[a:b] = np.minimum(c, 2**31 - 1, out=c)
        self._lowest()

    def _lowest(self) -> None:
        self.low = np.zeros(self.n, np.int64)
        some = self.degree > 0
        if some.any():
            self.low[some] = np.minimum.reduceat(self.cost, self.first[:-1][some])

    def _slices(self) -> Iterator[tuple[int, int, int, int]]:
        """(first and last node, first and last directed edge) of parts of the graph."""
        lo = 0
        while lo < self.n:
            hi = min(max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + SLICE))), self.n)
            if self.first[hi] > self.first[lo]:
                yield lo, hi, int(self.first[lo]), int(self.first[hi])
            lo = hi

    def _once(self, v: np.ndarray) -> np.ndarray:
        """The nodes of v, each once."""
        i = np.arange(len(v))
        self.mark[v] = i
        return v[self.mark[v] == i]

    # ------------------------------------------------------------ searches

    def out(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in front, directed edges) of all that leave the nodes of front."""
        n = self.degree[front]
        at = np.repeat(np.arange(len(front)), n)
        return at, np.arange(len(at)) + np.repeat(self.first[front] - (np.cumsum(n) - n), n)

    def shortest(self, s: int, t: int, cap: int | None = None) -> list[int]:
        """Fewest edges (of cost up to cap), then first in order; empty if there is no path."""
        if s == t:
            return [s]
        seen = self.dist
        front = [np.array([s]), np.array([t])]
        layers = [[front[0]], [front[1]]]
        seen[0, s], seen[1, t] = 0, 0
        try:
            while True:
                side = int(self.degree[front[1]].sum() < self.degree[front[0]].sum())
                _, e = self.out(front[side])
                if cap is not None:
                    e = e[self.cost[e] <= cap]
                v = self.near[e]
                v = self._once(v[seen[side, v] == FAR])
                if not len(v):
                    return []
                seen[side, v] = len(layers[side])
                layers[side].append(v)
                front[side] = v
                met = v[seen[1 - side, v] < FAR]
                if len(met):  # the last layers of both ends: an earlier meeting would have been seen
                    break
            good = [met]  # of the source's layers, those on shortest paths
            for layer in layers[0][-2:0:-1]:
                at, e = self.out(layer)
                ok = np.isin(self.near[e], good[-1])
                if cap is not None:
                    ok &= self.cost[e] <= cap
                good.append(np.unique(layer[at[ok]]))
            path, u = [s], s
            for layer in good[::-1] if len(layers[0]) > 1 else []:
                u = self._next(u, cap, lambda v, x=layer: np.isin(v, x))
                path.append(u)
            while u != t:
                k = seen[1, u]
                u = self._next(u, cap, lambda v, k=k: seen[1, v] == k - 1)
                path.append(u)
            return path
        finally:
            for k in (0, 1):
                for x in layers[k]:
                    seen[k, x] = FAR

    def _next(self, u: int, cap: int | None, ok: Callable[[np.ndarray], np.ndarray]) -> int:
        v = self.near[self.first[u] : self.first[u + 1]]
        good = ok(v)
        if cap is not None:
            good = good & (self.cost[self.first[u] : self.first[u + 1]] <= cap)
        return int(v[int(np.argmax(good))])

    def cheapest(self, s: int, t: int) -> list[int]:
        """Least cost, then fewest edges, then first in order; empty if there is no path."""
        if s == t:
            return [s]
        d = self.dist
        d[0, s], d[1, t] = 0, 0
        front = [np.array([s]), np.array([t])]
        touched = [[front[0]], [front[1]]]
        best = FAR
        try:
            while len(front[0]) and len(front[1]):
                side = int(self.degree[front[1]].sum() < self.degree[front[0]].sum())
                mine, theirs = d[side, front[side]], d[1 - side, front[1 - side]].min()
                if mine.min() + theirs > best:
                    break
                u = front[side]
                u = u[mine + (self.low[u] << HOP) + 1 + theirs <= best]
                at, e = self.out(u)
                v, far = self.near[e], d[side, u][at] + (self.cost[e].astype(np.int64) << HOP) + 1
                ok = (far <= best) & (far < d[side, v])
                v, far = v[ok], far[ok]
                np.minimum.at(d[side], v, far)
                v = self._once(v)
                front[side] = v
                touched[side].append(v)
                if len(v):
                    best = min(best, int((d[0, v] + d[1, v]).min()))
            return self._first_of(s, t, best, self._once(np.concatenate(touched[0]))) if best < FAR else []
        finally:
            for k in (0, 1):
                for x in touched[k]:
                    d[k, x] = FAR

    def _first_of(self, s: int, t: int, best: int, some: np.ndarray) -> list[int]:
        """The first in order of all paths of weight best, from the labels of both ends."""
        d = self.dist
        met = some[d[0, some] + d[1, some] == best].tolist()
        place = {}  # of the nodes on such paths, the weight up to there
        for side in (0, 1):
            todo, done = list(met), set(met)
            while todo:
                x = todo.pop()
                place[x] = int(d[0, x]) if side == 0 else best - int(d[1, x])
                v = self.near[self.first[x] : self.first[x + 1]]
                some = np.flatnonzero(d[side, v] < d[side, x])
                w = (self.cost[self.first[x] + some].astype(np.int64) << HOP) + 1
                for y in v[some][d[side, v[some]] + w == d[side, x]].tolist():
                    if y not in done:
                        done.add(y)
                        todo.append(y)
        path, on = [s], np.array(sorted(place))
        while path[-1] != t:
            u = path[-1]
            v = self.near[self.first[u] : self.first[u + 1]]
            i = np.minimum(np.searchsorted(v, on), len(v) - 1)
            path.append(next(y for y, k, there in zip(on.tolist(), i.tolist(), (v[i] == on).tolist(), strict=True) if there and place[y] == place[u] + (int(self.cost[self.first[u] + k]) << HOP) + 1))
        return path

    def ceilings(self, pairs: list[tuple[int, int]]) -> list[int | None]:
        """For each pair the least cost of the dearest edge on a path between its ends; None without a path."""
        above = np.arange(self.n)

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = int(above[x])
            return x

        out: list[int | None] = [None] * len(pairs)
        at: dict[int, set[int]] = {}  # the open pairs that have an end in a component
        for i, (s, t) in enumerate(pairs):
            at.setdefault(s, set()).add(i)
            at.setdefault(t, set()).add(i)
        left, com, some, low = len(pairs), np.arange(self.n), np.sort(self.cost[::64]), -FAR
        most = 4 * self.n
        while left and low < FAR:  # the cheapest edges first: few are needed
            top = int(some[most // 64]) if most // 64 < len(some) else FAR
            lo, hi, c, com = self._forest(low, top, com)
            for a, b, x in zip(lo.tolist(), hi.tolist(), c.tolist(), strict=True):
                a, b = root(a), root(b)
                p, q = at.pop(a, set()), at.pop(b, set())
                for i in p & q:
                    out[i] = x
                    left -= 1
                above[a] = b
                if p ^ q:
                    at[b] = p ^ q
                if not left:
                    break
            low, most = top, 4 * most
        return out

    def _forest(self, low: int, top: int, com: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A minimum spanning forest of the components com over the edges of cost above low, up to top, cheapest first (Boruvka), and the components
        that it leaves."""
        e = np.flatnonzero((self.cost > low) & (self.cost <= top))
        u, v = np.searchsorted(self.first, e, side="right") - 1, self.near[e].astype(np.int64)
        once = (u < v) & (com[u] != com[v])
        e, u, v = e[once], u[once], v[once]
        rank = (self.cost[e].astype(np.int64) << 31) + np.arange(len(e))  # no two are equal; at most 2^31 edges
        lo, hi, c = [u[:0]], [v[:0]], [e[:0]]
        a, b = com[u], com[v]
        live = np.arange(len(e))
        while len(live):
            low = np.full(self.n, FAR, np.int64)
            np.minimum.at(low, a, rank[live])
            np.minimum.at(low, b, rank[live])
            pick = np.unique(low[low < FAR]) & ((1 << 31) - 1)
            lo.append(u[pick])
            hi.append(v[pick])
            c.append(self.cost[e[pick]].astype(np.int64))
            p, q = com[u[pick]], com[v[pick]]
            name = np.arange(self.n)  # the picked edges' components
            while True:
                m = np.minimum(name[p], name[q])
                before = name.copy()
                np.minimum.at(name, p, m)
                np.minimum.at(name, q, m)
                name = name[name]
                if (name == before).all():
                    break
            com = name[com]
            a, b = com[u[live]], com[v[live]]
            keep = a != b
            live, a, b = live[keep], a[keep], b[keep]
        lo, hi, c = map(np.concatenate, (lo, hi, c))
        order = np.argsort(c, kind="stable")
        return lo[order], hi[order], c[order], com

    def candidates(self, seeds: list[int], rounds: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, directed edges): the `most` cheapest edges of every node that is reached over such edges in fewer than `rounds` steps."""
        seen = np.zeros(self.n, bool)
        front = np.unique(np.array(seeds, np.int64))
        ends, edges, bound = [front[:0]], [front[:0]], self._bounds(most)
        for _ in range(rounds):
            if not len(front):
                break
            seen[front] = True
            at, e = self.out(front)
            some = self.cost[e] <= bound[front][at]
            at, e = at[some], e[some]
            order = np.argsort((at << 32) + self.cost[e], kind="stable")  # neighbours stand in order
            n = np.bincount(at, minlength=len(front))
            rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            kept = order[rank < most]
            ends.append(front[at[kept]])
            edges.append(e[kept])
            front = np.unique(self.near[e[kept]])
            front = front[~seen[front]]
        return np.concatenate(ends), np.concatenate(edges)

    def _bounds(self, most: int) -> np.ndarray:
        """A cost for each node that its `most` cheapest edges don't exceed: the edges of a node of many are cut into parts, whose cheapest count."""
        out = np.full(self.n, np.iinfo(np.int64).max)
        parts = 4 * most
        many = np.flatnonzero(self.degree > parts)
        if len(many):
            # one place more, where the last part of a node ends
            at = (self.first[many][:, None] + np.arange(parts + 1) * self.degree[many][:, None] // parts).ravel()
            low = np.minimum.reduceat(self.cost, np.minimum(at, len(self.cost) - 1)).reshape(len(many), parts + 1)[:, :parts]
            out[many] = np.partition(low, most - 1, axis=1)[:, most - 1]
        return out

    @cached_property
    def back(self) -> np.ndarray:
        """The other direction of each directed edge."""
        return np.argsort(self.near, kind="stable").astype(np.int32)  # a graph of a task has few edges


class Candidates:
    """A query's candidate edges, in both directions: those of node u are places first[u] to first[u + 1], the cheapest first, then in order."""

    def __init__(self, g: Graph, edges: np.ndarray, unit: float):
        mark = np.zeros(len(g.near), bool)
        mark[edges] = mark[g.back[edges]] = True
        e = np.flatnonzero(mark)
        u = np.searchsorted(g.first, e, side="right") - 1
        order = np.argsort((u << 32) + g.cost[e], kind="stable")
        e, self.u = e[order], u[order]
        self.v, self.cost, self.tokens = g.near[e].astype(np.int64), g.cost[e] * unit, g.tokens[e]
        place = np.empty(len(g.near), np.int32)
        place[e] = np.arange(len(e))
        self.back = place[g.back[e]]
        self.n, self.first = g.n, np.r_[0, np.cumsum(np.bincount(self.u, minlength=g.n))]

    def around(self, s: int, t: int, radius: int, most: int) -> Around:
        """The `most` cheapest edges of each node within the radius of s or t that lead to such nodes."""
        inside = np.zeros(self.n, bool)
        front = np.array([s, t])
        inside[front] = True
        for _ in range(radius):
            v = self.v[_ranges(self.first, front)]
            front = np.unique(v[~inside[v]])
            inside[front] = True
        e = _ranges(self.first, np.flatnonzero(inside))
        e = e[inside[self.v[e]]]
        n = np.bincount(self.u[e], minlength=self.n)
        e = e[np.arange(len(e)) - (np.cumsum(n) - n)[self.u[e]] < most]
        mark = np.zeros(len(self.u), bool)
        mark[e] = mark[self.back[e]] = True
        e = np.flatnonzero(mark)
        return Around(self.n, self.u[e], self.v[e], self.cost[e], self.tokens[e])


class Around:
    """The candidate graph of a tree search over arrays, with what paths.TreeSearch asks of a paths.Net. Edges stand in both directions,
    a node's cheapest first."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, cost: np.ndarray, tokens: np.ndarray):
        self.v, self.costs, self.tokens = v, cost, tokens
        degree = np.bincount(u, minlength=n)
        self.first, self.size = np.r_[0, np.cumsum(degree)], int(np.count_nonzero(degree))
        self.near = _Near(self)

    def has(self, u: int) -> bool:
        return bool(self.first[u + 1] > self.first[u])

    def cost(self, u: int, v: int) -> float:
        return self.near[u][v][0]

    def ball(self, centre: int, radius: int) -> dict[int, int]:
        far = np.full(len(self.first) - 1, -1, np.int64)
        front, k = np.array([centre]), 0
        far[front] = 0
        while len(front) and k < radius:
            v, k = self.v[_ranges(self.first, front)], k + 1
            front = np.unique(v[far[v] < 0])
            far[front] = k
        nodes = np.flatnonzero(far >= 0)
        return dict(zip(nodes.tolist(), far[nodes].tolist(), strict=True))

    def cheapest(self, s: int, t: int, far: dict[int, int]) -> list[int]:
        """As paths.Net.cheapest, but what can't be on a path as cheap as one that is known isn't looked at. far: edges to t."""
        if s not in far or not self.has(s):
            return []
        first, v, cost = self.first, self.v, self.costs
        u, most = s, 0.0
        while u != t:  # a path of fewest edges bounds the cost
            e = next(i for i in range(first[u], first[u + 1]) if far[int(v[i])] == far[u] - 1)
            u, most = int(v[e]), most + float(cost[e])
        most = most * (1 + 1e-9) + 1e-9
        least, last = float(cost.min()), float(cost[first[t]]) if s != t else 0.0
        best, came, todo = {s: 0.0}, {s: s}, [(0.0, s)]
        while todo:
            d, u = heapq.heappop(todo)
            if d > best[u]:
                continue
            if u == t:
                break
            a, b = first[u], first[u + 1]
            for x, c in zip(v[a:b].tolist(), cost[a:b].tolist(), strict=True):
                c += d
                if c > most:
                    break
                if x != t and c + last + (far[x] - 1) * least > most:
                    continue
                if c < best.get(x, np.inf):
                    best[x], came[x] = c, u
                    heapq.heappush(todo, (c, x))
        out = [t]
        while out[-1] != s:
            out.append(came[out[-1]])
        return out[::-1]


class _Near(dict):
    """The neighbours of each node with cost and tokens, made when they are first asked for."""

    def __init__(self, of: Around):
        super().__init__()
        self.of = of

    def __missing__(self, u: int) -> dict[int, tuple[float, int]]:
        a, b = self.of.first[u], self.of.first[u + 1]
        self[u] = x = dict(zip(self.of.v[a:b].tolist(), zip(self.of.costs[a:b].tolist(), self.of.tokens[a:b].tolist(), strict=True), strict=True))
        return x


def _ranges(first: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The places first[u] to first[u + 1] of all nodes u."""
    n = first[nodes + 1] - first[nodes]
    return np.arange(n.sum()) + np.repeat(first[nodes] - (np.cumsum(n) - n), n)
