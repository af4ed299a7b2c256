"""The undirected knowledge graph: merging mentions, degrees, components, triangles, communities' tables, edge costs.

Edges are stored once with src <= tgt; `both_ways` gives the symmetric view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut


def merge_nodes(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """entity_name, entity_type (most frequent; ties: first seen), description (sorted distinct, joined), source_ids, mentions.

    mentions: entity_name, entity_type, description, source_id, pos. An existing node counts as one more mention, seen first."""
    m = mentions.select("entity_name", "entity_type", "description", "source_id", F.col("pos").cast("bigint").alias("pos"))
    if existing is not None:
        m = m.unionByName(existing.select("entity_name", "entity_type", "description", F.explode_outer("source_ids").alias("source_id"), F.lit(-1).cast("bigint").alias("pos")).dropDuplicates(["entity_name"]))
    kinds = m.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    kind = kinds.groupBy("entity_name").agg(F.max_by("entity_type", F.struct("n", -F.col("first"), "entity_type")).alias("entity_type"))
    rest = m.groupBy("entity_name").agg(F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count("*").alias("mentions"))
    return rest.join(kind, "entity_name")


def merge_nodes_in_order(mentions: DataFrame) -> DataFrame:
    """entity_name, entity_type (most frequent, then first seen), description and source_id: distinct values joined in order of first sight."""
    kinds = mentions.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"), F.min("pos").alias("first")).groupBy("entity_name").agg(F.max_by("entity_type", F.struct("n", -F.col("first"))).alias("entity_type"))

    def parts(c: str) -> DataFrame:  # one row a distinct value, so that repeats are never collected
        x = mentions.filter(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").groupBy("entity_name", F.col(c).cast("string").alias("v")).agg(F.min("pos").alias("first"))
        return x.groupBy("entity_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda p: p["v"]), "<SEP>").alias(c))

    return kinds.join(parts("description"), "entity_name", "left").join(parts("source_id"), "entity_name", "left")


def identity(edges: DataFrame) -> DataFrame:
    """One row: edges, identity (the same for equal edge sets, whatever their order): sums of two hashes of each edge, hashed."""
    e = edges.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    part = lambda at: F.sum(F.conv(F.substring(F.md5(F.concat_ws("\x1f", "a", "b")), at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return e.agg(F.count("*").alias("edges"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), part(1), part(13)), 256).alias("identity"))


def below(subs: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """root_level, root, level, community: the communities up to `depth` levels below each root (itself included). subs: see sub_communities;
    roots: level, community."""
    front = roots.select(F.col("level").alias("root_level"), F.col("community").alias("root"), "level", "community").distinct()
    out = front
    for _ in range(depth):
        front = front.join(subs.select("level", F.col("parent").alias("community"), "child"), ["level", "community"]).select("root_level", "root", (F.col("level") + 1).alias("level"), F.col("child").alias("community")).distinct()
        out = out.unionByName(front)
    return out.distinct()


def merge_edges(mentions: DataFrame, zero_is_one: bool = False) -> DataFrame:
    """src <= tgt, weight (sum), ord (least), description (sorted distinct, joined), source_ids."""
    w = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0)) if zero_is_one else F.coalesce("weight", F.lit(0.0))
    o = F.coalesce(F.col("ord"), F.lit(1)) if "ord" in mentions.columns else F.lit(1)
    return (
        mentions.filter("src_id IS NOT NULL AND tgt_id IS NOT NULL")
        .groupBy(F.least("src_id", "tgt_id").alias("src"), F.greatest("src_id", "tgt_id").alias("tgt"))
        .agg(F.sum(w).alias("weight"), F.min(o).alias("ord"), F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    )


def with_unknown_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and an UNKNOWN node for each endpoint that has none."""
    ends = edges.select(F.col("src").alias("entity_name")).union(edges.select("tgt")).distinct()
    lost = ends.join(nodes, "entity_name", "left_anti").withColumn("entity_type", F.lit("UNKNOWN"))
    return nodes.unionByName(lost, allowMissingColumns=True)


def both_ways(edges: DataFrame) -> DataFrame:
    """u, v and the other columns; a self loop stands once."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    return edges.select(F.col("src").alias("u"), F.col("tgt").alias("v"), *rest).unionByName(edges.filter("src <> tgt").select(F.col("tgt").alias("u"), F.col("src").alias("v"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree; a self loop counts twice."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("tgt"), F.col("degree").alias("dt")), "tgt").withColumn("edge_degree", F.col("ds") + F.col("dt")).drop("ds", "dt")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, neighbour and the edge's columns, for seeds(node)."""
    return both_ways(edges).join(seeds.select(F.col("node").alias("u")).distinct(), "u", "left_semi").withColumnsRenamed({"u": "seed", "v": "neighbour"})


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among nodes(node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "tgt"), "tgt", "left_semi")


def edge_costs(edges: DataFrame, vectors: DataFrame, query: DataFrame, alpha: float = 1.0, beta: float = 0.15, gamma: float = 0.05, block: int = 64) -> DataFrame:
    """query_id, src, tgt, cost = alpha (1 - cos) + beta hub + gamma / (1 + weight), hub = edge degree / greatest edge degree.

    edges: src, tgt, weight; vectors: src, tgt, vec; query: query_id, qvec. A stated set of queries against all edges, in blocks."""
    out, ids = None, query.select("query_id", "qvec").orderBy("query_id").collect()
    kind = query.schema["query_id"].dataType.simpleString()
    spark = edges.sparkSession
    e = edges.select("src", "tgt").distinct()
    for lo in range(0, max(len(ids), 1), block):
        part = [(i, r.query_id, [float(x) for x in r.qvec]) for i, r in enumerate(ids[lo : lo + block])]
        q = spark.createDataFrame(part, f"q int, query_id {kind}, qvec array<double>")
        c = block_costs(e, edges, vectors, q, None, alpha, beta, gamma).select("src", "tgt", F.posexplode("costs").alias("q", "cost")) if part else e.select("src", "tgt", F.lit(0).alias("q"), F.lit(0).alias("cost")).limit(0)
        one = c.join(F.broadcast(q.select("q", "query_id")), "q").select("query_id", "src", "tgt", F.col("cost").cast("double").alias("cost"))  # at most `block` rows
        out = one if out is None else out.unionByName(one)
    return out


def block_costs(edges: DataFrame, weights: DataFrame, vectors: DataFrame, queries: DataFrame, unit: float | None, alpha: float = 1.0, beta: float = 0.15, gamma: float = 0.05) -> DataFrame:
    """edges with costs: the array, by the query's number q, of edge_costs, in whole numbers of `unit` if it is given. queries: q, qvec, a block of some
    dozens; each Arrow batch of edge vectors is one matrix product. An edge without a vector costs 1."""
    rows = sorted(queries.select("q", "qvec").collect())
    mat = np.array([r.qvec for r in rows], np.float64)
    mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)
    e = edge_degrees(weights.select("src", "tgt", "weight"))
    top = e.agg(F.max("edge_degree")).first()[0] or 1
    x = edges.join(e.select("src", "tgt", (beta * F.col("edge_degree") / top + gamma / (1 + F.col("weight"))).alias("own")), ["src", "tgt"], "left").join(vectors.select("src", "tgt", F.col("vec").cast("array<double>").alias("vec")), ["src", "tgt"], "left")
    names = [c for c in edges.columns if c not in ("src", "tgt")]
    x = x.select("src", "tgt", *names, "own", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, vec = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            known = np.asarray(own.is_valid()) & np.asarray(vec.is_valid())
            cost = np.ones((b.num_rows, len(mat)))
            if known.any():
                v = np.asarray(vec.filter(pa.array(known)).flatten(), np.float64).reshape(int(known.sum()), -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                cost[known] = alpha * (1 - v @ mat.T) + np.asarray(own.filter(pa.array(known)))[:, None]
            out = pa.array(list(np.minimum(np.rint(cost / unit), 2**31 - 1).astype(np.int32)) if unit else list(cost), pa.list_(pa.int32() if unit else pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], out], names=[*b.schema.names[:-2], "costs"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.drop("own", "vec").schema)
    return x.mapInArrow(run, f"{kept}, costs array<{'int' if unit else 'double'}>")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node). Each round spreads the least label to neighbours and then jumps to that label's own
    label, so long paths need a logarithmic number of rounds."""
    sym = cut(both_ways(edges).select("u", "v").distinct())
    lab = cut(sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).withColumnRenamed("u", "node"))
    while True:
        near = sym.join(lab.select(F.col("node").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m")).withColumnRenamed("u", "node")
        step = lab.join(near, "node").select("node", "l", F.least("l", "m").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        nxt = cut(step.join(jump, "new", "left").select("node", "l", F.least("new", F.coalesce("far", "new")).alias("new")))
        moved = nxt.filter("l <> new").limit(1).count()
        lab = nxt.select("node", F.col("new").alias("l"))
        if not moved:
            break
    return lab.withColumnRenamed("l", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    c = cut(components(edges))
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return c.join(F.broadcast(top), "component", "left_semi").select("node")  # one row


def oriented(edges: DataFrame) -> DataFrame:
    """a -> b from the end of lower degree to that of higher degree, so that out-degrees stay small even at a hub."""
    e = edges.filter("src <> tgt").select("src", "tgt").distinct()
    d = degrees(e)
    x = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("tgt"), F.col("degree").alias("dt")), "tgt")
    up = F.struct("ds", "src") < F.struct("dt", "tgt")
    return x.select(F.when(up, F.col("src")).otherwise(F.col("tgt")).alias("a"), F.when(up, F.col("tgt")).otherwise(F.col("src")).alias("b"))


def triangle_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, triangles, triads, transitivity, sparsity."""
    e = edges.filter("src <> tgt").select("src", "tgt").distinct()
    o = oriented(e)
    wedge = o.select("a", F.col("b").alias("p")).join(o.select("a", F.col("b").alias("q")), "a").filter("p < q")
    tri = wedge.join(e.select(F.col("src").alias("p"), F.col("tgt").alias("q")), ["p", "q"], "left_semi").agg(F.count("*").alias("triangles"))
    d = degrees(e).agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).cast("bigint").alias("triads"))
    n = F.col("nodes")
    return d.join(F.broadcast(tri)).select("nodes", "edges", "triangles", "triads", F.when(F.col("triads") > 0, F.round(3 * F.col("triangles") / F.col("triads"), 9)).otherwise(0.0).alias("transitivity"), F.when(n > 1, F.round(1 - F.col("edges") / (n * (n - 1) / 2), 9)).alias("sparsity"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """origin, node, hops: breadth-first distances up to depth from seeds(node[, origin]); seeds of one origin spread together. Each
    level joins only the last frontier, and what was visited is taken out by an anti-join."""
    sym = both_ways(edges).select("u", "v").distinct()
    seen = cut(seeds.select(F.col("origin" if "origin" in seeds.columns else "node").alias("origin"), "node", F.lit(0).alias("hops")).distinct())
    front = seen
    for k in range(1, depth + 1):
        nxt = front.select("origin", F.col("node").alias("u")).join(sym, "u").select("origin", F.col("v").alias("node")).distinct()
        front = cut(nxt.join(seen, ["origin", "node"], "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def community_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """level, community, n_nodes, n_edges (all incident ones), n_chunks, occurrence.

    nodes: node, level, community, chunk_id (a row for each membership and citing chunk); edges: src, tgt."""
    base = nodes.groupBy("level", "community").agg(F.count_distinct("node").alias("n_nodes"), F.count_distinct("chunk_id").alias("n_chunks"))
    member = nodes.select("level", "community", "node").distinct()
    inc = edges.select("src", "tgt", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("node")).join(member, "node").select("level", "community", "src", "tgt").distinct()
    cnt = inc.groupBy("level", "community").agg(F.count("*").alias("n_edges"))
    out = base.join(cnt, ["level", "community"], "left").fillna(0, ["n_edges"])
    top = out.agg(F.max("n_chunks").alias("top"))
    return out.join(F.broadcast(top)).select("level", "community", "n_nodes", "n_edges", "n_chunks", F.round(F.col("n_chunks") / F.col("top"), 9).alias("occurrence"))  # one row


def sub_communities(members: DataFrame) -> DataFrame:
    """parent, child: communities of the next level whose nodes all lie in the parent (relational division).
    members: level, community, node."""
    m = members.select("level", "community", "node").distinct()
    size = m.groupBy("level", "community").agg(F.count("*").alias("size"))
    up = m.select(F.col("level").alias("pl"), F.col("community").alias("parent"), "node")
    down = m.select((F.col("level") - 1).alias("pl"), F.col("community").alias("child"), "node")
    both = down.join(up, ["pl", "node"]).groupBy("pl", "parent", "child").agg(F.count("*").alias("n"))
    return both.join(size.select((F.col("level") - 1).alias("pl"), F.col("community").alias("child"), "size"), ["pl", "child"]).filter("n = size").select(F.col("pl").alias("level"), "parent", "child")


def balance(members: DataFrame, edges: DataFrame, max_nodes: int, entropy_at: float) -> DataFrame:
    """community, nodes, edges inside, density, normalized type entropy, should_split. members: community, node, kind."""
    m = members.select("community", "node", "kind").dropDuplicates(["community", "node"])
    ent = normalized_entropy(m, ["community"], "kind")
    n = m.groupBy("community").agg(F.count("*").alias("n_nodes"))
    x = m.select("community", F.col("node").alias("src")).join(edges.filter("src <> tgt").select("src", "tgt").distinct(), "src")
    e = x.join(m.select("community", F.col("node").alias("tgt")), ["community", "tgt"], "left_semi").groupBy("community").agg(F.count("*").alias("n_edges"))
    k = F.col("n_nodes")
    out = n.join(e, "community", "left").fillna(0, ["n_edges"]).join(ent, "community")
    return out.select("community", "n_nodes", "n_edges", F.when(k > 1, F.round(2 * F.col("n_edges") / (k * (k - 1)), 9)).otherwise(0.0).alias("density"), F.round("entropy", 9).alias("entropy"), ((k > max_nodes) | (F.col("entropy") >= entropy_at)).alias("should_split"))


def normalized_entropy(df: DataFrame, group: list[str], kind: str) -> DataFrame:
    """-sum p ln p / ln k by group, 0 for a single kind."""
    c = df.groupBy(*group, kind).agg(F.count("*").alias("n"))
    g = c.groupBy(*group).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("s"), F.count("*").alias("k"))
    h = (F.ln(F.col("t").cast("double")) - F.col("s") / F.col("t")) / F.ln(F.col("k").cast("double"))
    return g.select(*group, F.when(F.col("k") > 1, h).otherwise(0.0).alias("entropy"), F.col("k").alias("kinds"))
