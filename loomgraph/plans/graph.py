"""Queries over graphs and vectors, with their oracle SQL.

Graphs: entity co-occurrence of `documents`, and the part-supplier graph of `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import records as fr
from loomgraph.operators import extract, graph, vectors
from loomgraph.plans.registry import Registry
from loomgraph.plans.text import NAMES
from loomgraph.session import table

R = Registry()

#: Mentions of capitalised names beside the document's dataset as their type.
MENTIONS = f"""(SELECT name AS entity_name, coalesce(dataset, 'none') AS entity_type, coalesce(source, 'none') AS description, doc_id AS source_id, doc_id AS pos FROM {NAMES} JOIN documents USING (doc_id))"""
COOC = f"""(SELECT a.name AS src, b.name AS tgt, count(*)::DOUBLE AS weight FROM {NAMES} a JOIN {NAMES} b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2)"""
PS = """(SELECT 'p' || l_partkey::VARCHAR AS src, 's' || l_suppkey::VARCHAR AS tgt, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)"""
CN = """(SELECT DISTINCT 'n' || c_nationkey::VARCHAR AS src, 's' || c_mktsegment AS tgt FROM customer UNION SELECT DISTINCT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR FROM nation)"""


def mentions(s, d):
    docs = table(s, d, "documents")
    m = extract.regex_entities(docs, "doc_id", "text").select("doc_id", F.col("name").alias("entity_name")).distinct()
    return m.join(docs.select("doc_id", F.coalesce("dataset", F.lit("none")).alias("entity_type"), F.coalesce("source", F.lit("none")).alias("description")), "doc_id").withColumn("source_id", F.col("doc_id").cast("string")).withColumnRenamed("doc_id", "pos")


def cooc(s, d):
    return extract.cooccurrence(extract.regex_entities(table(s, d, "documents"), "doc_id", "text"), "doc_id")


def part_supplier(s, d):
    return table(s, d, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("tgt")).agg(F.sum("l_quantity").alias("weight"))


def nation_graph(s, d):
    c = table(s, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("c_mktsegment")).alias("tgt"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("tgt"))
    return c.union(n).distinct()


R.add("node_merge", f"""WITH m AS {MENTIONS}, k AS (SELECT entity_name, entity_type, count(*) AS n, min(pos) AS f FROM m GROUP BY 1, 2),
  t AS (SELECT entity_name, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, f, entity_type DESC) AS r FROM k) WHERE r = 1)
  SELECT entity_name, entity_type, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, count(DISTINCT source_id) AS n_sources, count(*) AS mentions FROM (SELECT m.entity_name, t.entity_type, description, source_id FROM m JOIN t USING (entity_name)) GROUP BY 1, 2""")(
    lambda s, d: graph.merge_nodes(mentions(s, d)).select("entity_name", "entity_type", "description", F.size("source_ids").cast("bigint").alias("n_sources"), "mentions")
)
R.add("cooccurrence_edges", f"SELECT * FROM {COOC}")(cooc)
R.add("edge_merge", """SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, sum(w) AS weight, min(l_linenumber)::INTEGER AS ord, count(DISTINCT l_returnflag) AS n_descriptions
  FROM (SELECT 'k' || l_partkey::VARCHAR AS src, 'k' || l_suppkey::VARCHAR AS tgt, l_quantity AS w, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1, 2""")(
    lambda s, d: graph.merge_edges(table(s, d, "lineitem").select(F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("src_id"), F.concat(F.lit("k"), F.col("l_suppkey").cast("string")).alias("tgt_id"), F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("description"), F.col("l_orderkey").cast("string").alias("source_id"))).select("src", "tgt", "weight", "ord", F.size(F.split("description", "<SEP>")).cast("bigint").alias("n_descriptions"))
)
R.add("unknown_endpoints", f"""SELECT DISTINCT name AS entity_name FROM (SELECT src AS name FROM {PS} UNION SELECT tgt FROM {PS}) WHERE name NOT IN (SELECT 'p' || p_partkey::VARCHAR FROM part WHERE p_size > 10)""")(
    lambda s, d: graph.with_unknown_nodes(table(s, d, "part").filter("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_name"), F.lit("PART").alias("entity_type")), part_supplier(s, d)).filter("entity_type = 'UNKNOWN'").select("entity_name")
)
R.add("node_degree", f"""SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {PS} UNION ALL SELECT tgt FROM {PS}) GROUP BY 1""")(lambda s, d: graph.degrees(part_supplier(s, d)))
_DEG = f"(SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {PS} UNION ALL SELECT tgt FROM {PS}) GROUP BY 1)"
R.add("edge_degree_rank", f"""SELECT e.src, e.tgt, a.degree + b.degree AS edge_degree FROM {PS} e JOIN {_DEG} a ON a.node = e.src JOIN {_DEG} b ON b.node = e.tgt""")(
    lambda s, d: graph.edge_degrees(part_supplier(s, d)).select("src", "tgt", "edge_degree")
)
R.add("neighbours_of_seeds", f"""SELECT tgt AS seed, src AS neighbour, weight FROM {PS} WHERE tgt IN (SELECT 's' || s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 5 = 0)""")(
    lambda s, d: graph.neighbours(part_supplier(s, d), table(s, d, "supplier").filter("s_suppkey % 5 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")))
)
R.add("induced_subgraph_edges", f"""WITH n AS (SELECT 's' || s_suppkey::VARCHAR AS node FROM supplier WHERE s_acctbal > 0 UNION SELECT 'p' || p_partkey::VARCHAR FROM part WHERE p_size > 25)
  SELECT src, tgt, weight FROM {PS} WHERE src IN (SELECT node FROM n) AND tgt IN (SELECT node FROM n)""")(
    lambda s, d: graph.induced(part_supplier(s, d), table(s, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")).union(table(s, d, "part").filter("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")))))
)
R.add("connected_components", f"""WITH RECURSIVE e AS (SELECT src AS u, tgt AS v FROM {CN} UNION SELECT tgt, src FROM {CN}), r(node, l) AS (SELECT u, u FROM e UNION SELECT e.v, r.l FROM r JOIN e ON e.u = r.node)
  SELECT node, min(l) AS component FROM r GROUP BY 1""")(lambda s, d: graph.components(nation_graph(s, d)))  # fmt: skip
R.add("largest_component", f"""WITH RECURSIVE e AS (SELECT src AS u, tgt AS v FROM {CN} UNION SELECT tgt, src FROM {CN}), r(node, l) AS (SELECT u, u FROM e UNION SELECT e.v, r.l FROM r JOIN e ON e.u = r.node),
  c AS (SELECT node, min(l) AS component FROM r GROUP BY 1) SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)""")(lambda s, d: graph.largest_component(nation_graph(s, d)))  # fmt: skip
R.add("component_sizes_documents")(lambda s, d: graph.components(cooc(s, d)).groupBy("component").agg(F.count("*").alias("size")))
R.add("bfs_hops", f"""WITH RECURSIVE e AS (SELECT src AS u, tgt AS v FROM {CN} UNION SELECT tgt, src FROM {CN}), r(origin, node, h) AS (SELECT u, u, 0 FROM e WHERE u LIKE 'r%' UNION SELECT r.origin, e.v, r.h + 1 FROM r JOIN e ON e.u = r.node WHERE r.h < 3)
  SELECT origin, node, min(h)::INTEGER AS hops FROM r GROUP BY 1, 2""")(lambda s, d: graph.hops(nation_graph(s, d), nation_graph(s, d).filter("tgt LIKE 'r%'").select(F.col("tgt").alias("node")), 3))  # fmt: skip
R.add("triangles_transitivity", f"""WITH e AS (SELECT src, tgt FROM {COOC}), t AS (SELECT count(*) AS triangles FROM e a JOIN e b ON a.tgt = b.src JOIN e c ON c.src = a.src AND c.tgt = b.tgt),
  g AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT tgt FROM e) GROUP BY 1), x AS (SELECT count(*) AS nodes, (sum(k) / 2)::BIGINT AS edges, sum(k * (k - 1) / 2)::BIGINT AS triads FROM g)
  SELECT nodes, edges, triangles, triads, round(3 * triangles / triads, 9) AS transitivity, round(1 - edges / (nodes * (nodes - 1) / 2), 9) AS sparsity FROM x, t""")(lambda s, d: graph.triangle_stats(cooc(s, d)))  # fmt: skip

_BRAND = """(SELECT 0 AS level, p_brand AS community, p_partkey AS node FROM part UNION SELECT 1, p_brand || '/' || p_type, p_partkey FROM part UNION SELECT 1, p_type, p_partkey FROM part)"""


def brands(s, d):
    p = table(s, d, "part")
    kinds = F.array(F.struct(F.lit(0).alias("level"), F.col("p_brand").alias("community")), F.struct(F.lit(1).alias("level"), F.concat("p_brand", F.lit("/"), "p_type").alias("community")), F.struct(F.lit(1).alias("level"), F.col("p_type").alias("community")))
    return p.select(F.explode(kinds).alias("k"), F.col("p_partkey").alias("node")).select("k.level", "k.community", "node").distinct()


R.add("community_schema", f"""WITH m AS (SELECT b.level, b.community, 'p' || b.node::VARCHAR AS node, l_orderkey AS chunk_id FROM {_BRAND} b JOIN lineitem ON l_partkey = b.node), e AS {PS},
  x AS (SELECT level, community, count(DISTINCT node) AS n_nodes, count(DISTINCT chunk_id) AS n_chunks FROM m GROUP BY 1, 2),
  y AS (SELECT level, community, count(*) AS n_edges FROM (SELECT DISTINCT m.level, m.community, e.src, e.tgt FROM (SELECT DISTINCT level, community, node FROM m) m JOIN e ON e.src = m.node OR e.tgt = m.node) GROUP BY 1, 2)
  SELECT level, community, n_nodes, coalesce(n_edges, 0) AS n_edges, n_chunks, round(n_chunks / (SELECT max(n_chunks) FROM x), 9) AS occurrence FROM x LEFT JOIN y USING (level, community)""")(
    lambda s, d: graph.community_schema(brands(s, d).join(table(s, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("chunk_id")), "node").withColumn("node", F.concat(F.lit("p"), F.col("node").cast("string"))), part_supplier(s, d))
)
R.add("sub_communities", f"""WITH m AS {_BRAND}, z AS (SELECT community, count(*) AS size FROM m WHERE level = 1 GROUP BY 1)
  SELECT 0 AS level, p.community AS parent, c.community AS child FROM m p JOIN m c ON c.node = p.node AND p.level = 0 AND c.level = 1 JOIN z ON z.community = c.community GROUP BY 2, 3 HAVING count(*) = any_value(size)""")(
    lambda s, d: graph.sub_communities(brands(s, d))
)
_NORM = lambda g, k, t: f"(SELECT {g}, CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0.0 END AS entropy, count(*) AS kinds FROM (SELECT {g}, {k}, count(*) AS n FROM {t} GROUP BY 1, 2) GROUP BY 1)"
R.add("normalized_entropy", f"SELECT source, round(entropy, 9) AS entropy, kinds FROM {_NORM('source', 'lang', 'documents')}")(
    lambda s, d: graph.normalized_entropy(table(s, d, "documents"), ["source"], "lang").withColumn("entropy", F.round("entropy", 9))
)
R.add("community_balance", f"""WITH m AS (SELECT p_brand AS community, 'p' || p_partkey::VARCHAR AS node, p_type AS kind FROM part), n AS (SELECT community, count(*) AS n_nodes FROM m GROUP BY 1),
  g AS (SELECT DISTINCT a.name AS src, b.name AS tgt FROM (SELECT 'p' || l_partkey::VARCHAR AS name, l_orderkey FROM lineitem) a JOIN (SELECT 'p' || l_partkey::VARCHAR AS name, l_orderkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.name < b.name),
  e AS (SELECT x.community, count(*) AS n_edges FROM g JOIN m x ON x.node = g.src JOIN m y ON y.node = g.tgt AND y.community = x.community GROUP BY 1)
  SELECT community, n_nodes, coalesce(n_edges, 0) AS n_edges, CASE WHEN n_nodes > 1 THEN round(2 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)), 9) ELSE 0.0 END AS density, round(entropy, 9) AS entropy, n_nodes > 80 OR entropy >= 0.99 AS should_split
  FROM n LEFT JOIN e USING (community) JOIN {_NORM('community', 'kind', 'm')} USING (community)""")(
    lambda s, d: graph.balance(table(s, d, "part").select(F.col("p_brand").alias("community"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_type").alias("kind")), extract.cooccurrence(table(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name")), "l_orderkey"), 80, 0.99)
)

_QV = "(SELECT vec_id AS query_id, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id % 100 = 0)"


def _queries(s, d):
    return table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


R.add("vector_topk_batch", f"""SELECT query_id, vec_id, round(score, 6) AS score, r - 1 AS dense_order FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r
  FROM (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], qvec) AS score FROM embeddings, {_QV}) WHERE score >= 0.2) WHERE r <= 20""")(
    lambda s, d: vectors.topk(table(s, d, "embeddings"), _queries(s, d), 20).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("dense_order").cast("bigint").alias("dense_order"))
)
R.add("vector_threshold_counts", f"""SELECT query_id, count(*) AS hits FROM (SELECT query_id, list_cosine_similarity(embedding::DOUBLE[], qvec) AS score FROM embeddings, {_QV}) WHERE score >= 0.2 GROUP BY 1""")(
    lambda s, d: table(s, d, "embeddings").join(F.broadcast(_queries(s, d))).filter(fr.cosine(F.col("embedding"), F.col("qvec")) >= 0.2).groupBy("query_id").agg(F.count("*").alias("hits"))
)
R.add("top_m_per_community", f"""WITH h AS (SELECT query_id, e.vec_id, e.label, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], qvec) DESC, e.vec_id) AS r FROM embeddings e, {_QV} WHERE list_cosine_similarity(embedding::DOUBLE[], qvec) >= 0.2)
  SELECT query_id, label AS community, vec_id, m FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY r) AS m FROM h WHERE r <= 200) WHERE m <= 3""")(
    lambda s, d: extract_top_m(s, d)
)


def extract_top_m(s, d):
    from pyspark.sql.window import Window

    hits = vectors.topk(table(s, d, "embeddings"), _queries(s, d), 200).join(table(s, d, "embeddings").select("vec_id", F.col("label").alias("community")), "vec_id")
    w = Window.partitionBy("query_id", "community").orderBy("dense_order")
    return hits.withColumn("m", F.row_number().over(w).cast("bigint")).filter("m <= 3").select("query_id", "community", "vec_id", "m")


R.add("edge_cost", f"""WITH e AS (SELECT src, tgt, weight FROM {PS}), g AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT tgt FROM e) GROUP BY 1),
  x AS (SELECT e.*, a.k + b.k AS ed FROM e JOIN g a ON a.node = e.src JOIN g b ON b.node = e.tgt), n AS (SELECT count(*) AS c FROM embeddings)
  SELECT query_id, src, tgt, round(1.0 * (1 - list_cosine_similarity(embedding::DOUBLE[], qvec)) + 0.15 * ed / (SELECT max(ed) FROM x) + 0.05 / (1 + weight), 6) AS cost
  FROM x, n, (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id % 100 = 0) JOIN embeddings v ON v.vec_id = substr(src, 2)::BIGINT % n.c""")(
    lambda s, d: edge_cost_query(s, d, _queries(s, d))
)


def edge_cost_query(s, d, q):
    e = part_supplier(s, d)
    v = table(s, d, "embeddings")
    n = v.agg(F.count("*").alias("c"))
    vec = e.select("src", "tgt").join(F.broadcast(n)).withColumn("vec_id", F.substring("src", 2, 20).cast("bigint") % F.col("c")).join(v, "vec_id").select("src", "tgt", F.col("embedding").alias("vec"))
    return graph.edge_costs(e, vec, q).withColumn("cost", F.round("cost", 6))


R.add("maxsim_rerank", f"""WITH q AS (SELECT label AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT vec_id // 10 AS doc, embedding::DOUBLE[] AS v FROM embeddings),
  b AS (SELECT query_id, doc, q.v AS qv, max(list_cosine_similarity(q.v, d.v)) AS m FROM q, d GROUP BY 1, 2, 3) SELECT query_id::BIGINT AS query_id, doc, round(sum(m), 6) AS rerank_score FROM b GROUP BY 1, 2""")(
    lambda s, d: vectors.maxsim(table(s, d, "embeddings").filter("vec_id % 100 = 0").groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.collect_list("embedding").alias("qt")).join(table(s, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("doc")).agg(F.collect_list("embedding").alias("dt")), how="cross"), "qt", "dt").select("query_id", "doc", F.round("rerank_score", 6).alias("rerank_score"))
)


def embedded(src: str, dims: int = 64) -> str:
    """SQL: key, dim, x of (key, t): signed counts of words and pairs of words by hash."""
    h = "('0x' || substr(md5(g), 1, 8))::BIGINT"
    return f"""(SELECT key, {h} % {dims} AS dim, sum(CASE WHEN ({h} >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS x FROM (SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g
      FROM (SELECT key, regexp_extract_all(lower(t), '[\\pL\\pN]+') AS w FROM {src})) GROUP BY 1, 2)"""


R.add("hashed_embeddings", f"SELECT key AS context_id, dim::INTEGER AS dim, x::INTEGER AS x FROM {embedded('(SELECT context_id AS key, context AS t FROM unique_contexts WHERE context IS NOT NULL)')} WHERE x <> 0")(
    lambda s, d: vectors.embed(table(s, d, "unique_contexts"), "context_id", "context").select("context_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("int")).filter("x <> 0")
)
