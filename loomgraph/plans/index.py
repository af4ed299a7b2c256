"""Queries of merges in order, summaries of clusters, the model-free pipeline, edge requests and record texts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import records as fr
from loomgraph.operators import evaluate, extract, graph, scaffold, summaries, vectors
from loomgraph.plans.graph import _BRAND, CN, COOC, MENTIONS, PS, brands, cooc, mentions, nation_graph, part_supplier
from loomgraph.plans.registry import Registry
from loomgraph.plans.text import NAMES, STOP, WORDS
from loomgraph.session import cut, table, written
from loomgraph.sources import files, stores

R = Registry()
_parts = lambda c: f"(SELECT entity_name, string_agg(v, '<SEP>' ORDER BY f, v) AS {c} FROM (SELECT entity_name, {c}::VARCHAR AS v, min(pos) AS f FROM m WHERE trim({c}::VARCHAR) <> '' GROUP BY 1, 2) GROUP BY 1)"
R.add("node_merge_in_order", f"""WITH m AS {MENTIONS}, k AS (SELECT entity_name, entity_type, count(*) AS n, min(pos) AS f FROM m GROUP BY 1, 2),
  t AS (SELECT entity_name, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, f) AS r FROM k) WHERE r = 1)
  SELECT entity_name, entity_type, description, md5(source_id) AS sources FROM t LEFT JOIN {_parts('description')} USING (entity_name) LEFT JOIN {_parts('source_id')} USING (entity_name)""")(
    lambda s, d: graph.merge_nodes_in_order(mentions(s, d)).select("entity_name", "entity_type", "description", F.md5("source_id").alias("sources"))
)
R.add("base_graph_summary", f"""WITH m AS {MENTIONS}, n AS (SELECT DISTINCT entity_name FROM m WHERE source_id % 2 = 0), e AS {COOC}, u AS (SELECT src AS x FROM e UNION SELECT tgt FROM e)
  SELECT (SELECT count(*) FROM m WHERE source_id % 2 = 0) AS entity_records, (SELECT count(*) FROM e) AS relation_records, (SELECT count(*) FROM (SELECT entity_name FROM n UNION SELECT x FROM u)) AS nodes, (SELECT count(*) FROM e) AS edges,
    (SELECT count(*) FROM u WHERE x NOT IN (SELECT entity_name FROM n)) AS unknown_nodes""")(lambda s, d: _base(s, d))


def _base(s, d):
    """Of the entity records, those of even documents; so some endpoints of relations have no node."""
    m, e = mentions(s, d).filter("pos % 2 = 0"), cooc(s, d)
    n = graph.with_unknown_nodes(m.select("entity_name").distinct().withColumn("entity_type", F.lit("KNOWN")), e)
    return evaluate.graph_summary(m, e, n, e)


_IDENT = f"(SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM {PS})"
R.add("graph_identity", f"""SELECT n AS edges, sha256(n::VARCHAR || '|' || x || '|' || y) AS identity FROM (SELECT count(*) AS n, sum(('0x' || substr(md5(a || chr(31) || b), 1, 12))::BIGINT::HUGEINT)::VARCHAR AS x, sum(('0x' || substr(md5(a || chr(31) || b), 13, 12))::BIGINT::HUGEINT)::VARCHAR AS y FROM {_IDENT})""")(
    lambda s, d: graph.identity(part_supplier(s, d))
)
_SUBS = f"(WITH m AS {_BRAND}, z AS (SELECT community, count(*) AS size FROM m WHERE level = 1 GROUP BY 1) SELECT p.community AS parent, c.community AS child FROM m p JOIN m c ON c.node = p.node AND p.level = 0 AND c.level = 1 JOIN z ON z.community = c.community GROUP BY 1, 2 HAVING count(*) = any_value(size))"
R.add("communities_below", f"""WITH r AS (SELECT DISTINCT community FROM {_BRAND} WHERE level = 0) SELECT 0 AS root_level, community AS root, 0 AS level, community FROM r UNION SELECT 0, parent, 1, child FROM {_SUBS}""")(
    lambda s, d: graph.below(graph.sub_communities(brands(s, d)), brands(s, d).filter("level = 0"))
)
R.add("export_counts", f"""WITH e AS {PS}, n AS (SELECT src AS x FROM e UNION SELECT tgt FROM e), b AS {_BRAND}, m AS (SELECT level, community, node FROM (SELECT level, community, 'p' || node::VARCHAR AS node FROM b) WHERE node IN (SELECT x FROM n))
  SELECT 'node' AS part, 'Entity' AS kind, (SELECT count(*) FROM n) AS n UNION ALL SELECT 'node', 'Community', (SELECT count(*) FROM (SELECT DISTINCT level, community FROM m)) UNION ALL SELECT 'edge', 'RELATES_TO', (SELECT count(*) FROM e)
  UNION ALL SELECT 'edge', 'IN_COMMUNITY', (SELECT count(*) FROM m) UNION ALL SELECT 'edge', 'HAS_SUBCOMMUNITY', (SELECT count(*) FROM {_SUBS})""")(lambda s, d: _exported(s, d))


def _exported(s, d):
    e = part_supplier(s, d)
    n = e.select(F.explode(F.array("src", "tgt")).alias("entity_name")).distinct()
    m = brands(s, d).withColumn("node", F.concat(F.lit("p"), F.col("node").cast("string")))
    return evaluate.kind_counts(*files.property_graph(n, e, m, graph.sub_communities(brands(s, d))))


# ---------------------------------------------------------------- summaries of clusters

_CL = "(SELECT 0 AS level, source AS cluster, name AS node FROM (SELECT DISTINCT lower(trim(source)) AS source, name FROM documents JOIN {n} USING (doc_id) WHERE source IS NOT NULL))".format(n=NAMES)
_NODES = f"(SELECT name AS entity_name, 'Named in ' || count(*)::VARCHAR || ' documents of the corpus.' AS description FROM {NAMES} GROUP BY 1)"


def _clusters(s, d, m=None):
    m = (m or mentions(s, d)).select(F.col("entity_name").alias("node"), F.col("pos").alias("doc_id"))
    src = table(s, d, "documents").filter("source IS NOT NULL").select("doc_id", F.lower(F.trim("source")).alias("cluster"))
    return m.join(src, "doc_id").select(F.lit(0).alias("level"), "cluster", "node").distinct()


def _nodes(s, d):
    return mentions(s, d).groupBy("entity_name").agg(F.concat(F.lit("Named in "), F.count("*").cast("string"), F.lit(" documents of the corpus.")).alias("description"))


R.add("cluster_nodes", f"SELECT DISTINCT level, cluster, node FROM {_CL}")(lambda s, d: summaries.cluster_nodes(_clusters(s, d).groupBy(F.col("node").alias("entity_name")).agg(F.to_json(F.collect_list(F.struct("level", "cluster"))).alias("clusters"))))
_LINE = f"(SELECT level, cluster, node, '(' || node || ', ' || description || ')' AS line FROM {_CL} JOIN {_NODES} ON entity_name = node)"
R.add("cluster_prompts", f"""SELECT level, cluster, count(*) AS n_described, md5(string_agg(line, ',' ORDER BY node)) AS text FROM (SELECT *, sum(t) OVER (PARTITION BY level, cluster ORDER BY node) AS s FROM (SELECT *, len({WORDS('line')}) AS t FROM {_LINE})) WHERE s <= 500 GROUP BY 1, 2""")(
    lambda s, d: summaries.prompt_rows(_clusters(s, d), _nodes(s, d), 500).withColumn("text", F.md5("text"))
)
R.add("cluster_sampling", f"""WITH RECURSIVE m AS (SELECT level, cluster, node, len({WORDS('line')}) AS t FROM {_LINE}), x AS (SELECT *, row_number() OVER w AS n, sum(t) OVER w AS s FROM m WINDOW w AS (PARTITION BY level, cluster ORDER BY md5('0|' || node), node)),
  z(level, cluster, size, i, n) AS (SELECT level, cluster, count(*), 0, count(*) FROM m GROUP BY 1, 2 UNION ALL SELECT level, cluster, size, i + 1, greatest(1, floor(size * 0.8::DOUBLE ** (i + 1) + 1e-9)::BIGINT) FROM z WHERE n > 1),
  f AS (SELECT z.level, z.cluster, max(CASE WHEN x.s <= 2000 THEN z.n END) AS most FROM z JOIN x ON z.level = x.level AND z.cluster = x.cluster AND z.n = x.n GROUP BY 1, 2)
  SELECT x.level, x.cluster, x.node, t AS tokens FROM x JOIN f USING (level, cluster) WHERE n <= coalesce(most, 1)""")(
    lambda s, d: summaries.within_tokens(_clusters(s, d).join(_nodes(s, d), F.col("node") == F.col("entity_name")).select("level", "cluster", "node", fr.n_tokens(F.concat(F.lit("("), "node", F.lit(", "), "description", F.lit(")"))).alias("tokens")), 2000)
)
_SUM = f"""f AS (SELECT level, cluster, list(node ORDER BY node) AS names FROM (SELECT *, row_number() OVER (PARTITION BY level, cluster ORDER BY node) AS n FROM {_CL}) WHERE n <= 6 GROUP BY 1, 2 HAVING count(*) > 1),
  se AS (SELECT level, cluster, 'L' || level::VARCHAR || '_C' || cluster || '_' || upper(array_to_string(list_transform(names[1:3], lambda x: regexp_extract_all(x, '[A-Za-z0-9]+')).flatten()[1:4], '_')) AS entity_name, 'Summary node for: ' || array_to_string(names, ', ') || '.' AS description FROM f),
  sr AS (SELECT level, cluster, node AS src_id, entity_name AS tgt_id, node || ' is summarized by ' || entity_name || '.' AS description FROM {_CL} JOIN se USING (level, cluster))"""
R.add("cluster_summaries", f"WITH {_SUM} SELECT level, cluster, entity_name, 'summary_entity' AS entity_type, description FROM se")(lambda s, d: summaries.summarize(_clusters(s, d))[0])
R.add("cluster_summary_relations", f"WITH {_SUM} SELECT level, cluster, src_id, tgt_id, description, 1.0::DOUBLE AS weight FROM sr")(lambda s, d: summaries.summarize(_clusters(s, d))[1])
R.add("summaries_applied", f"""WITH {_SUM}, n AS {_NODES}, k AS (SELECT * FROM n WHERE length(entity_name) % 2 = 0),
  r AS (SELECT least(src_id, tgt_id) AS src, greatest(src_id, tgt_id) AS tgt FROM sr), g AS (SELECT src, tgt FROM {COOC} UNION SELECT src, tgt FROM r)
  SELECT (SELECT count(*) FROM (SELECT entity_name FROM k UNION SELECT entity_name FROM se UNION SELECT src_id FROM sr)) AS nodes, (SELECT count(*) FROM g) AS edges,
    (SELECT count(*) FROM (SELECT entity_name FROM se UNION SELECT src_id FROM sr) WHERE entity_name NOT IN (SELECT entity_name FROM k)) AS added_nodes, (SELECT count(*) FROM (SELECT DISTINCT src, tgt FROM r EXCEPT SELECT src, tgt FROM {COOC})) AS added_edges,
    (SELECT count(DISTINCT src_id) FROM sr WHERE src_id NOT IN (SELECT entity_name FROM k)) AS unknown, (SELECT sum(weight) FROM {COOC}) + (SELECT count(*) FROM sr) AS weight""")(lambda s, d: _applied(s, d))


def _applied(s, d):
    """Into the nodes of even name length, so that some endpoints have none."""
    n = _nodes(s, d).filter("length(entity_name) % 2 = 0").select("entity_name", F.lit("NAME").alias("entity_type"), "description", F.lit("chunk-1").alias("source_id"))
    e = cooc(s, d).select("src", "tgt", "weight", F.lit("").alias("description"), F.lit("chunk-1").alias("source_id"))
    nodes, edges, counts = summaries.apply_summaries(n, e, *summaries.summarize(_clusters(s, d)))
    x = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("entity_type") == "UNKNOWN").alias("unknown")).join(F.broadcast(counts)).join(F.broadcast(edges.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))))  # one row each
    return x.select("nodes", "edges", "added_nodes", "added_edges", "unknown", "weight")


def _balance(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("community"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_type").alias("kind"))
    return graph.balance(p, part_supplier(s, d), 60, 0.99), p


_KINDS = "(SELECT p_brand AS community, p_type AS kind, count(*) AS n FROM part GROUP BY 1, 2)"
R.add("split_candidates", f"""WITH g AS (SELECT community, sum(n) AS n_nodes, CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0.0 END AS h FROM {_KINDS} GROUP BY 1)
  SELECT community, n_nodes::BIGINT AS n_nodes, round(h, 9) AS entropy FROM g WHERE (n_nodes > 60 OR h >= 0.99) AND n_nodes > 2 ORDER BY n_nodes DESC, round(h, 9) DESC, community LIMIT 20""")(
    lambda s, d: summaries.split_candidates(_balance(s, d)[0], 20).select("community", "n_nodes", "entropy")
)
R.add("community_top_kinds", f"SELECT community, string_agg(kind || ':' || n::VARCHAR, ',' ORDER BY r) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, kind) AS r FROM {_KINDS}) WHERE r <= 5 GROUP BY 1")(
    lambda s, d: summaries.top_kinds(_balance(s, d)[1], ["community"]).select("community", F.array_join(F.transform("kinds", lambda k: F.concat_ws(":", k["kind"], k["n"].cast("string"))), ",").alias("kinds"))
)
R.add("split_plan")(lambda s, d: _plan(s, d))


def _plan(s, d):
    b, p = _balance(s, d)
    v = vectors.embed(p.select(F.col("node").alias("id"), F.concat_ws(" ", "kind", "node").alias("t")), "id", "t")
    return summaries.split_plan(b, p, v, 3, 8).select("community", "label", "size", "entropy", F.size("named").alias("named"), F.size("kinds").alias("kinds"))


# ---------------------------------------------------------------- the model-free pipeline

R.add("scaffold_entities", f"""WITH m AS {MENTIONS} SELECT entity_name, arg_min(entity_type, pos) AS entity_type, arg_min(description, pos) AS description, md5(string_agg('d' || source_id::VARCHAR, ',' ORDER BY pos)) AS chunks, max(length(description)) AS layer FROM m GROUP BY 1""")(
    lambda s, d: _entities(s, d).withColumn("chunks", F.md5(F.array_join("chunks", ","))).drop("members")
)
R.add("scaffold_relations", """WITH m AS (SELECT l_orderkey * 8 + l_linenumber AS pos, 'k' || l_partkey::VARCHAR AS a, 'k' || l_suppkey::VARCHAR AS b, l_shipmode AS t, l_quantity AS w, 'o' || l_orderkey::VARCHAR AS c FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)),
  r AS (SELECT least(a, b) AS src, greatest(a, b) AS tgt, * FROM m), o AS (SELECT src, tgt, c, min(pos) AS f FROM r GROUP BY 1, 2, 3)
  SELECT src, tgt, sum(w) AS weight, arg_min(t, pos) AS description, (SELECT md5(string_agg(c, ',' ORDER BY f)) FROM o WHERE o.src = r.src AND o.tgt = r.tgt) AS chunks FROM r GROUP BY 1, 2""")(
    lambda s, d: scaffold.upsert_relations(table(s, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("src_id"), F.concat(F.lit("k"), F.col("l_suppkey").cast("string")).alias("tgt_id"), F.col("l_returnflag").alias("description"), F.col("l_quantity").alias("weight"), F.array(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("chunks"))).withColumn("chunks", F.md5(F.array_join("chunks", ",")))
)


def _entities(s, d, m=None):
    m = (m or mentions(s, d)).select("pos", "entity_name", "entity_type", "description", F.array(F.concat(F.lit("d"), "source_id")).alias("chunks"), F.length("description").alias("layer"), F.array().cast("array<string>").alias("members"))
    return scaffold.upsert_entities(m)


def _tf(src: str) -> str:
    """SQL: key, term, tf of (key, t)."""
    return f"""(SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT key, list_filter(regexp_extract_all(lower(t), '[a-z0-9]{{2,}}'), lambda x: x NOT IN ({STOP})) AS w FROM {src})) GROUP BY 1, 2)"""


def _tfidf(src: str, n: int = 2048) -> str:
    """SQL: key, term, weight, df over (key, t), whose number of rows is N."""
    return f"""(WITH tf AS {_tf(src)}, st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 ORDER BY cf DESC, term LIMIT {n}), x AS (SELECT key, term, df, tf * (ln((1 + (SELECT count(*) FROM {src})) / (1 + df)) + 1) AS v FROM tf JOIN st USING (term))
      SELECT key, term, df, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS weight FROM x)"""


_ENT_T = f"(SELECT entity_name AS key, entity_name || ' ' || arg_min(description, pos) AS t FROM {MENTIONS} GROUP BY 1)"
_DOC_T = "(SELECT doc_id AS key, text AS t FROM documents WHERE text IS NOT NULL)"
R.add("tfidf_vectors", f"SELECT key AS doc_id, term, round(weight, 9) AS weight FROM {_tfidf(_DOC_T)}")(lambda s, d: vectors.tfidf(table(s, d, "documents").filter("text IS NOT NULL"), "doc_id", "text").withColumn("weight", F.round("weight", 9)))
R.add("scaffold_node_vectors", f"SELECT key AS entity_name, term, round(weight, 9) AS weight FROM {_tfidf(_ENT_T)}")(lambda s, d: scaffold.node_vectors(_entities(s, d)).withColumn("weight", F.round("weight", 9)))
_Q = "(SELECT answer_id::VARCHAR AS key, query AS t FROM answers WHERE answer_id % 100 = 0 AND query IS NOT NULL)"
_HITS = f"""nv AS MATERIALIZED {_tfidf(_ENT_T)}, en AS MATERIALIZED (SELECT key FROM {_ENT_T}), q AS (SELECT tf.key, tf.term, tf * (ln((1 + (SELECT count(*) FROM en)) / (1 + df)) + 1) AS w FROM {_tf(_Q)} tf JOIN (SELECT term, count(*) AS df FROM nv GROUP BY 1) USING (term)),
  qn AS (SELECT key, sqrt(sum(w * w)) AS norm FROM q GROUP BY 1), sc AS (SELECT q.key AS query_id, nv.key AS node, round(sum(w * weight) / any_value(norm), 9) AS score FROM q JOIN qn USING (key) JOIN nv USING (term) GROUP BY 1, 2),
  al AS (SELECT z.key AS query_id, en.key AS node, coalesce(score, 0) AS score FROM {_Q} z CROSS JOIN en LEFT JOIN sc ON sc.query_id = z.key AND sc.node = en.key), h AS MATERIALIZED (SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) - 1 AS dense_order FROM al QUALIFY dense_order < 20)"""
_COM = f"co AS (SELECT query_id, cluster AS community, count(*) AS overlap, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, cluster) - 1 AS rank FROM h JOIN {_CL} USING (node) GROUP BY 1, 2)"


def _queries(s, d):
    return table(s, d, "answers").filter("answer_id % 100 = 0 AND query IS NOT NULL").select(F.col("answer_id").cast("string").alias("query_id"), "query")


def _hits(s, d):
    e = _entities(s, d)
    return scaffold.similar_nodes(scaffold.node_vectors(e), e, _queries(s, d), 20)


R.add("scaffold_similar_nodes", f"WITH {_HITS} SELECT query_id, node, score, dense_order::INTEGER AS dense_order FROM h")(_hits)
R.add("scaffold_communities", f"WITH {_HITS}, {_COM} SELECT query_id, community, overlap, rank::INTEGER AS rank FROM co")(
    lambda s, d: scaffold.scored_communities(_hits(s, d), _clusters(s, d).select(F.col("cluster").alias("community"), "node"))
)
_KEYS = f"""{_COM}, km AS (SELECT query_id, rank, node, dense_order, row_number() OVER (PARTITION BY query_id, community ORDER BY dense_order) AS m FROM co JOIN {_CL} ON cluster = community JOIN h USING (query_id, node)),
  ka AS (SELECT query_id, node, min(struct_pack(r := rank, d := dense_order)) AS pl FROM km WHERE m <= 10 GROUP BY 1, 2), kb AS (SELECT * FROM ka UNION ALL SELECT query_id, node, struct_pack(r := 0, d := dense_order) FROM h WHERE dense_order < 10 AND query_id NOT IN (SELECT query_id FROM ka))"""
R.add("scaffold_keys", f"WITH {_HITS}, {_KEYS} SELECT query_id, string_agg(node, '>' ORDER BY pl, node) AS keys FROM kb GROUP BY 1")(lambda s, d: _keys(s, d).withColumn("keys", F.array_join("keys", ">")))


def _keys(s, d):
    h, m = cut(_hits(s, d)), _clusters(s, d).select(F.col("cluster").alias("community"), "node")
    return scaffold.key_nodes(h, scaffold.scored_communities(h, m), m, 10)


R.add("mode_scaffold")(lambda s, d: _scaffold(s, d))


def _scaffold(s, d):
    """All from one reading of the names. A relation's chunks are the documents in which both its ends stand."""
    m = written(mentions(s, d), "mentions")
    chunks = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"))
    members = _clusters(s, d, m).select(F.col("cluster").alias("community"), "node")
    return scaffold.retrieve(_entities(s, d, m), _relations(m), members, chunks, _queries(s, d))


def _relations(m):
    return extract.cooccurrence(m.select("pos", F.col("entity_name").alias("name")), "pos")


# ---------------------------------------------------------------- requests and texts

_EDGE_T = f"(SELECT e.src, e.tgt, 'source: ' || e.src || chr(10) || coalesce(a.description, '') || chr(10) || 'relation: ' || e.weight::BIGINT::VARCHAR || ' times' || chr(10) || 'target: ' || e.tgt || chr(10) || coalesce(b.description, '') AS t FROM {COOC} e LEFT JOIN k a ON a.entity_name = e.src LEFT JOIN k b ON b.entity_name = e.tgt)"
R.add("edge_embedding_requests", f"""WITH k AS (SELECT * FROM {_NODES} WHERE length(entity_name) % 2 = 0) SELECT 'edge-' || substr(sha256('m' || chr(31) || src || chr(31) || tgt), 1, 24) AS custom_id, src, tgt, md5(t) AS input, sha256(t) AS text_hash, sha256(t) AS embedded_text_hash FROM {_EDGE_T}""")(
    lambda s, d: _requests(s, d).withColumn("input", F.md5("input"))
)


def _requests(s, d):
    e = cooc(s, d).select("src", "tgt", F.concat(F.col("weight").cast("bigint").cast("string"), F.lit(" times")).alias("description"))
    return stores.edge_requests(e, _nodes(s, d).filter("length(entity_name) % 2 = 0"), "m")


_BACK = f"""WITH k AS (SELECT * FROM {_NODES} WHERE length(entity_name) % 2 = 0), r AS (SELECT 'edge-' || substr(sha256('m' || chr(31) || src || chr(31) || tgt), 1, 24) AS custom_id, src, tgt, sha256(t) AS text_hash FROM {_EDGE_T})"""
R.add("edge_embeddings_imported", f"{_BACK} SELECT src, tgt, text_hash, text_hash AS embedded_text_hash, length(src) AS x FROM r WHERE length(tgt) % 7 > 1")(lambda s, d: _imported(s, d)[0].select("src", "tgt", "text_hash", "embedded_text_hash", F.get("vec", F.lit(0)).cast("int").alias("x")))
R.add("edge_embedding_errors", f"{_BACK} SELECT custom_id, CASE WHEN length(tgt) % 7 = 0 THEN 'status 500' ELSE 'no embedding' END AS error FROM r WHERE length(tgt) % 7 <= 1 UNION ALL SELECT 'stray', 'no metadata'")(lambda s, d: _imported(s, d)[1])


def _imported(s, d):
    """Answers to the requests: an error for every seventh length of the target's name, no vector for the next, and one stray answer."""
    r = _requests(s, d)
    k = F.length("tgt") % 7
    out = r.select("custom_id", F.when(k > 1, F.array(F.length("src").cast("float"))).alias("vec"), F.when(k == 0, "status 500").alias("error"))
    return stores.import_embeddings(out.unionByName(s.range(1).select(F.lit("stray").alias("custom_id"), F.array(F.lit(1.0).cast("float")).alias("vec"), F.lit(None).cast("string").alias("error"))), r)


R.add("judge_objects", """SELECT answer_id, CASE WHEN json_valid(t) THEN md5(t) WHEN json_valid(regexp_extract(t, '(?s)\\{.*\\}')) THEN md5(regexp_extract(t, '(?s)\\{.*\\}')) END AS verdict FROM (SELECT answer_id, CASE WHEN answer_id % 2 = 0 THEN 'Verdict: ' || context_debug || ' end' ELSE context_debug END AS t FROM answers)""")(
    lambda s, d: table(s, d, "answers").select("answer_id", F.md5(fr.judge_object(F.when(F.col("answer_id") % 2 == 0, F.concat(F.lit("Verdict: "), "context_debug", F.lit(" end"))).otherwise(F.col("context_debug")))).alias("verdict"))
)
_REPORT = """(SELECT answer_id, CASE answer_id % 6 WHEN 0 THEN '{"title": "t", "summary": "s", "findings": [{"summary": "a", "explanation": "b"}]}' WHEN 1 THEN '{"title": "t", "summary": "s", "findings": "[{\\"summary\\": \\"a\\", \\"explanation\\": \\"b\\"}]"}'
  WHEN 2 THEN '{"title": "t", "summary": "s", "findings": "broken ["}' WHEN 3 THEN '{"title": "", "summary": "s", "findings": []}' WHEN 4 THEN '{"title": "t", "findings": []}' ELSE context_debug END AS t FROM answers)"""
R.add("report_errors", f"""SELECT answer_id, CASE WHEN t IS NULL OR NOT json_valid(t) OR json_type(t) <> 'OBJECT' OR len(json_keys(t)) = 0 THEN 'unable to parse community report JSON' WHEN coalesce(t ->> '$.title', '') = '' THEN 'community report missing title' WHEN coalesce(t ->> '$.summary', '') = '' THEN 'community report missing summary'
  WHEN json_type(t, '$.findings') = 'VARCHAR' AND NOT json_valid(t ->> '$.findings') THEN 'community report findings is not a JSON list' END AS problem FROM {_REPORT}""")(
    lambda s, d: _reports(s, d).select("answer_id", fr.report_error(F.col("t")).alias("problem"))
)


def _reports(s, d):
    texts = ['{"title": "t", "summary": "s", "findings": [{"summary": "a", "explanation": "b"}]}', '{"title": "t", "summary": "s", "findings": "[{\\"summary\\": \\"a\\", \\"explanation\\": \\"b\\"}]"}', '{"title": "t", "summary": "s", "findings": "broken ["}', '{"title": "", "summary": "s", "findings": []}', '{"title": "t", "findings": []}']
    t = F.col("context_debug")
    for i, x in enumerate(texts):
        t = F.when(F.col("answer_id") % 6 == i, x).otherwise(t)
    return table(s, d, "answers").select("answer_id", t.alias("t"))


R.add("entity_texts", f"SELECT md5(entity_name || chr(10) || 'type: UNKNOWN' || chr(10) || 'description: ' || description) AS t, entity_name FROM {_NODES}")(lambda s, d: _nodes(s, d).select(F.md5(fr.entity_text(F.col("entity_name"), F.lit(None).cast("string"), F.col("description"))).alias("t"), "entity_name"))
R.add("text_unit_prefixes", "SELECT context_id, CASE WHEN length(context) <= 200 THEN context ELSE rtrim(context[1:200], ' ') || ' ...' END AS content FROM unique_contexts")(
    lambda s, d: table(s, d, "unique_contexts").select("context_id", fr.text_unit_content(F.col("context"), None, 200).alias("content"))
)
R.add("truncated_texts", f"SELECT doc_id, md5(array_to_string(({WORDS('text')})[1:50], ' ')) AS t FROM documents WHERE text IS NOT NULL")(lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(fr.truncate_tokens(F.col("text"), 50)).alias("t")))
R.add("sanitized_labels", """SELECT DISTINCT source, CASE WHEN regexp_matches(t, '^[0-9]') THEN '_' || t ELSE t END AS label FROM (SELECT source, regexp_replace(regexp_replace(source, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '[^A-Za-z0-9_]+', '_', 'g') AS t FROM documents WHERE source IS NOT NULL)""")(
    lambda s, d: table(s, d, "documents").filter("source IS NOT NULL").select("source", fr.label_of_namespace(F.col("source")).alias("label")).distinct()
)
