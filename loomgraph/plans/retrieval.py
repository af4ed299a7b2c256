"""Queries of paths, communities, hierarchy and the retrieval modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import community, hierarchy, paths, retrieval, vectors
from loomgraph.plans.graph import CN, PS, cooc, embedded, nation_graph, part_supplier
from loomgraph.plans.registry import Registry
from loomgraph.plans.text import ENT, ENT_STOP, TRIM, WORDS
from loomgraph.session import cut, shared_dir, table

R = Registry()
#: The nation graph with a cost from the lengths and letters of its ends, the same in both engines.
COST = "((ascii(substr(src, 2, 1)) * 7 + ascii(substr(tgt, 2, 1)) * 3) % 10 + 1)::DOUBLE / 10"
_E = f"e AS (SELECT src AS u, tgt AS v, {COST} AS c FROM {CN} UNION SELECT tgt, src, {COST} FROM {CN})"


def costed(s, d):
    c = ((F.ascii(F.substring("src", 2, 1)) * 7 + F.ascii(F.substring("tgt", 2, 1)) * 3) % 10 + 1).cast("double") / 10
    return nation_graph(s, d).withColumn("cost", c)


def _origins(s, d):
    return nation_graph(s, d).filter("tgt LIKE 'r%'").select(F.col("tgt").alias("node")).distinct()


def _walk(step: str) -> str:
    return f"""WITH RECURSIVE {_E}, r(origin, node, k, cost) AS (SELECT DISTINCT u, u, 0, 0.0::DOUBLE FROM e WHERE u LIKE 'r%'
      UNION SELECT r.origin, e.v, r.k + 1, {step} FROM r JOIN e ON e.u = r.node WHERE r.k < 4)
      SELECT origin, node, round(min(cost), 6) AS cost FROM r GROUP BY 1, 2"""


R.add("weighted_path_cost", _walk("round(r.cost + e.c, 6)"))(lambda s, d: paths.relaxed_costs(costed(s, d), _origins(s, d), 4).withColumn("cost", F.round("cost", 6)))
R.add("minmax_path_cost", _walk("greatest(r.cost, e.c)"))(lambda s, d: paths.relaxed_costs(costed(s, d), _origins(s, d), 4, bottleneck=True).withColumn("cost", F.round("cost", 6)))


def supplied(s, d):
    return part_supplier(s, d).select("src", "tgt", (1 / (1 + F.col("weight"))).cast("double").alias("cost"))


def _far(s, d):
    return table(s, d, "supplier").filter("s_suppkey % 100 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))


# The two above go as far as their SQL, over at most 4 edges; these go on until no label falls. SQL would have to walk all paths.
R.add("weighted_path_cost_whole")(lambda s, d: paths.relaxed_costs(supplied(s, d), _far(s, d)).withColumn("cost", F.round("cost", 6)))
R.add("minmax_path_cost_whole")(lambda s, d: paths.relaxed_costs(supplied(s, d), _far(s, d), bottleneck=True).withColumn("cost", F.round("cost", 6)))


#: Segments between nations, segments and regions; the graph's size doesn't depend on the scale, and no best path has more than 9 edges.
_SEGS = "(SELECT 'q' || i AS query_id, k AS seg, keys[k + 1] AS source, keys[k + 2] AS target FROM (SELECT i, ['r' || (i % 5)::VARCHAR, 'n' || i::VARCHAR, 'r' || ((i + 2) % 5)::VARCHAR, 'n' || ((i * 7) % 25)::VARCHAR] AS ks, list_filter(ks, lambda x, j: list_position(ks, x) = j) AS keys, unnest(range(len(list_filter(ks, lambda x, j: list_position(ks, x) = j)) - 1)) AS k FROM (SELECT unnest(range(25)) AS i)))"


#: Least costs from every node of a segment's graph to its target, and the first path in order of its nodes that has them.
_ENDS = {
    "unweighted": ("0", "99"), "query_weighted": ("round(l.cost + e.c, 6)", "99"),
    "minmax": ("0", "(SELECT min(m) FROM m WHERE m.s = g.source AND m.node = g.target)"), "minmax_budgeted": ("0", "(SELECT min(m) FROM m WHERE m.s = g.source AND m.node = g.target)"),
}


def _paths(strategy: str) -> str:
    """SQL: labels spread from the targets over edges up to the segment's ceiling; then each source walks down the labels."""
    cost, cap = _ENDS[strategy]
    hops = " AND m.k < 6" if strategy == "minmax_budgeted" else ""
    k = "m.k + 1" if hops else "0"
    return f"""WITH RECURSIVE {_E}, g0 AS {_SEGS}, m(s, node, m, k) AS (SELECT DISTINCT source, source, 0.0::DOUBLE, 0 FROM g0 UNION SELECT m.s, e.v, greatest(m.m, e.c), {k} FROM m JOIN e ON e.u = m.node WHERE true{hops}),
      g AS MATERIALIZED (SELECT g.*, {cap} AS cap FROM g0 g), l(query_id, seg, node, cost, k, cap) AS (SELECT query_id, seg, target, 0.0::DOUBLE, 0, cap FROM g UNION SELECT query_id, seg, e.v, {cost}, l.k + 1, cap FROM l JOIN e ON e.u = l.node AND e.c <= l.cap + 1e-9 WHERE l.k < 9),
      b AS MATERIALIZED (SELECT query_id, seg, node, any_value(cap) AS cap, min(struct_pack(c := cost, k := k)) AS l FROM l GROUP BY 1, 2, 3),
      nx AS MATERIALIZED (SELECT x.query_id, x.seg, x.node, min(y.node) AS v FROM b x JOIN e ON e.u = x.node AND e.c <= x.cap + 1e-9 JOIN b y ON y.query_id = x.query_id AND y.seg = x.seg AND y.node = e.v AND y.l.k + 1 = x.l.k AND {'abs(y.l.c + e.c - x.l.c) < 1e-6' if strategy == 'query_weighted' else 'true'} GROUP BY 1, 2, 3),
      w(query_id, seg, node, path) AS (SELECT query_id, seg, source, [source] FROM g UNION ALL SELECT w.query_id, w.seg, nx.v, list_append(w.path, nx.v) FROM w JOIN nx ON nx.query_id = w.query_id AND nx.seg = w.seg AND nx.node = w.node),
      p AS (SELECT g.query_id, g.seg, source, target, path FROM g JOIN w ON w.query_id = g.query_id AND w.seg = g.seg AND w.node = g.target), z AS (SELECT query_id, array_to_string(list_concat([arg_min(source, seg)], flatten(list(path[2:] ORDER BY seg))), '>') AS path FROM p GROUP BY 1)
      SELECT p.query_id, z.path, source, target, '{strategy}' AS decision, (len(p.path) - 1)::INTEGER AS path_edges FROM p JOIN z USING (query_id)"""


def _bridge(strategy: str):
    def run(s, d):
        e = costed(s, d)
        keys = s.createDataFrame([(f"q{i}", [f"r{i % 5}", f"n{i}", f"r{(i + 2) % 5}", f"n{(i * 7) % 25}"]) for i in range(25)], "query_id string, keys array<string>")
        costs = e.select(F.explode(F.array(*[F.lit(f"q{i}") for i in range(25)])).alias("query_id"), "src", "tgt", "cost")
        p = paths.bridge_paths(e.select("src", "tgt"), keys, paths.PathOptions(strategy=strategy, max_path_edges=6), costs)
        return p.select("query_id", F.array_join("path", ">").alias("path"), F.explode("decisions").alias("d")).select("query_id", "path", "d.*")

    return run


for _s in _ENDS:
    R.add(f"bridge_path_{_s}", _paths(_s))(_bridge(_s))
R.add("bridge_path_mcts")(_bridge("mcts"))

R.add("communities_part_supplier")(lambda s, d: community.modularity_communities(part_supplier(s, d)))
R.add("hierarchical_communities")(lambda s, d: community.hierarchical_communities(cooc(s, d)))
R.add("community_modularity", f"""WITH e AS (SELECT src, tgt, weight AS w FROM {PS}), c AS (SELECT DISTINCT node, right(node, 1) AS community FROM (SELECT src AS node FROM e UNION SELECT tgt FROM e)),
  j AS (SELECT e.w, a.community AS cs, b.community AS ct FROM e JOIN c a ON a.node = e.src JOIN c b ON b.node = e.tgt), i AS (SELECT cs AS c, sum(w) AS i FROM j WHERE cs = ct GROUP BY 1),
  g AS (SELECT c, sum(w) AS d FROM (SELECT cs AS c, w FROM j UNION ALL SELECT ct, w FROM j) GROUP BY 1)
  SELECT round(sum(coalesce(i, 0) / (SELECT sum(w) FROM e) - (d / (2 * (SELECT sum(w) FROM e))) ** 2), 6) AS modularity, count(*) AS communities FROM g LEFT JOIN i USING (c)""")(
    lambda s, d: (lambda e: community.modularity(e, e.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().withColumn("community", F.right("node", F.lit(1)))).withColumn("modularity", F.round("modularity", 6)))(part_supplier(s, d))
)
R.add("gmm_soft_clusters")(lambda s, d: hierarchy.soft_clusters(table(s, d, "embeddings"), "vec_id", "embedding").withColumn("p", F.round("p", 6)))
R.add("cluster_layers")(lambda s, d: hierarchy.layers(table(s, d, "embeddings"), "vec_id", "embedding").withColumn("p", F.round("p", 6)))

_built: dict = {}


def index_of(s, d) -> retrieval.Index:
    """The index of a scale's documents, built once a session and laid in the shared folder."""
    key = (s.sparkContext.applicationId, d, shared_dir(s))
    if key not in _built:
        _built.clear()
        _built[key] = retrieval.build_index(table(s, d, "documents"))
    return _built[key]


def query_vectors(s, d):
    """The queries: every answer whose id is divisible by 100, against the whole index."""
    q = table(s, d, "answers").filter("answer_id % 100 = 0 AND query IS NOT NULL").select(F.col("answer_id").cast("string").alias("query_id"), "query")
    return cut(vectors.embed(q, "query_id", "query").select("query_id", F.col("vec").alias("qvec")).join(q, "query_id"))


def _mode(mode: str):
    return lambda s, d: retrieval.retrieve(index_of(s, d), query_vectors(s, d), mode)


#: The index by SQL, as far as it needs no communities: chunks of 120 words with 20 in common, mentions, nodes, edges.
_TOK = lambda c: f"len({WORDS(c)})"
_INDEX = f"""docs AS (SELECT min(doc_id) AS doc, t FROM (SELECT doc_id, {TRIM('text')} AS t FROM documents) WHERE t <> '' GROUP BY t),
  win AS (SELECT doc, i, least(120, len(w) - i * 100) AS tokens, array_to_string(w[i * 100 + 1 : i * 100 + 120], ' ') AS content FROM (SELECT doc, w, unnest(range(0, (len(w) - 1) // 100 + 1)) AS i FROM (SELECT doc, {WORDS('t')} AS w FROM docs))),
  ch AS MATERIALIZED (SELECT 'chunk-' || md5(content) AS chunk_id, content, any_value(tokens) AS tokens FROM win GROUP BY content),
  men AS MATERIALIZED (SELECT DISTINCT chunk_id, upper(n) AS node FROM (SELECT chunk_id, unnest(regexp_extract_all(content, '{ENT}')) AS n FROM ch) WHERE n NOT IN ({ENT_STOP})),
  nod AS MATERIALIZED (SELECT *, {_TOK("node || ' normal_entity ' || description")} AS tokens FROM (SELECT node, 'Mentioned in ' || count(*)::VARCHAR || ' chunks.' AS description FROM men GROUP BY 1)),
  edg AS MATERIALIZED (SELECT *, {_TOK("src || ' ' || tgt || ' Co-occurs in the same text chunk.'")} AS tokens FROM (SELECT a.node AS src, b.node AS tgt, count(*)::DOUBLE AS weight FROM men a JOIN men b ON a.chunk_id = b.chunk_id AND a.node < b.node GROUP BY 1, 2)),
  qv AS MATERIALIZED {embedded("(SELECT answer_id::VARCHAR AS key, query AS t FROM answers WHERE answer_id % 100 = 0 AND query IS NOT NULL)")}, qn AS (SELECT key, sqrt(sum(x * x)) AS n FROM qv GROUP BY 1)"""


def _near(name: str, src: str, k: int) -> str:
    """SQL: query_id, id, score, dense_order of the k nearest of (key, t), from a cosine of 0.2."""
    return f"""{name}v AS MATERIALIZED {embedded(src)}, {name}n AS (SELECT key, sqrt(sum(x * x)) AS n FROM {name}v GROUP BY 1), {name}s AS (SELECT q.key AS query_id, v.key AS id, round(sum(q.x * v.x) / any_value(qn.n) / any_value({name}n.n), 9) AS score FROM qv q JOIN {name}v v USING (dim) JOIN qn ON qn.key = q.key JOIN {name}n ON {name}n.key = v.key WHERE qn.n > 0 AND {name}n.n > 0 GROUP BY 1, 2),
  {name} AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS dense_order FROM {name}s WHERE score >= 0.2 QUALIFY dense_order < {k})"""


def _fits(frm: str, order: str, budget: int) -> str:
    """SQL: what of a ranked list fits into a budget of tokens."""
    return f"(SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (PARTITION BY query_id ORDER BY {order}) - 1 AS rank FROM {frm}) WHERE running <= {budget})"


_NAIVE = f"""WITH {_INDEX}, {_near('h', '(SELECT chunk_id AS key, content AS t FROM ch)', 20)}
  SELECT query_id, 'chunks' AS section, rank::INTEGER AS rank, chunk_id AS item, tokens::BIGINT AS tokens FROM {_fits('(SELECT query_id, chunk_id, dense_order, tokens FROM h JOIN ch ON chunk_id = id)', 'dense_order', 10000)}"""
_LOCAL = f"""WITH {_INDEX}, {_near('h', "(SELECT node AS key, node || ' ' || description AS t FROM nod)", 20)}, deg AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM edg UNION ALL SELECT tgt FROM edg) GROUP BY 1),
  le AS (SELECT DISTINCT query_id, src, tgt, weight, tokens, a.k + b.k AS ed FROM edg JOIN deg a ON a.node = src JOIN deg b ON b.node = tgt JOIN h ON h.id = src OR h.id = tgt),
  fi AS (SELECT query_id, chunk_id, id AS node, dense_order FROM h JOIN men ON men.node = id QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY dense_order, id) = 1),
  sy AS (SELECT src AS u, tgt AS v FROM edg UNION ALL SELECT tgt, src FROM edg), re AS (SELECT query_id, fi.chunk_id, count(*) AS relations FROM fi JOIN sy ON sy.u = fi.node JOIN men ON men.node = sy.v AND men.chunk_id = fi.chunk_id GROUP BY 1, 2),
  tu AS (SELECT fi.query_id, fi.chunk_id, dense_order, coalesce(relations, 0) AS relations, tokens FROM fi LEFT JOIN re USING (query_id, chunk_id) JOIN ch USING (chunk_id))
  SELECT query_id, 'entities' AS section, dense_order::INTEGER AS rank, id AS item, tokens::BIGINT AS tokens FROM h JOIN nod ON node = id
  UNION ALL SELECT query_id, 'relations', rank::INTEGER, src || '|' || tgt, tokens::BIGINT FROM {_fits('le', 'ed DESC, weight DESC, src, tgt', 20000)}
  UNION ALL SELECT query_id, 'sources', rank::INTEGER, chunk_id, tokens::BIGINT FROM {_fits('tu', 'dense_order, relations DESC, chunk_id', 20000)}"""
_MODE_SQL = {"naive": _NAIVE, "hi_local": _LOCAL}
for _m in retrieval.MODES:
    R.add(f"mode_{_m}", _MODE_SQL.get(_m))(_mode(_m))

R.add("mode_queries", "SELECT answer_id::VARCHAR AS query_id, query FROM answers WHERE answer_id % 100 = 0 AND query IS NOT NULL")(lambda s, d: query_vectors(s, d).select("query_id", "query"))
R.add("index_counts", f"WITH {_INDEX} SELECT 'chunks' AS name, count(*) AS n FROM ch UNION ALL SELECT 'nodes', count(*) FROM nod UNION ALL SELECT 'edges', count(*) FROM edg UNION ALL SELECT 'mentions', count(*) FROM men")(lambda s, d: _counts(index_of(s, d)))
R.add("index_community_counts")(lambda s, d: evaluate_levels(index_of(s, d)))


def evaluate_levels(ix: retrieval.Index):
    """Communities, members and reports of each level."""
    m = ix.members.groupBy("level").agg(F.count_distinct("community").alias("communities"), F.count("*").alias("members"))
    return m.join(ix.reports.groupBy("level").agg(F.count("*").alias("reports")), "level", "left")


def _counts(ix: retrieval.Index):
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in (("chunks", ix.chunks), ("nodes", ix.nodes), ("edges", ix.edges), ("mentions", ix.mentions))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


R.add("community_reports")(lambda s, d: index_of(s, d).reports)
R.add("packed_descriptions")(lambda s, d: (lambda ix: community.packed_descriptions(ix.members, ix.nodes, ix.edges, 400))(index_of(s, d)))
_RUN = lambda frm, order: f"(SELECT query_id, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS running FROM {frm})"
_HEAD = _LOCAL[: _LOCAL.rindex("SELECT query_id, 'entities' AS section")].rstrip()
R.add("budget_attempts", f"""{_HEAD}, al AS (SELECT * FROM {_RUN('le', 'ed DESC, weight DESC, src, tgt')} WHERE running <= 20000 UNION ALL SELECT * FROM {_RUN('tu', 'dense_order, relations DESC, chunk_id')} WHERE running <= 20000),
  tr AS (SELECT i AS attempt, 0.7::DOUBLE ** (i - 1) AS scale FROM (SELECT unnest(range(1, 6))::INTEGER AS i)), x AS (SELECT query_id, attempt, scale, coalesce(sum(tokens) FILTER (WHERE running <= floor(20000 * scale)), 0)::BIGINT AS total FROM al, tr GROUP BY 1, 2, 3)
  SELECT query_id, attempt, round(scale, 9) AS scale, total, total <= 9000 AS within FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total <= 9000 DESC, CASE WHEN total <= 9000 THEN attempt ELSE -attempt END) = 1""")(lambda s, d: _attempts(s, d).withColumn("scale", F.round("scale", 9)))


def _attempts(s, d):
    from loomgraph.operators.retrieval import QueryOptions, entity_hits, local_edges, text_units

    ix, q, o = index_of(s, d), query_vectors(s, d), QueryOptions()
    h = cut(entity_hits(ix, q, o)).filter(F.col("dense_order") < o.top_k)
    t = text_units(ix, h, o).select("query_id", F.lit("sources").alias("section"), "running_cost", "tokens", F.lit(o.text_budget).alias("budget"))
    e = local_edges(ix, h, o).select("query_id", F.lit("relations").alias("section"), "running_cost", "tokens", F.lit(o.local_budget).alias("budget"))
    return retrieval.shrunk_attempts(t.unionByName(e), 9000)


# ---------------------------------------------------------------- sections over given communities: the labels of vectors

_LABEL_HITS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) DESC, vec_id) - 1 AS d FROM embeddings, q WHERE list_cosine_similarity(embedding::DOUBLE[], qv) >= 0.2 QUALIFY d < 20)"""
_REPORTS = "(SELECT label, CASE WHEN label % 4 = 3 THEN NULL ELSE (label % 3)::DOUBLE END AS rating, 100 * (label + 1) AS tokens FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL))"


class Labelled:
    """What key_entities and communities need of an index, with the labels of vectors as communities."""

    def __init__(self, s, d):
        e = table(s, d, "embeddings").filter("label IS NOT NULL")
        self.members = e.select(F.lit(0).alias("level"), F.col("label").cast("string").alias("community"), F.col("vec_id").cast("string").alias("node"))
        label = e.select("label").distinct()
        self.reports = label.select(F.lit(0).alias("level"), F.col("label").cast("string").alias("community"), F.when(F.col("label") % 4 != 3, (F.col("label") % 3).cast("double")).alias("rating"), (100 * (F.col("label") + 1)).alias("tokens"))
        q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
        self.hits = vectors.topk(table(s, d, "embeddings"), q, 20).withColumn("node", F.col("vec_id").cast("string"))


R.add("key_entities", f"WITH {_LABEL_HITS}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY d) AS n FROM h WHERE label IS NOT NULL) SELECT query_id, string_agg(vec_id::VARCHAR, '>' ORDER BY d) AS keys FROM m WHERE n <= 2 GROUP BY 1")(
    lambda s, d: (lambda x: retrieval.key_entities(x, x.hits, retrieval.QueryOptions(top_m=2)).withColumn("keys", F.array_join("keys", ">")))(Labelled(s, d))
)
R.add("related_communities", f"""WITH {_LABEL_HITS}, v AS (SELECT query_id, label, count(*) AS hits FROM h WHERE label IS NOT NULL GROUP BY 1, 2), r AS (SELECT query_id, label::VARCHAR AS community, hits, sum(tokens) OVER (PARTITION BY query_id ORDER BY hits DESC, coalesce(rating, -1) DESC, label::VARCHAR ROWS UNBOUNDED PRECEDING)::BIGINT AS running_cost FROM v JOIN {_REPORTS} USING (label))
  SELECT * FROM r WHERE running_cost <= 900""")(
    lambda s, d: (lambda x: retrieval.communities(x, x.hits, retrieval.QueryOptions(community_budget=900)).select("query_id", "community", "hits", "running_cost"))(Labelled(s, d))
)
