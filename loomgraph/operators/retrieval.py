"""Retrieval: one plan answers a whole table of queries in any mode.

An index is a set of tables; a mode is a choice of sections. Every section is a ranked list a query, cut by its token budget."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import records as fr
from loomgraph.operators import chunking, community, extract, graph, paths, vectors
from loomgraph.models import Embedder, Extractor, Reporter, Reranker
from loomgraph.session import cut, written


@dataclass(frozen=True)
class QueryOptions:
    """Defaults of the retrieval parameters."""

    mode: str = "hi"
    level: int = 2
    top_k: int = 20
    top_m: int = 10
    multiplier: int = 10
    threshold: float = 0.2
    rerank: bool = False
    rerank_top_n: int = 100
    alpha: float = 1.0
    beta: float = 0.15
    gamma: float = 0.05
    naive_budget: int = 10_000
    text_budget: int = 20_000
    local_budget: int = 20_000
    bridge_budget: int = 12_500
    community_budget: int = 12_500
    paths: paths.PathOptions = field(default_factory=paths.PathOptions)


#: The modes: sections, bridge strategy, rerank (fixed by the modes' names).
MODES = {
    "naive": (("chunks",), "none", False),
    "hi_local": (("entities", "relations", "sources"), "none", False),
    "hi_global": (("communities", "sources"), "none", False),
    "hi_nobridge": (("communities", "entities", "relations", "sources"), "none", False),
    "hi_bridge": (("bridge", "sources"), "unweighted", False),
    "hi": (("communities", "bridge", "entities", "sources"), "unweighted", False),
    "hi_weighted": (("communities", "bridge", "entities", "sources"), "query_weighted", False),
    "hi_minmax": (("communities", "bridge", "entities", "sources"), "minmax", False),
    "hi_minmax_budgeted": (("communities", "bridge", "entities", "sources"), "minmax_budgeted", False),
    "hi_mcts": (("communities", "bridge", "entities", "sources"), "mcts", False),
    "hi_rerank": (("communities", "bridge", "entities", "sources"), "unweighted", True),
    "hi_rerank_weighted": (("communities", "bridge", "entities", "sources"), "query_weighted", True),
}


#: The description of every edge of a built index.
EDGE = "Co-occurs in the same text chunk."


@dataclass
class Index:
    """chunks: chunk_id, ord, tokens, content; mentions: node, chunk_id; nodes: entity_name, entity_type, description, tokens;
    edges: src, tgt, weight, description, tokens; members: level, community, node; reports: level, community, text, rating, tokens;
    node_vectors, chunk_vectors: id, vec; edge_vectors: src, tgt, vec."""

    chunks: DataFrame
    mentions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    reports: DataFrame
    node_vectors: DataFrame
    chunk_vectors: DataFrame
    edge_vectors: DataFrame

    def chunk_relations(self, nodes: DataFrame) -> DataFrame:
        """node, chunk_id, relations: for the chunks that cite each of nodes, how many of its edges' other ends they also cite."""
        m = self.mentions.join(nodes, "node", "left_semi")
        both = m.join(self.mentions.select(F.col("node").alias("v"), "chunk_id"), "chunk_id").select("node", "chunk_id", F.least("node", "v").alias("src"), F.greatest("node", "v").alias("tgt"))
        rel = both.join(self.edges.select("src", "tgt"), ["src", "tgt"], "left_semi").groupBy("node", "chunk_id").agg(F.count("*").alias("relations"))
        return m.join(rel, ["node", "chunk_id"], "left").fillna(0, ["relations"])

    def path_costs(self, queries: DataFrame, o: QueryOptions) -> paths.Costs:
        def by_joins(e: DataFrame, block: DataFrame) -> DataFrame:
            return graph.block_costs(e, self.edges, self.edge_vectors, block.join(queries.select("query_id", "qvec"), "query_id"), paths.UNIT, o.alpha, o.beta, o.gamma)

        return by_joins


class Built(Index):
    """The index of documents, whose tables are made when they are first asked for, each once, with all that they need and no more."""

    def __init__(self, documents: DataFrame, text: str, size: int, overlap: int, embedder: Embedder | None, extractor: Extractor | None, chunker, reporter: Reporter | None):
        self.documents, self.text, self.size, self.overlap = documents, text, size, overlap
        self.embedder, self.extractor, self.chunker, self.reporter = embedder, extractor, chunker, reporter

    @cached_property
    def chunks(self) -> DataFrame:
        docs = chunking.dedupe_documents(self.documents, self.text)
        return written(chunking.chunks(docs, size=self.size, overlap=self.overlap, chunker=self.chunker).select("chunk_id", F.col("chunk_order_index").alias("ord"), "tokens", "content"), "chunks")

    @cached_property
    def mentions(self) -> DataFrame:
        if self.extractor is None:  # each chunk's names once, where the chunk is read
            return written(self.chunks.select(F.explode(F.array_distinct(F.transform(fr.entity_names(F.col("content")), F.upper))).alias("node"), "chunk_id"), "mentions")
        return written(self.extractor(self.chunks, "chunk_id", "content").select(F.upper("name").alias("node"), "chunk_id").distinct(), "mentions")

    @cached_property
    def nodes(self) -> DataFrame:
        n = self.mentions.groupBy(F.col("node").alias("entity_name")).agg(F.lit("normal_entity").alias("entity_type"), F.concat(F.lit("Mentioned in "), F.count("*").cast("string"), F.lit(" chunks.")).alias("description"))
        return written(n.withColumn("tokens", fr.n_tokens(F.concat_ws(" ", "entity_name", "entity_type", "description"))), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        e = extract.cooccurrence(self.mentions.select("chunk_id", F.col("node").alias("name")), "chunk_id", words=True)
        return written(e.select("src", "tgt", "weight", F.lit(EDGE).alias("description"), (F.col("tokens") + len(EDGE.split())).alias("tokens")), "edges")

    @cached_property
    def members(self) -> DataFrame:
        return written(community.hierarchical_communities(self.edges, small=community.SMALL, stored=True), "members")

    @cached_property
    def reports(self) -> DataFrame:
        rep = (self.reporter or community.extractive_reports)(self.members, self.nodes, self.edges)
        rep = rep.select("level", "community", fr.report_markdown(F.col("title"), F.col("summary"), F.col("findings")).alias("text"), "rating")
        return written(rep.withColumn("tokens", fr.n_tokens(F.col("text"))), "reports")

    @cached_property
    def node_vectors(self) -> DataFrame:
        return written(vectors.embed(self.nodes.select(F.col("entity_name").alias("id"), F.concat_ws(" ", "entity_name", "description").alias("t")), "id", "t", embedder=self.embedder), "vectors")

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        return written(vectors.embed(self.chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("t")), "id", "t", embedder=self.embedder), "vectors")

    @cached_property
    def edge_vectors(self) -> DataFrame:
        a, b = self.node_vectors.select(F.col("id").alias("src"), F.col("vec").alias("va")), self.node_vectors.select(F.col("id").alias("tgt"), F.col("vec").alias("vb"))
        return written(self.edges.select("src", "tgt").join(a, "src").join(b, "tgt").select("src", "tgt", F.zip_with(unit("va"), unit("vb"), lambda x, y: (x + y) / 2).alias("vec")), "vectors")

    def chunk_relations(self, nodes: DataFrame) -> DataFrame:
        """All that stand in a chunk have edges here, so the relations of a node in it are the others."""
        size = self.mentions.groupBy("chunk_id").agg((F.count("*") - 1).alias("relations"))
        return self.mentions.join(nodes, "node", "left_semi").join(size, "chunk_id").select("node", "chunk_id", "relations")

    def path_costs(self, queries: DataFrame, o: QueryOptions) -> paths.Costs:
        return paths.EndCosts(self.edges.select("src", "tgt", "weight", "tokens"), self.node_vectors, queries, o.alpha, o.beta, o.gamma, super().path_costs(queries, o))


def build_index(documents: DataFrame, text: str = "text", size: int = 120, overlap: int = 20, embedder: Embedder | None = None, extractor: Extractor | None = None, chunker=None, reporter: Reporter | None = None) -> Index:
    """Documents to all tables of an index, with the offline chunker, extractor, reporter and embedder unless others are given."""
    return Built(documents, text, size, overlap, embedder, extractor, chunker, reporter)


def unit(c: str):
    """A vector column at length 1; the zero vector stays."""
    n = F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.col(c), lambda x: F.when(n > 0, x / n).otherwise(0.0))


def nearest(v: DataFrame, q: DataFrame, k: int, threshold: float) -> DataFrame:
    """query_id, id, score, dense_order: the k nearest of v(id string, vec) to each of q(query_id, qvec); equal scores by id."""
    return vectors.topk(v, q, k, threshold, "id", "vec")


def entity_hits(ix: Index, queries: DataFrame, o: QueryOptions, reranker=None) -> DataFrame:
    """query_id, node, dense_order, score: top_k x multiplier entities, reranked where asked for by the query's text (column query)
    and the entity's; the default reranker is vectors.word_maxsim."""
    h = nearest(ix.node_vectors, queries, o.top_k * o.multiplier, o.threshold).join(ix.nodes.select(F.col("entity_name").alias("id")), "id", "left_semi")
    if o.rerank:
        if "query" not in queries.columns:
            raise ValueError("reranking needs the queries' texts: column query")
        p = h.join(queries.select("query_id", "query"), "query_id").join(ix.nodes.select(F.col("entity_name").alias("id"), F.concat_ws(" ", "entity_name", "description").alias("text")), "id")
        s = vectors.rerank_scores(p.select("query_id", "id", "query", "text"), "query", "text", reranker).select("query_id", "id", "rerank_score")
        h = vectors.rerank(h, s, o.top_k * o.multiplier, o.rerank_top_n, "id").select("query_id", "id", F.col("final_order").alias("dense_order"), "score")
    return h.withColumnRenamed("id", "node")


def communities(ix: Index, hits: DataFrame, o: QueryOptions) -> DataFrame:
    """query_id, section rows of the communities of the hits up to the level, by number of hits, then rating."""
    m = hits.join(ix.members.filter(F.col("level") <= o.level), "node").groupBy("query_id", "level", "community").agg(F.count("*").alias("hits"))
    r = m.join(ix.reports, ["level", "community"])
    return chunking.token_budget(r, ["query_id"], [F.desc("hits"), F.desc(F.coalesce("rating", F.lit(-1.0))), "level", "community"], "tokens", o.community_budget)


def text_units(ix: Index, hits: DataFrame, o: QueryOptions) -> DataFrame:
    """query_id, chunk_id, dense_order, tokens, running_cost: chunks that cite the hits: by the first hit that cites them, then by how many of
    its edges' other ends also cite them.

    A hit's chunks are ranked once for all queries, and no more of them than a query can take are joined: what earlier hits have of
    them is within the budget too, or nothing is taken, so the list may end with the first chunk that goes over two budgets."""
    c = ix.chunk_relations(hits.select("node").distinct()).join(ix.chunks.select("chunk_id", "tokens"), "chunk_id")
    c = _leading(c, ["node"], [F.desc("relations"), "chunk_id"], 2 * o.text_budget)
    w = Window.partitionBy("query_id", "chunk_id").orderBy("dense_order", "node")
    x = hits.select("query_id", "node", "dense_order").join(c, "node").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return chunking.token_budget(x, ["query_id"], ["dense_order", F.desc("relations"), "chunk_id"], "tokens", o.text_budget)


def _leading(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The rows of each ranked list before which the tokens are at most `most`: the first that goes over stands too."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("ahead", F.coalesce(F.sum(F.coalesce("tokens", F.lit(0))).over(w), F.lit(0))).filter(F.col("ahead") <= most).drop("ahead")


def local_edges(ix: Index, hits: DataFrame, o: QueryOptions) -> DataFrame:
    """Edges at the hits by edge degree, then weight. A hit's edges are ranked once for all queries; those that go over the budget in
    its own list do so in a query's."""
    e = ix.edges.select("src", "tgt", "weight", "tokens", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("node")).join(hits.select("node").distinct(), "node", "left_semi")
    d = graph.degrees(ix.edges)
    e = e.join(d, "node").join(d.withColumnsRenamed({"node": "other", "degree": "more"}), F.when(F.col("node") == F.col("src"), F.col("tgt")).otherwise(F.col("src")) == F.col("other")).withColumn("edge_degree", F.col("degree") + F.col("more"))
    order = [F.desc("edge_degree"), F.desc("weight"), "src", "tgt"]
    e = _leading(e.select("node", "src", "tgt", "weight", "tokens", "edge_degree"), ["node"], order, o.local_budget)
    e = e.join(hits.select("query_id", "node"), "node").select("query_id", "src", "tgt", "weight", "tokens", "edge_degree").distinct()
    return chunking.token_budget(e, ["query_id"], order, "tokens", o.local_budget)


def key_entities(ix: Index, hits: DataFrame, o: QueryOptions) -> DataFrame:
    """query_id, keys: the top_m hits of each community, all in global order, each once."""
    m = hits.join(ix.members.filter(F.col("level") <= o.level), "node")
    w = Window.partitionBy("query_id", "level", "community").orderBy("dense_order")
    top = m.withColumn("m", F.row_number().over(w)).filter(F.col("m") <= o.top_m).groupBy("query_id", "node").agg(F.min("dense_order").alias("d"))
    return top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "node"))), lambda x: x["node"]).alias("keys"))  # at most top_k hits


def bridge(ix: Index, queries: DataFrame, keys: DataFrame, o: QueryOptions) -> tuple[DataFrame, DataFrame]:
    """(paths with their decisions, edges among the path's nodes within the budget)."""
    costs = ix.path_costs(queries, o) if o.paths.strategy not in ("none", "unweighted") else None
    p = cut(paths.bridge_paths(ix.edges.select("src", "tgt", "tokens"), keys, o.paths, costs))
    on = p.select("query_id", F.explode("path").alias("node")).distinct()
    # from the pairs of a path's nodes to the edges: a path has few nodes, a node may have very many edges
    pairs = on.withColumnRenamed("node", "src").join(on.withColumnRenamed("node", "tgt"), "query_id")
    e, d = ix.edges.select("src", "tgt", "weight", "tokens").join(pairs, ["src", "tgt"]), graph.degrees(ix.edges)
    e = e.join(d.withColumnsRenamed({"node": "src", "degree": "a"}), "src").join(d.withColumnsRenamed({"node": "tgt", "degree": "b"}), "tgt").withColumn("edge_degree", F.col("a") + F.col("b")).drop("a", "b")
    return p, chunking.token_budget(e, ["query_id"], [F.desc("edge_degree"), F.desc("weight"), "src", "tgt"], "tokens", o.bridge_budget)


def retrieve(ix: Index, queries: DataFrame, mode: str = "hi", o: QueryOptions = QueryOptions(), reranker: Reranker | None = None) -> DataFrame:
    """query_id (string), section, rank, item, tokens: the context of each query in a mode. queries: query_id, qvec, and query (its
    text) for the modes that rerank."""
    sections, strategy, rr = MODES[mode]
    o = replace(o, mode=mode, rerank=rr, paths=replace(o.paths, strategy=strategy))
    q = cut(queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec"), *(["query"] if rr and "query" in queries.columns else [])))
    out: list[DataFrame] = []

    def put(df: DataFrame, name: str, item, order: list) -> None:
        n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1
        out.append(df.select("query_id", F.lit(name).alias("section"), n.alias("rank"), item.alias("item"), F.col("tokens").cast("bigint").alias("tokens")))

    if "chunks" in sections:
        h = nearest(ix.chunk_vectors, q, o.top_k, o.threshold).withColumnRenamed("id", "chunk_id").join(ix.chunks, "chunk_id")
        put(chunking.token_budget(h, ["query_id"], ["dense_order"], "tokens", o.naive_budget), "chunks", F.col("chunk_id"), ["dense_order"])
    else:
        wide = cut(entity_hits(ix, q, o, reranker))
        hits = wide.filter(F.col("dense_order") < o.top_k)
        if "communities" in sections:
            put(communities(ix, hits, o), "communities", F.concat_ws("/", F.col("level").cast("string"), "community"), ["running_cost", "level", "community"])
        if "bridge" in sections:
            _, e = bridge(ix, q, key_entities(ix, hits, o), o)
            put(e, "bridge", F.concat_ws("|", "src", "tgt"), ["running_cost", "src", "tgt"])
        if "entities" in sections:
            d = graph.degrees(ix.edges)
            put(hits.join(ix.nodes.select(F.col("entity_name").alias("node"), "tokens"), "node").join(d, "node", "left"), "entities", F.col("node"), ["dense_order"])
        if "relations" in sections:
            put(local_edges(ix, hits, o), "relations", F.concat_ws("|", "src", "tgt"), ["running_cost", "src", "tgt"])
        if "sources" in sections:
            put(text_units(ix, hits, o), "sources", F.col("chunk_id"), ["running_cost", "chunk_id"])
    res = out[0]
    for x in out[1:]:
        res = res.unionByName(x)
    return res


def shrunk_attempts(sections: DataFrame, limit: int = 9000, factor: float = 0.7, attempts: int = 5) -> DataFrame:
    """query_id, attempt, scale, total, within: all attempts of shrinking every section's budget at once, and the first that fits
    (or the last). sections: query_id, section, running_cost, tokens, budget."""
    tries = F.transform(F.sequence(F.lit(1), F.lit(attempts)), lambda i: F.struct(i.alias("attempt"), F.pow(F.lit(factor), i - 1).alias("scale")))
    x = sections.withColumn("t", F.explode(tries)).filter(F.col("running_cost") <= F.floor(F.col("budget") * F.col("t.scale")))
    s = x.groupBy("query_id", "t.attempt", "t.scale").agg(F.sum("tokens").alias("total"))
    every = sections.select("query_id").distinct().withColumn("t", F.explode(tries)).select("query_id", "t.attempt", "t.scale").join(s, ["query_id", "attempt", "scale"], "left").fillna(0, ["total"])
    every = every.withColumn("within", F.col("total") <= limit)
    w = Window.partitionBy("query_id").orderBy(F.desc("within"), F.when(F.col("within"), F.col("attempt")).otherwise(-F.col("attempt")))
    return every.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def render(context: DataFrame, contents: DataFrame) -> DataFrame:
    """query_id, context: sections as comma-tab rows under headings. contents: section, item, text. A query's context is bounded by
    its budgets."""
    row = fr.csv_row(fr.csv_cell(F.col("rank"), True), fr.csv_cell(F.coalesce("text", "item")))
    x = context.join(contents, ["section", "item"], "left").withColumn("row", row)
    s = x.groupBy("query_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda r: r["row"]), "\n").alias("rows"))
    return s.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("-----"), F.initcap("section"), F.lit("-----\n"), F.col("rows")))), "\n\n").alias("context"))
