"""The pipeline that needs no model at all: entities and relations of chunks, merged in order of arrival, TF-IDF node vectors, and a
query that joins similar nodes, their communities, shortest bridges and the chunks that support both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators import graph, paths, vectors
from loomgraph.session import written


def _in_order(items: str, at: str = "pos"):
    """All items of array columns, once each, in order of arrival."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at, items))), lambda x: x[items])))


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """entity_name, entity_type, description (of the first mention), chunks and members (each once, in order), layer (the highest).
    mentions: pos, entity_name, entity_type, description, chunks array, layer, members array."""
    m = mentions.withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>"))).withColumn("members", F.coalesce("members", F.array().cast("array<string>")))
    return m.groupBy("entity_name").agg(F.min_by("entity_type", "pos").alias("entity_type"), F.min_by("description", "pos").alias("description"), _in_order("chunks").alias("chunks"), F.max("layer").alias("layer"), _in_order("members").alias("members"))


def upsert_relations(mentions: DataFrame) -> DataFrame:
    """src <= tgt, weight (sum), description (of the first mention), chunks (each once, in order).
    mentions: pos, src_id, tgt_id, description, weight, chunks array."""
    m = mentions.filter("src_id IS NOT NULL AND tgt_id IS NOT NULL").select("pos", F.least("src_id", "tgt_id").alias("src"), F.greatest("src_id", "tgt_id").alias("tgt"), "description", "weight", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))
    return m.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.min_by("description", "pos").alias("description"), _in_order("chunks").alias("chunks"))


def node_vectors(entities: DataFrame, features: int = 2048) -> DataFrame:
    """entity_name, term, weight: TF-IDF over all nodes' names and descriptions."""
    return vectors.tfidf(entities.select("entity_name", F.concat_ws(" ", "entity_name", "description").alias("t")), "entity_name", "t", features)


def similar_nodes(weights: DataFrame, entities: DataFrame, queries: DataFrame, top_k: int, features: int = 2048) -> DataFrame:
    """query_id, node, score, dense_order: cosine of the query's terms, weighted as the nodes' are, with every node's. queries: query_id,
    query. The nodes' vectors are sparse, so only shared terms are joined; nodes without any score 0 and fill up in order of name."""
    idf = weights.groupBy("term").agg(F.count("*").alias("df"))
    n = entities.agg(F.count("*").alias("n"))
    q = vectors.term_counts(queries, "query_id", "query").join(idf, "term").join(F.broadcast(n))  # one row
    q = q.select("query_id", "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    s = q.join(weights.select("entity_name", "term", "weight"), "term").groupBy("query_id", "entity_name").agg(F.sum(F.col("w") * F.col("weight")).alias("dot")).join(norm, "query_id")
    s = s.select("query_id", F.col("entity_name").alias("node"), F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    zero = entities.select(F.col("entity_name").alias("node")).orderBy("node").limit(2 * top_k)  # enough to fill any query's list
    fill = queries.select("query_id").distinct().join(zero).join(s, ["query_id", "node"], "left_anti").withColumn("score", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return s.unionByName(fill).withColumn("dense_order", F.row_number().over(w) - 1).filter(F.col("dense_order") < top_k)


def scored_communities(hits: DataFrame, members: DataFrame) -> DataFrame:
    """query_id, community, overlap, rank: communities by their number of hits; those without any are left out. members: community, node."""
    o = hits.join(members.select("community", "node").distinct(), "node").groupBy("query_id", "community").agg(F.count("*").alias("overlap"))
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "community")) - 1)


def key_nodes(hits: DataFrame, communities: DataFrame, members: DataFrame, top_m: int) -> DataFrame:
    """query_id, keys: the top_m hits of each community in the communities' order, each node once; without communities the first hits."""
    m = communities.join(members.select("community", "node").distinct(), "community").join(hits.select("query_id", "node", "dense_order"), ["query_id", "node"])
    m = m.withColumn("m", F.row_number().over(Window.partitionBy("query_id", "community").orderBy("dense_order"))).filter(F.col("m") <= top_m)
    first = m.groupBy("query_id", "node").agg(F.min(F.struct("rank", "dense_order")).alias("at"))
    lone = hits.join(first.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("dense_order") < top_m).select("query_id", "node", F.struct(F.lit(0).cast("int").alias("rank"), "dense_order").alias("at"))
    return first.unionByName(lone).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("keys"))  # at most top_k hits


def bridge_pairs(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """query_id, src, tgt, pos: the edges of the shortest paths between consecutive keys, each once, in order; unreachable ones skipped."""
    seg = paths.segments(keys)
    p = paths.shortest_paths(edges, seg)
    step = F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("tgt")))
    e = p.select("query_id", "seg", F.posexplode(step).alias("i", "e")).groupBy("query_id", "e.src", "e.tgt").agg(F.min(F.struct("seg", "i")).alias("at"))
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1).select("query_id", "src", "tgt", "pos")


def supporting_chunks(hits: DataFrame, pairs: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, pos: the chunks of the hits, then those of the bridges, each once and only existing ones."""
    a = hits.join(entities.select(F.col("entity_name").alias("node"), "chunks"), "node").select("query_id", F.lit(0).alias("part"), F.col("dense_order").cast("bigint").alias("n"), F.posexplode("chunks").alias("i", "chunk_id"))
    b = pairs.join(relations.select("src", "tgt", "chunks"), ["src", "tgt"]).select("query_id", F.lit(1).alias("part"), F.col("pos").cast("bigint").alias("n"), F.posexplode("chunks").alias("i", "chunk_id"))
    c = a.unionByName(b).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("query_id", "chunk_id").agg(F.min(F.struct("part", "n", "i")).alias("at"))
    return c.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id")) - 1).select("query_id", "chunk_id", "pos")


def shared_chunks(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """src, tgt, chunks: the chunks in which both ends of each pair stand, in the order of the entities'."""
    end = lambda c, name: entities.select(F.col("entity_name").alias(c), F.col("chunks").alias(name))
    return pairs.select("src", "tgt").distinct().join(end("src", "a"), "src").join(end("tgt", "b"), "tgt").select("src", "tgt", F.array_intersect("a", "b").alias("chunks"))


def retrieve(entities: DataFrame, relations: DataFrame, members: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int = 20, top_m: int = 10) -> DataFrame:
    """query_id, section (entities, communities, bridges, chunks), rank, item: the context of every query. queries: query_id, query. Relations
    without a column chunks are co-occurrences: theirs are the chunks that both ends share."""
    entities, members = written(entities, "entities"), written(members, "members")
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    hits = graph.cut(similar_nodes(written(node_vectors(entities), "terms"), entities, q, top_k))
    com = graph.cut(scored_communities(hits, members))
    pairs = graph.cut(bridge_pairs(relations.select("src", "tgt"), key_nodes(hits, com, members, top_m)))
    if "chunks" not in relations.columns:
        relations = shared_chunks(pairs, entities)
    parts = [
        ("entities", hits.select("query_id", F.col("dense_order").alias("rank"), F.col("node").alias("item"))),
        ("communities", com.select("query_id", "rank", F.col("community").alias("item"))),
        ("bridges", pairs.select("query_id", F.col("pos").alias("rank"), F.concat_ws("|", "src", "tgt").alias("item"))),
        ("chunks", supporting_chunks(hits, pairs, entities, relations, chunks).select("query_id", F.col("pos").alias("rank"), F.col("chunk_id").alias("item"))),
    ]
    out = None
    for name, df in parts:
        x = df.select("query_id", F.lit(name).alias("section"), F.col("rank").cast("int").alias("rank"), "item")
        out = x if out is None else out.unionByName(x)
    return out
