"""Summaries of clusters: their members, prompts, summary entities, their merge into the graph, and split plans.

A cluster's text is bounded by a token limit before anything is collected, so that a cluster of any size gives one bounded row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import records as fr
from loomgraph.operators import chunking, graph, hierarchy
from loomgraph.session import written

#: Members that a split plan names of each part, and kinds of entities it counts.
NAMED, KINDS = 10, 5


def cluster_nodes(nodes: DataFrame, key: str = "entity_name", clusters: str = "clusters") -> DataFrame:
    """level, cluster, node: from each node's JSON list of {level, cluster}; null and broken lists give nothing."""
    c = F.from_json(clusters, "array<struct<level: int, cluster: string>>")
    return nodes.select(F.col(key).alias("node"), F.explode(c).alias("c")).filter("c.level IS NOT NULL AND c.cluster IS NOT NULL").select("c.level", "c.cluster", "node").distinct()


def within_tokens(members: DataFrame, limit: int, keep: float = 0.8, seed: int = 0) -> DataFrame:
    """members (level, cluster, node, tokens) of the clusters cut to at most `limit` tokens: as often as a cluster is over the limit, a
    share `keep` of its members stays, at least one. Which ones is set by a hash of seed and node, so each cut is part of the one before
    it and all cuts of all clusters are found in one pass over the running sums."""
    w = Window.partitionBy("level", "cluster").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "node")), "node")
    x = members.withColumn("n", F.row_number().over(w)).withColumn("sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = members.groupBy("level", "cluster").agg(F.count("*").alias("size"))
    # sizes after 0, 1, 2, ... cuts, until one member is left
    cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.ln(F.col("size").cast("double")) / -F.log(F.lit(keep))) + 1), lambda i: F.greatest(F.lit(1), F.floor(F.col("size") * F.pow(F.lit(keep), i) + F.lit(1e-9)).cast("int")))
    sizes = size.select("level", "cluster", F.explode(F.array_distinct(cuts)).alias("n"))
    fits = sizes.join(x.select("level", "cluster", "n", "sum"), ["level", "cluster", "n"]).groupBy("level", "cluster").agg(F.max(F.when(F.col("sum") <= limit, F.col("n"))).alias("most"))
    return x.join(fits.select("level", "cluster", F.coalesce("most", F.lit(1)).alias("most")), ["level", "cluster"]).filter("n <= most").drop("n", "sum", "most")


def prompt_rows(members: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """level, cluster, n_described, text: '(name, description)' of the members in order of name, within `limit` tokens, joined by commas."""
    d = members.join(nodes.select(F.col("entity_name").alias("node"), F.coalesce("description", F.lit("")).alias("description")), "node")
    d = d.withColumn("line", F.concat(F.lit("("), F.col("node"), F.lit(", "), F.col("description"), F.lit(")"))).withColumn("tokens", fr.n_tokens(F.col("line")))
    kept = chunking.token_budget(d, ["level", "cluster"], ["node"], "tokens", limit)
    return kept.groupBy("level", "cluster").agg(F.count("*").alias("n_described"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "line"))), lambda x: x["line"]), ",").alias("text"))  # at most `limit` tokens


def summarize(members: DataFrame, shown: int = 6, anchors: int = 3) -> tuple[DataFrame, DataFrame]:
    """(summary entities: level, cluster, entity_name, entity_type, description; relations: level, cluster, src_id, tgt_id, description,
    weight) without a language model, from the clusters' first members by name. A cluster of one passes through without a summary."""
    w = Window.partitionBy("level", "cluster").orderBy("node")
    head = members.select("level", "cluster", "node").distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= shown)
    first = head.groupBy("level", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "node"))), lambda x: x["node"]).alias("names"))
    first = first.filter(F.size("names") > 1)
    # Fixed formats: names and texts of summary entities
    tokens = F.flatten(F.transform(F.slice("names", 1, anchors), lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0))))
    anchor = F.upper(F.array_join(F.slice(tokens, 1, 4), "_"))
    name = F.concat(F.lit("L"), F.col("level"), F.lit("_C"), F.col("cluster"), F.lit("_"), F.when(anchor == "", F.concat(F.lit("LAYER_"), F.col("level"))).otherwise(anchor))
    entities = first.select("level", "cluster", name.alias("entity_name"), F.lit("summary_entity").alias("entity_type"), F.concat(F.lit("Summary node for: "), F.array_join("names", ", "), F.lit(".")).alias("description"))
    pairs = members.select("level", "cluster", "node").distinct().join(entities.select("level", "cluster", "entity_name"), ["level", "cluster"])
    relations = pairs.select("level", "cluster", F.col("node").alias("src_id"), F.col("entity_name").alias("tgt_id"), F.concat("node", F.lit(" is summarized by "), "entity_name", F.lit(".")).alias("description"), F.lit(1.0).alias("weight"))
    return entities, relations


def apply_summaries(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts: added_nodes, added_edges) with the summaries merged in. nodes: entity_name, entity_type, description,
    source_id; edges: src, tgt, weight, description, source_id. What is new of a description or source is appended after <SEP>;
    weights add up (0 and null count as 1); endpoints without a node become UNKNOWN. Blank names and endpoints are left out."""
    source = F.concat(F.lit("cluster-"), F.col("level").cast("string"), F.lit("-"), F.col("cluster").cast("string"))
    new = entities.filter(F.coalesce(F.trim("entity_name"), F.lit("")) != "").select(F.trim("entity_name").alias("entity_name"), "entity_type", "description", source.alias("source_id"), F.struct(F.lit(1).alias("turn"), "level", "cluster").alias("at"))
    both = lambda c: F.least(F.trim("src_id"), F.trim("tgt_id")).alias("src") if c else F.greatest(F.trim("src_id"), F.trim("tgt_id")).alias("tgt")
    rel = relations.filter((F.coalesce(F.trim("src_id"), F.lit("")) != "") & (F.coalesce(F.trim("tgt_id"), F.lit("")) != ""))
    rel = rel.select(both(True), both(False), F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)).alias("weight"), "description", source.alias("source_id"), F.struct(F.lit(1).alias("turn"), "level", "cluster").alias("at"))
    none = F.struct(F.lit(0).alias("turn"), F.lit(None).cast(new.schema["at"].dataType["level"].dataType).alias("level"), F.lit(None).cast(new.schema["at"].dataType["cluster"].dataType).alias("cluster"))
    ends = rel.select(F.explode(F.array("src", "tgt")).alias("entity_name"), "source_id", "at")
    unknown = ends.join(nodes, "entity_name", "left_anti").join(new, "entity_name", "left_anti").groupBy("entity_name").agg(F.min_by("source_id", "at").alias("source_id")).select("entity_name", F.lit("UNKNOWN").alias("entity_type"), F.lit("").alias("description"), "source_id")
    rows = nodes.select("entity_name", "entity_type", "description", "source_id", none.alias("at")).unionByName(new)
    out_nodes = rows.groupBy("entity_name").agg(F.min_by("entity_type", "at").alias("entity_type"), joined("description"), joined("source_id")).unionByName(unknown)
    rows = edges.select("src", "tgt", "weight", "description", "source_id", none.alias("at")).unionByName(rel)
    out_edges = rows.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), joined("description"), joined("source_id"))
    n = new.select("entity_name").distinct().join(nodes, "entity_name", "left_anti").select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(unknown.select(F.lit(1), F.lit(0)))
    e = rel.select("src", "tgt").distinct().join(edges, ["src", "tgt"], "left_anti").select(F.lit(0), F.lit(1))
    return out_nodes, out_edges, n.unionAll(e).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("added_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("added_edges"))


def joined(column: str):
    """Distinct parts of the column in order of `at`, joined by <SEP>: distinct inside each task first, so repeats don't travel."""
    parts = F.array_sort(F.collect_set(F.struct(F.col("at"), F.col(column).alias("v"))))
    return F.array_join(fr.ordered_unique(F.flatten(F.transform(parts, lambda x: fr.sep_list(F.coalesce(x["v"], F.lit("")))))), fr.SEP).alias(column)


def split_candidates(balance: DataFrame, most: int) -> DataFrame:
    """The `most` communities that should be split, largest first, then of greatest entropy. balance: see graph.balance."""
    return balance.filter("should_split AND n_nodes > 2").orderBy(F.desc("n_nodes"), F.desc("entropy"), "community").limit(most)


def split_plan(balance: DataFrame, members: DataFrame, vectors: DataFrame, most: int = 20, parts: int = 49, fit: Callable = hierarchy.soft_clusters) -> DataFrame:
    """community, label, size, entropy, named, kinds: how each chosen community would be split, each member into its most probable part.
    members: community, node, kind; vectors: id, vec. A community's mixture is fitted over all its members, distributed."""
    out = None
    for r in split_candidates(balance, most).collect():  # at most `most` communities
        own = members.filter(F.col("community") == r.community)
        c = fit(own.join(vectors.withColumnRenamed("id", "node"), "node").select("node", "vec"), "node", "vec", min(parts, r.n_nodes - 1))
        label = c.groupBy("node").agg(F.max_by("cluster", F.struct("p", -F.col("cluster"))).alias("label"))
        x = written(own.join(label, "node"), "split")
        ent = graph.normalized_entropy(x, ["community", "label"], "kind").drop("kinds")
        n = Window.partitionBy("community", "label").orderBy("node")
        named = x.withColumn("n", F.row_number().over(n)).filter(F.col("n") <= NAMED).groupBy("community", "label").agg(F.sort_array(F.collect_list("node")).alias("named"))
        one = x.groupBy("community", "label").agg(F.count("*").alias("size")).join(ent, ["community", "label"]).join(named, ["community", "label"]).join(top_kinds(x, ["community", "label"]), ["community", "label"])
        out = one if out is None else out.unionByName(one)
    if out is not None:
        return out.select("community", "label", "size", F.round("entropy", 9).alias("entropy"), "named", "kinds")
    return members.limit(0).select("community", F.lit(0).alias("label"), F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("entropy"), F.array("node").alias("named"), F.array(F.struct("kind", F.lit(0).cast("bigint").alias("n"))).alias("kinds"))


def top_kinds(members: DataFrame, group: list[str], most: int = KINDS) -> DataFrame:
    """group, kinds: the most frequent kinds with their counts, ties by name."""
    c = members.groupBy(*group, "kind").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "kind"))).filter(F.col("r") <= most)
    return c.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "kind", "n"))), lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"))).alias("kinds"))
