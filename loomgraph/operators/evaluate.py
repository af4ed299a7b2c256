"""Evaluation: telemetry, traces, judgements, agreement, deltas, answer metrics, annotation packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import records as fr


def telemetry_rollup(df: DataFrame, stage: str, latency: str, cached: Column) -> DataFrame:
    """Per stage and in total (stage null): calls, cache hits, latency sum and mean."""
    return df.select(F.col(stage).alias("stage"), F.col(latency).alias("x"), cached.alias("hit")).rollup("stage").agg(F.count("*").alias("calls"), F.count_if("hit").alias("cache_hits"), F.sum("x").alias("latency_sum"), F.avg("x").alias("latency_mean"))


def means_by(df: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("n_rows"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def trace_summary(df: DataFrame, group: list[str], metrics: list[str], error: str = "error", stopped: str = "bridge_budget_stopped", within: str = "context_within_budget") -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(error).isNotNull()).alias("errors"), F.count_if(F.col(stopped)).alias("budget_stopped"),
        F.count_if(~F.col(within)).alias("out_of_budget"), *[F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in metrics],
    )


def budget_sweep(df: DataFrame, group: list[str]) -> DataFrame:
    """rows, within_budget_rate, mean and max input tokens, mean context tokens, bridge edges and path edges of each regime and variant."""
    return df.groupBy(*group).agg(
        F.count("*").alias("n_rows"), F.avg(F.col("context_within_budget").cast("double")).alias("within_budget_rate"), F.avg("input_tokens").alias("mean_input_tokens"), F.max("input_tokens").alias("max_input_tokens"),
        F.avg("context_tokens").alias("mean_context_tokens"), F.avg("bridge_edge_count").alias("mean_bridge_edges"), F.avg("bridge_path_edges").alias("mean_bridge_path_edges"),
    )


def evidence_shares(sections: DataFrame, key: str, group: list[str]) -> DataFrame:
    """group, section, mean_share, mean_tokens, n: how much of each text's tokens stand in a section, averaged over texts with any token.
    sections: key, group, section, tokens."""
    total = sections.groupBy(key).agg(F.sum("tokens").alias("total")).filter("total > 0")
    x = sections.join(total, key)
    return x.groupBy(*group, "section").agg(F.avg(F.col("tokens") / F.col("total")).alias("mean_share"), F.avg("tokens").alias("mean_tokens"), F.count("*").alias("n"))


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part (node or edge), kind, n of an exported property graph."""
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "kind", "n").unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "kind", "n"))


def graph_summary(entity_rows: DataFrame, relation_rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entity_records, relation_records, nodes, edges, unknown_nodes of a merged base graph."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(entity_rows, "entity_records")
    for x in (n(relation_rows, "relation_records"), n(edges, "edges"), nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("entity_type") == "UNKNOWN").alias("unknown_nodes"))):
        out = out.join(F.broadcast(x))  # one row each
    return out.select("entity_records", "relation_records", "nodes", "edges", "unknown_nodes")


def criterion_wins(verdicts: DataFrame, group: list[str], criteria: list[str], swapped) -> DataFrame:
    """group, criterion, n, first_wins, second_wins, first_rate, second_rate: wins of the two systems by criterion. verdicts hold 'Answer 1'
    or 'Answer 2' in each criterion's column; where `swapped` is true the second system's answer was shown first."""
    x = verdicts.select(*group, swapped.alias("swapped"), *criteria).unpivot([*group, "swapped"], criteria, "criterion", "winner")
    shown = F.when(F.col("winner") == "Answer 1", 1).when(F.col("winner") == "Answer 2", 2)
    won = F.when(F.col("swapped"), 3 - shown).otherwise(shown)
    g = x.select(*group, "criterion", won.alias("w")).groupBy(*group, "criterion").agg(F.count("*").alias("n"), F.count_if(F.col("w") == 1).alias("first_wins"), F.count_if(F.col("w") == 2).alias("second_wins"))
    return g.select("*", F.round(F.col("first_wins") / F.col("n"), 9).alias("first_rate"), F.round(F.col("second_wins") / F.col("n"), 9).alias("second_rate"))


def import_summary(df: DataFrame, group: list[str], kind: str, items: str, top: int = 20) -> DataFrame:
    """group, n_rows, errors, total and mean of `items` over rows without an error, and the most frequent kinds (kind, n), ties by name.
    df: group, error, items, kind."""
    base = df.groupBy(*group).agg(F.count("*").alias("n_rows"), F.count("error").alias("errors"), F.sum(F.when(F.col("error").isNull(), F.col(items))).alias("total"), F.avg(F.when(F.col("error").isNull(), F.col(items).cast("double"))).alias("mean"))
    c = df.filter("error IS NULL").groupBy(*group, F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "kind"))).filter(F.col("r") <= top)
    kinds = c.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "kind", "n"))), lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"))).alias("kinds"))
    return base.join(kinds, group, "left")


def change_rates(sparsity: DataFrame, group: list[str], level: str) -> DataFrame:
    """group, n, mean_change, min_change, max_change of the relative change of `sparsity` from level to level."""
    before = F.lag("sparsity").over(Window.partitionBy(*group).orderBy(level))
    x = sparsity.withColumn("change", F.when(before != 0, (F.col("sparsity") - before) / before)).filter("change IS NOT NULL")
    return x.groupBy(*group).agg(F.count("*").alias("n"), F.avg("change").alias("mean_change"), F.min("change").alias("min_change"), F.max("change").alias("max_change"))


def numbered(df: DataFrame, group: list[str], order: list, name: str = "number") -> DataFrame:
    """Rows counted from 0 inside each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def flatten_decisions(decisions: DataFrame, key: str) -> DataFrame:
    """Counts over the path decisions of each record: decisions, edges, by outcome. decisions: key, decision, path_edges."""
    has = lambda *names: F.count_if(F.col("decision").isin(*names))
    return decisions.groupBy(key).agg(
        F.count("*").alias("decisions"), F.coalesce(F.sum("path_edges"), F.lit(0)).alias("path_edges"), F.max("path_edges").alias("max_path_edges"),
        has("mcts").alias("mcts_success"), has("mcts_weighted_fallback").alias("mcts_fallback"), has("mcts_no_path").alias("mcts_no_path"),
        has("budget_stop").alias("budget_stop"), F.count_if(F.col("decision").endswith("_fallback")).alias("fallbacks"), has("no_path", "mcts_no_path").alias("no_path"),
    )


def flatten_searches(searches: DataFrame, key: str) -> DataFrame:
    """What the tree searches of each record took: their number, mean and greatest iterations, hops and nodes of the candidate graph, and how
    often the radius grew. searches: key, iterations, candidate_hops, candidate_nodes, radius_expanded."""
    pair = lambda c, name: [F.avg(c).alias(f"mean_{name}"), F.max(c).alias(f"max_{name}")]
    return searches.groupBy(key).agg(F.count("*").alias("searches"), *pair("iterations", "iterations"), *pair("candidate_hops", "hops"), *pair("candidate_nodes", "nodes"), F.count_if("radius_expanded").alias("radius_expanded"))


def judge_summary(df: DataFrame, group: list[str], outcome: Column, valid: Column) -> DataFrame:
    """valid, wins, losses, ties and rates. Rows with a parse error leave the denominator; unknown outcomes stay in it."""
    x = df.select(*group, outcome.alias("o"), valid.alias("ok"))
    n = F.count_if("ok")
    c = lambda v: F.count_if(F.col("ok") & (F.col("o") == v))
    return x.groupBy(*group).agg(n.alias("valid"), c("win").alias("wins"), c("loss").alias("losses"), c("tie").alias("ties"), F.when(n > 0, F.round((c("win") + 0.5 * c("tie")) / n, 9)).alias("win_rate"))


def strict_agreement(df: DataFrame, keys: list[str], winner: str) -> DataFrame:
    """A query counts only if all its orders name one winner."""
    g = df.groupBy(*keys).agg(F.count_distinct(winner).alias("n"), F.min(winner).alias("w"))
    return g.select(*keys, F.when(F.col("n") == 1, F.col("w")).otherwise("disagree").alias("strict_winner"))


def best_variant(df: DataFrame, group: list[str], wins: str, time: str, size: str, name: str) -> DataFrame:
    """Most wins; ties by less time, then smaller context, then name."""
    w = Window.partitionBy(*group).orderBy(F.desc(wins), F.asc_nulls_last(time), F.asc_nulls_last(size), name)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def deltas(df: DataFrame, keys: list[str], variant: str, base: str, metric: str) -> DataFrame:
    """Each variant's metric less the baseline's, on the same keys. df holds one row a key and variant."""
    b = df.filter(F.col(variant) == base).select(*keys, F.col(metric).alias("base"))
    return df.filter(F.col(variant) != base).join(b, keys).select(*keys, variant, (F.col(metric) - F.col("base")).alias("delta"))


def delta_summary(d: DataFrame, group: list[str]) -> DataFrame:
    return d.groupBy(*group).agg(F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"), F.count_if(F.col("delta") > 0).alias("n_positive"), F.count("*").alias("n"))


def pivoted(d: DataFrame, key: str, column: str, values: list, measure: str) -> DataFrame:
    return d.groupBy(key).pivot(column, values).agg(F.min(measure))


def melted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, columns, "metric", "value").filter("value IS NOT NULL")


def exact_match_f1(df: DataFrame, key: str, gold: str, guess: str) -> DataFrame:
    """em (equal after normalisation) and the F1 of the two multisets of normalised words. Words are counted in rows of their own, so long
    texts cost no more than their length; df's keys are unique."""
    g, p = fr.em_normal(F.coalesce(F.col(gold), F.lit(""))), fr.em_normal(F.coalesce(F.col(guess), F.lit("")))
    x = df.select(F.col(key), g.alias("g"), p.alias("p"))
    side = lambda c, i: F.transform(F.filter(F.split(c, " "), lambda t: t != ""), lambda t: F.struct(t.alias("w"), F.lit(i).alias("side")))
    w = x.select(key, F.explode(F.concat(side("g", 0), side("p", 1))).alias("x")).groupBy(key, "x.w").agg(F.count_if(F.col("x.side") == 0).alias("a"), F.count_if(F.col("x.side") == 1).alias("b"))
    s = w.groupBy(key).agg(F.sum(F.least("a", "b")).alias("s"), F.sum(F.col("a") + F.col("b")).alias("n"))
    z = x.select(key, (F.col("g") == F.col("p")).cast("int").alias("em")).join(s, key, "left")
    return z.select(key, "em", F.when(F.col("n") > 0, F.round(2 * F.col("s") / F.col("n"), 9)).otherwise(1.0).alias("f1"))


def chunk_set_jaccard(df: DataFrame, keys: list[str], variant: str, base: str, items: str) -> DataFrame:
    """Overlap of the item sets of each variant with the baseline's on the same keys. df: keys, variant, items array."""
    b = df.filter(F.col(variant) == base).select(*keys, F.array_distinct(items).alias("b"))
    x = df.filter(F.col(variant) != base).select(*keys, variant, F.array_distinct(items).alias("a")).join(b, keys)
    i, u = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return x.select(*keys, variant, i.cast("bigint").alias("overlap"), (F.size("a") - i).cast("bigint").alias("only_variant"), (F.size("b") - i).cast("bigint").alias("only_base"), F.when(u > 0, F.round(i / u, 9)).otherwise(0.0).alias("jaccard"))


def token_cost(df: DataFrame, group: list[str], tokens: str, price_per_million: float) -> DataFrame:
    return df.groupBy(*group).agg(F.sum(tokens).alias("tokens"), F.round(F.sum(tokens) / 1e6 * price_per_million, 9).alias("cost"))


def all_present(df: DataFrame, key: str, variant: str, wanted: list[str]) -> DataFrame:
    """Keys for which every wanted variant is there (relational division)."""
    return df.filter(F.col(variant).isin(*wanted)).groupBy(key).agg(F.count_distinct(variant).alias("n")).filter(F.col("n") == len(wanted)).select(key)


def cluster_sparsity(df: DataFrame, level: str, label: str) -> DataFrame:
    """1 - sum x(x-1) / (n(n-1)) of the label sizes, and the change from the level before."""
    s = df.groupBy(level, label).agg(F.count("*").alias("x")).groupBy(level).agg(F.sum("x").alias("n"), F.sum(F.col("x") * (F.col("x") - 1)).alias("p"), F.count("*").alias("clusters"))
    out = s.select(level, "n", "clusters", F.when(F.col("n") > 1, 1 - F.col("p") / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("sparsity"))
    before = F.lag("sparsity").over(Window.partitionBy().orderBy(level))  # one row a level
    return out.withColumn("change", F.when(before != 0, (F.col("sparsity") - before) / before))


def seeded_sample(df: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """A sample that depends on the key and the seed alone."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)))


def blind_labels(df: DataFrame, keys: list[str], variant: str, seed: int) -> DataFrame:
    """'Answer A', 'Answer B', ... in a seeded order of the variants of each key."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col(variant))), variant)
    n = F.row_number().over(w)
    return df.select(*keys, variant, F.concat(F.lit("Answer "), F.char(F.lit(64) + n)).alias("blind_label"))


def stratified(df: DataFrame, key: str, bucket: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """The first `sizes[bucket]` keys of each bucket in seeded order; a key is taken once."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    one = df.select(key, bucket).groupBy(key).agg(F.min(bucket).alias(bucket)).withColumn("h", h)
    w = Window.partitionBy(bucket).orderBy("h", key)
    want = F.coalesce(*[F.when(F.col(bucket) == b, F.lit(n)) for b, n in sizes.items()], F.lit(0))
    return one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= want).select(key, bucket)


def judge_orders(answers: DataFrame, key: list[str], variant: str, base: str) -> DataFrame:
    """Both orders of each comparison with the baseline: key, variant, order_id, first, second."""
    b = answers.filter(F.col(variant) == base).select(*key).distinct()
    x = answers.filter(F.col(variant) != base).select(*key, variant).distinct().join(b, key)
    orders = F.array(F.struct(F.lit(1).alias("order_id"), F.lit(base).alias("first"), F.col(variant).alias("second")), F.struct(F.lit(2).alias("order_id"), F.col(variant).alias("first"), F.lit(base).alias("second")))
    return x.select(*key, variant, F.explode(orders).alias("o")).select(*key, variant, "o.*")


def human_metrics(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").alias("n_votes"), F.round(F.avg("human_win_half_credit"), 9).alias("half_credit_win_rate"), F.round(F.avg("human_preference_gain"), 9).alias("mean_preference_gain"),
        F.round(F.avg("other_span_density"), 9).alias("mean_span_density"), F.round(F.avg(F.col("human_llm_agree_strict").cast("double")), 9).alias("llm_agreement"),
    )


def selected_queries(buckets: DataFrame, available: DataFrame, key: str, sizes: dict[str, int], total: int, seed: int) -> DataFrame:
    """key, bucket: the first sizes[bucket] available keys of each bucket by score, in the order of `sizes`, no key twice; then keys in
    seeded order until there are `total`, in a bucket called random. buckets: bucket, key, score."""
    left, out = available.select(key).distinct(), None
    for name, n in sizes.items():
        one = buckets.filter(F.col("bucket") == name).select(key, "score").join(left, key, "left_semi").orderBy(F.desc("score"), key).limit(n).select(key, F.lit(name).alias("bucket"))
        out = one if out is None else out.unionByName(one)
        left = left.join(one, key, "left_anti")
    rest = left.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(max(0, total - sum(sizes.values())))
    rest = rest.select(key, F.lit("random").alias("bucket"))
    return rest if out is None else out.unionByName(rest)


#: What an annotator fills in (fixed names of the packet's format).
ANNOTATED = ("does_answer_a_answer_question", "does_answer_b_answer_question", "preferred_answer", "useful_span_a", "useful_span_b", "notes")


def annotation_packet(answers: DataFrame, keys: list[str], variant: str, pairs: list[tuple[str, str]], seed: int) -> tuple[DataFrame, DataFrame]:
    """(packet, hidden): for each pair of variants and key with both, the two answers under blind labels, empty fields to fill in, and which
    variant is behind which label. answers: keys, variant, query, answer, one row a key and variant."""
    packet = None
    for a, b in pairs:
        x = answers.filter(F.col(variant).isin(a, b)).groupBy(*keys).agg(F.min("query").alias("query"), F.min(F.when(F.col(variant) == a, F.col("answer"))).alias("x"), F.min(F.when(F.col(variant) == b, F.col("answer"))).alias("y"), F.count_distinct(variant).alias("n")).filter("n = 2")
        x = x.select(*keys, F.lit(a).alias("left"), F.lit(b).alias("right"), "query", "x", "y")
        packet = x if packet is None else packet.unionByName(x)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "left", "right", *[F.col(k).cast("string") for k in keys]))
    p = packet.withColumn("flip", F.substring(h, 1, 1) >= "8").withColumn("packet", F.sha2(F.concat_ws("|", "left", "right", *[F.col(k).cast("string") for k in keys]), 256))
    pick = lambda u, v: F.when(F.col("flip"), F.col(v)).otherwise(F.col(u))
    shown = p.select(F.substring("packet", 1, 16).alias("packet_id"), *keys, F.concat_ws(" vs ", "left", "right").alias("comparison_pair"), "query", pick("x", "y").alias("answer_a"), pick("y", "x").alias("answer_b"), *[F.lit("").alias(c) for c in ANNOTATED])
    return shown, p.select(F.substring("packet", 1, 16).alias("packet_id"), *keys, pick("left", "right").alias("variant_a"), pick("right", "left").alias("variant_b"))


def rates_from_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, variant, win_rate: a report's '## variant' headings and the 'win rate: x' lines below them."""
    lines = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = F.when(F.col("line").rlike("^## "), F.trim(F.substring("line", 4, 1 << 30)))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("variant", F.last(head, True).over(w)).withColumn("win_rate", F.regexp_extract("line", r"(?i)win rate:[\s*]*([0-9.]+)", 1).try_cast("double"))
    return x.filter("variant IS NOT NULL AND win_rate IS NOT NULL").select(key, "variant", "win_rate")
