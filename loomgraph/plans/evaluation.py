"""Queries of the evaluation layer, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import records as fr
from loomgraph.functions.text import fold_name
from loomgraph.operators import batchio, evaluate, extract, limits, nested
from loomgraph.operators.order import positions
from loomgraph.plans.general import _P1, _text
from loomgraph.plans.registry import Registry
from loomgraph.plans.text import WORDS
from loomgraph.session import table

R = Registry()
M = "retrieval_trace_metrics"
METRICS = ["latency_seconds", "input_tokens", "context_tokens", "context_input_tokens", "local_entity_count", "community_count", "bridge_edge_count", "bridge_path_nodes", "bridge_path_edges", "mean_edge_cost", "max_edge_cost", "mean_edge_score", "bridge_budget_fallbacks", "budget_attempt_count"]
_MEANS = ", ".join(f"avg({m}::DOUBLE) AS mean_{m}" for m in METRICS)
_FOLD = lambda c: f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '[-\\s]', '_', 'g')"
#: One row a query and variant: the mean over deliveries.
_QV = f"(SELECT dataset, query_id, variant, avg(context_tokens) AS x FROM {M} WHERE variant IS NOT NULL AND query_id IS NOT NULL GROUP BY 1, 2, 3)"


def per_query(s, d):
    return table(s, d, M).filter("variant IS NOT NULL AND query_id IS NOT NULL").groupBy("dataset", "query_id", "variant").agg(F.avg("context_tokens").alias("x"))


R.add("telemetry_rollup", """SELECT event_type AS stage, count(*) AS calls, count(*) FILTER (WHERE user_id % 2 = 0) AS cache_hits, round(sum(value), 6) AS latency_sum, round(avg(value), 6) AS latency_mean FROM events GROUP BY ROLLUP (event_type)""")(
    lambda s, d: evaluate.telemetry_rollup(table(s, d, "events"), "event_type", "value", F.col("user_id") % 2 == 0).withColumn("latency_sum", F.round("latency_sum", 6)).withColumn("latency_mean", F.round("latency_mean", 6))
)
R.add("benchmark_means", f"SELECT variant, count(*) AS n_rows, {_MEANS} FROM {M} GROUP BY 1")(lambda s, d: evaluate.means_by(table(s, d, M), ["variant"], METRICS))
R.add("trace_summary", f"""SELECT dataset, variant, count(*) AS n_rows, count(error) AS errors, count(*) FILTER (WHERE bridge_budget_stopped) AS budget_stopped, count(*) FILTER (WHERE NOT context_within_budget) AS out_of_budget, {_MEANS} FROM {M} GROUP BY 1, 2""")(
    lambda s, d: evaluate.trace_summary(table(s, d, M), ["dataset", "variant"], METRICS)
)
R.add("judge_summary", f"""SELECT o AS variant, count(*) FILTER (WHERE l IS NOT NULL) AS valid, count(*) FILTER (WHERE l = 'other_win') AS wins, count(*) FILTER (WHERE l = 'baseline_win') AS losses, count(*) FILTER (WHERE l = 'tie') AS ties,
  CASE WHEN count(l) > 0 THEN round((count(*) FILTER (WHERE l = 'other_win') + 0.5::DOUBLE * count(*) FILTER (WHERE l = 'tie')) / count(l), 9) END AS win_rate
  FROM (SELECT {_FOLD('other_variant')} AS o, llm_strict_outcome AS l FROM human_annotation_pairwise_vs_hi) GROUP BY 1""")(
    lambda s, d: evaluate.judge_summary(table(s, d, "human_annotation_pairwise_vs_hi").withColumn("variant", fold_name(F.col("other_variant"))), ["variant"], F.when(F.col("llm_strict_outcome") == "other_win", "win").when(F.col("llm_strict_outcome") == "baseline_win", "loss").otherwise(F.col("llm_strict_outcome")), F.col("llm_strict_outcome").isNotNull())
)
R.add("strict_agreement", f"""SELECT dataset, query_id, variant, CASE WHEN count(DISTINCT w) = 1 THEN min(w) ELSE 'disagree' END AS strict_winner
  FROM (SELECT dataset, query_id, {_FOLD('other_variant')} AS variant, human_outcome AS w FROM human_annotation_pairwise_vs_hi) GROUP BY 1, 2, 3""")(
    lambda s, d: evaluate.strict_agreement(table(s, d, "human_annotation_pairwise_vs_hi").select("dataset", "query_id", fold_name(F.col("other_variant")).alias("variant"), "human_outcome"), ["dataset", "query_id", "variant"], "human_outcome")
)
R.add("best_variant", """SELECT dataset, baseline, variant, wins FROM (SELECT *, row_number() OVER (PARTITION BY dataset, baseline ORDER BY raw_wins_vs_hi DESC, mean_retrieval_time_seconds ASC NULLS LAST, mean_context_tokens ASC NULLS LAST, variant) AS r, raw_wins_vs_hi AS wins FROM core7_consolidated_results WHERE raw_wins_vs_hi IS NOT NULL) WHERE r = 1""")(
    lambda s, d: evaluate.best_variant(table(s, d, "core7_consolidated_results").filter("raw_wins_vs_hi IS NOT NULL"), ["dataset", "baseline"], "raw_wins_vs_hi", "mean_retrieval_time_seconds", "mean_context_tokens", "variant").select("dataset", "baseline", "variant", F.col("raw_wins_vs_hi").alias("wins"))
)
_DELTA = f"(SELECT a.dataset, a.query_id, a.variant, a.x - b.x AS delta FROM {_QV} a JOIN {_QV} b ON a.dataset = b.dataset AND a.query_id = b.query_id AND b.variant = 'hi' WHERE a.variant <> 'hi')"
R.add("delta_vs_baseline", f"SELECT dataset, query_id, variant, round(delta, 6) AS delta FROM {_DELTA}")(lambda s, d: evaluate.deltas(per_query(s, d), ["dataset", "query_id"], "variant", "hi", "x").withColumn("delta", F.round("delta", 6)))
R.add("delta_summary", f"SELECT variant, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, count(*) FILTER (WHERE delta > 0) AS n_positive, count(*) AS n FROM {_DELTA} GROUP BY 1")(
    lambda s, d: evaluate.delta_summary(evaluate.deltas(per_query(s, d), ["dataset", "query_id"], "variant", "hi", "x"), ["variant"]).withColumn("mean_delta", F.round("mean_delta", 6)).withColumn("median_delta", F.round("median_delta", 6))
)
_V = ["naive", "hi_local", "hi_global", "hi_nobridge", "hi_bridge", "hi", "hi_weighted", "hi_minmax", "hi_minmax_budgeted", "hi_mcts", "hi_rerank", "hi_rerank_weighted"]
R.add("delta_pivot", f"SELECT query_id, {', '.join(f'''min(x) FILTER (WHERE variant = '{v}') AS {v}''' for v in _V)} FROM {_QV} GROUP BY 1")(lambda s, d: evaluate.pivoted(per_query(s, d), "query_id", "variant", _V, "x"))
R.add("metrics_unpivot", f"""SELECT delivery_id, metric, value FROM (SELECT delivery_id, unnest([{', '.join(f"'{m}'" for m in METRICS)}]) AS metric, unnest([{', '.join(f'{m}::DOUBLE' for m in METRICS)}]) AS value FROM {M}) WHERE value IS NOT NULL""")(
    lambda s, d: evaluate.melted(table(s, d, M).select("delivery_id", *[F.col(m).cast("double") for m in METRICS]), ["delivery_id"], METRICS)
)
R.add("em_f1_titles", """WITH t AS (SELECT o_orderkey AS k, lower(o_orderpriority) AS g, lower(o_orderstatus || ' ' || o_orderpriority) AS p FROM orders),
  n AS (SELECT k, trim(regexp_replace(regexp_replace(g, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS g, trim(regexp_replace(regexp_replace(p, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS p FROM t),
  w AS (SELECT k, g, p, string_split(g, ' ') AS a, string_split(p, ' ') AS b FROM n)
  SELECT k AS o_orderkey, (g = p)::INTEGER AS em, round(2 * list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda t: least(len(list_filter(a, lambda u: u = t)), len(list_filter(b, lambda u: u = t))))) / (len(a) + len(b)), 9) AS f1 FROM w""")(
    lambda s, d: evaluate.exact_match_f1(table(s, d, "orders").withColumn("guess", F.concat_ws(" ", "o_orderstatus", "o_orderpriority")), "o_orderkey", "o_orderpriority", "guess")
)
R.add("source_overlap_jaccard", f"""WITH x AS (SELECT dataset, query_id, variant, list_distinct(list(run_id)) AS a FROM {M} WHERE variant IS NOT NULL AND query_id IS NOT NULL GROUP BY 1, 2, 3),
  y AS (SELECT v.dataset, v.query_id, v.variant, v.a, b.a AS b FROM x v JOIN x b ON v.dataset = b.dataset AND v.query_id = b.query_id AND b.variant = 'naive' WHERE v.variant <> 'naive')
  SELECT dataset, query_id, variant, len(list_intersect(a, b))::BIGINT AS overlap, (len(a) - len(list_intersect(a, b)))::BIGINT AS only_variant, (len(b) - len(list_intersect(a, b)))::BIGINT AS only_base, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard FROM y""")(
    lambda s, d: evaluate.chunk_set_jaccard(table(s, d, M).filter("variant IS NOT NULL AND query_id IS NOT NULL").groupBy("dataset", "query_id", "variant").agg(F.collect_set("run_id").alias("i")), ["dataset", "query_id"], "variant", "naive", "i")
)
R.add("token_cost", f"SELECT dataset, variant, sum(context_tokens)::BIGINT AS tokens, round(sum(context_tokens) / 1e6 * 0.75::DOUBLE, 9) AS cost FROM {M} GROUP BY 1, 2")(lambda s, d: evaluate.token_cost(table(s, d, M), ["dataset", "variant"], "context_tokens", 0.75))
R.add("all_variants_present", f"""SELECT query_id FROM {M} WHERE variant IN ('hi', 'naive', 'hi_mcts', 'hi_minmax') GROUP BY 1 HAVING count(DISTINCT variant) = 4""")(lambda s, d: evaluate.all_present(table(s, d, M), "query_id", "variant", ["hi", "naive", "hi_mcts", "hi_minmax"]))
R.add("resume_anti_join", f"""SELECT answer_id FROM answers a WHERE NOT EXISTS (SELECT 1 FROM {M} m WHERE m.run_id = a.run_id AND m.query_id = a.query_id AND m.variant = a.variant)""")(
    lambda s, d: batchio.resume(table(s, d, "answers").select("answer_id", "run_id", "query_id", "variant"), table(s, d, M), ["run_id", "query_id", "variant"]).select("answer_id")
)
R.add("retry_selection", """SELECT DISTINCT run_id, custom_id FROM batch_errors WHERE custom_id IS NOT NULL AND (error IS NOT NULL OR response.status_code >= 400)""")(
    lambda s, d: batchio.retryable(table(s, d, "batch_errors")).select("run_id", "custom_id").distinct()
)
R.add("batch_status_summary", """SELECT response.status_code AS status_code, count(*) AS n_rows, count(error) AS errors, count(DISTINCT custom_id) AS ids FROM batch_errors GROUP BY 1""")(
    lambda s, d: table(s, d, "batch_errors").groupBy(F.col("response.status_code").alias("status_code")).agg(F.count("*").alias("n_rows"), F.count("error").alias("errors"), F.count_distinct("custom_id").alias("ids"))
)
R.add("cluster_sparsity", """WITH x AS (SELECT level, label, count(*) AS x FROM (SELECT vec_id % 4 AS level, (label % (vec_id % 4 + 2)) AS label FROM embeddings) GROUP BY 1, 2), s AS (SELECT level, sum(x)::BIGINT AS n, count(*) AS clusters, 1 - sum(x * (x - 1)) / (sum(x) * (sum(x) - 1)) AS sparsity FROM x GROUP BY 1)
  SELECT level, n, clusters, round(sparsity, 9) AS sparsity, round((sparsity - lag(sparsity) OVER (ORDER BY level)) / lag(sparsity) OVER (ORDER BY level), 9) AS change FROM s""")(
    lambda s, d: evaluate.cluster_sparsity(table(s, d, "embeddings").select((F.col("vec_id") % 4).alias("level"), (F.col("label") % (F.col("vec_id") % 4 + 2)).alias("label")), "level", "label").withColumn("sparsity", F.round("sparsity", 9)).withColumn("change", F.round("change", 9))
)
R.add("blind_labels", """SELECT dataset, query_id, variant, 'Answer ' || chr(64 + row_number() OVER (PARTITION BY dataset, query_id ORDER BY md5('7|' || dataset || '|' || query_id::VARCHAR || '|' || variant), variant)::INTEGER) AS blind_label FROM (SELECT DISTINCT dataset, query_id, variant FROM answers WHERE variant IS NOT NULL AND query_id IS NOT NULL AND dataset IS NOT NULL)""")(
    lambda s, d: evaluate.blind_labels(table(s, d, "answers").select("dataset", "query_id", "variant").filter("dataset IS NOT NULL AND query_id IS NOT NULL AND variant IS NOT NULL").distinct(), ["dataset", "query_id"], "variant", 7)
)
R.add("stratified_queries", """WITH one AS (SELECT query_id, min(dataset) AS dataset FROM answers WHERE query_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('7|' || query_id::VARCHAR), query_id) AS r FROM one)
  SELECT query_id, dataset FROM r WHERE r <= CASE dataset WHEN 'agriculture' THEN 10 WHEN 'cs' THEN 5 WHEN 'legal' THEN 5 ELSE 0 END""")(
    lambda s, d: evaluate.stratified(table(s, d, "answers").filter("query_id IS NOT NULL"), "query_id", "dataset", {"agriculture": 10, "cs": 5, "legal": 5}, 7)
)
R.add("judge_orders", """WITH a AS (SELECT DISTINCT run_id, query_id, variant FROM answers WHERE variant IS NOT NULL AND query_id IS NOT NULL), p AS (SELECT v.* FROM a v JOIN a b ON v.run_id = b.run_id AND v.query_id = b.query_id AND b.variant = 'hi' WHERE v.variant <> 'hi')
  SELECT run_id, query_id, variant, 1 AS order_id, 'hi' AS first, variant AS second FROM p UNION ALL SELECT run_id, query_id, variant, 2, variant, 'hi' FROM p""")(
    lambda s, d: evaluate.judge_orders(table(s, d, "answers").filter("variant IS NOT NULL AND query_id IS NOT NULL"), ["run_id", "query_id"], "variant", "hi")
)
R.add("human_metrics", f"""SELECT variant, count(*) AS n_votes, round(avg(human_win_half_credit), 9) AS half_credit_win_rate, round(avg(human_preference_gain), 9) AS mean_preference_gain, round(avg(other_span_density), 9) AS mean_span_density, round(avg(human_llm_agree_strict::INTEGER::DOUBLE), 9) AS llm_agreement
  FROM (SELECT *, {_FOLD('other_variant')} AS variant FROM human_annotation_pairwise_vs_hi) GROUP BY 1""")(
    lambda s, d: evaluate.human_metrics(table(s, d, "human_annotation_pairwise_vs_hi").withColumn("variant", fold_name(F.col("other_variant"))), ["variant"])
)
R.add("answer_tokens", f"""SELECT variant, sum(len({WORDS('answer')}))::BIGINT AS answer_tokens FROM answers GROUP BY 1""")(
    lambda s, d: table(s, d, "answers").groupBy("variant").agg(F.sum(fr.n_tokens(F.col("answer"))).alias("answer_tokens"))
)
R.add("queries_numeric_order", """SELECT query_id, row_number() OVER (ORDER BY query_id, dataset) - 1 AS ord, dataset FROM (SELECT DISTINCT query_id, dataset FROM answers WHERE query_id IS NOT NULL)""")(
    lambda s, d: positions(table(s, d, "answers").filter("query_id IS NOT NULL").select("query_id", "dataset").distinct(), [F.asc("query_id"), F.asc("dataset")], "ord")
)
R.add("event_stage_shares", """SELECT event_type AS stage, round(sum(value) / sum(sum(value)) OVER (), 9) AS share FROM events GROUP BY 1""")(
    lambda s, d: (lambda g: g.join(F.broadcast(g.agg(F.sum("v").alias("t")))).select("stage", F.round(F.col("v") / F.col("t"), 9).alias("share")))(table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("v")))
)
R.add("telemetry_windows", """SELECT date_trunc('hour', ts) AS hour, event_type AS stage, count(*) AS calls, round(sum(value), 6) AS latency_sum FROM events GROUP BY 1, 2""")(
    lambda s, d: table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 6).alias("latency_sum"))
)
R.add("related_communities_vote", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
  h AS (SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv) DESC, vec_id) AS r FROM embeddings, q WHERE list_cosine_similarity(embedding::DOUBLE[], qv) >= 0.2),
  v AS (SELECT query_id, label::BIGINT AS community, count(*) AS hits FROM h WHERE r <= 20 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, community) AS rank FROM v""")(
    lambda s, d: vote(s, d)
)


def vote(s, d):
    from loomgraph.operators import vectors

    e = table(s, d, "embeddings")
    h = vectors.topk(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), 20)
    v = h.join(e.select("vec_id", F.col("label").cast("bigint").alias("community")), "vec_id").groupBy("query_id", "community").agg(F.count("*").alias("hits"))
    return v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "community")).cast("bigint"))


R.add("chat_token_estimate", """SELECT run_id, (sum(coalesce(input_tokens, 0) + 4) + 2)::BIGINT AS estimate FROM retrieval_trace_metrics GROUP BY 1""")(
    lambda s, d: limits.chat_tokens(table(s, d, M).select("run_id", F.coalesce("input_tokens", F.lit(0)).alias("t")), "run_id", "t")
)
R.add("clamped_outputs", """SELECT delivery_id, greatest(1, least(4096, 16384 - input_tokens - 2048)) AS cap FROM retrieval_trace_metrics WHERE input_tokens IS NOT NULL""")(
    lambda s, d: table(s, d, M).filter("input_tokens IS NOT NULL").select("delivery_id", limits.clamped_output(F.lit(4096), F.lit(16384), F.col("input_tokens")).alias("cap"))
)
R.add("budget_sweep", f"""SELECT dataset, variant, count(*) AS n_rows, avg(context_within_budget::INTEGER::DOUBLE) AS within_budget_rate, avg(input_tokens::DOUBLE) AS mean_input_tokens, max(input_tokens) AS max_input_tokens, avg(context_tokens::DOUBLE) AS mean_context_tokens,
  avg(bridge_edge_count::DOUBLE) AS mean_bridge_edges, avg(bridge_path_edges::DOUBLE) AS mean_bridge_path_edges FROM {M} GROUP BY 1, 2""")(lambda s, d: evaluate.budget_sweep(table(s, d, M), ["dataset", "variant"]))
_LINES = """(SELECT answer_id, dataset, variant, i, l, CASE WHEN regexp_matches(l, '^#+ ') THEN regexp_replace(l, '^#+ ', '') END AS head FROM (SELECT answer_id, dataset, variant, unnest(range(len(string_split(answer, chr(10))))) AS i, unnest(string_split(answer, chr(10))) AS l FROM answers WHERE answer IS NOT NULL))"""
_SECTIONS = f"""(SELECT answer_id, dataset, variant, section, sum(CASE WHEN head IS NULL THEN len({WORDS('l')}) ELSE 0 END) AS tokens FROM (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY answer_id ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS section FROM {_LINES}) GROUP BY 1, 2, 3, 4)"""
R.add("evidence_shares", f"""WITH x AS {_SECTIONS}, t AS (SELECT answer_id, sum(tokens) AS total FROM x GROUP BY 1 HAVING sum(tokens) > 0) SELECT dataset, variant, section, round(avg(tokens / total), 9) AS mean_share, round(avg(tokens), 9) AS mean_tokens, count(*) AS n FROM x JOIN t USING (answer_id) GROUP BY 1, 2, 3""")(
    lambda s, d: evaluate.evidence_shares(extract.section_tokens(table(s, d, "answers"), "answer_id", "answer").join(table(s, d, "answers").select("answer_id", "dataset", "variant"), "answer_id"), "answer_id", ["dataset", "variant"]).withColumn("mean_share", F.round("mean_share", 9)).withColumn("mean_tokens", F.round("mean_tokens", 9))
)
R.add("criterion_wins", """WITH v AS (SELECT dataset, packet_id % 2 = 1 AS swapped, CASE human_outcome WHEN 'other_win' THEN 'Answer 1' WHEN 'baseline_win' THEN 'Answer 2' ELSE 'tie' END AS preference, CASE llm_strict_outcome WHEN 'other_win' THEN 'Answer 1' WHEN 'baseline_win' THEN 'Answer 2' END AS judge FROM human_annotation_pairwise_vs_hi),
  u AS (SELECT dataset, 'preference' AS criterion, swapped, preference AS w FROM v UNION ALL SELECT dataset, 'judge', swapped, judge FROM v),
  c AS (SELECT dataset, criterion, count(*) AS n, count(*) FILTER (WHERE (w = 'Answer 1' AND NOT swapped) OR (w = 'Answer 2' AND swapped)) AS first_wins, count(*) FILTER (WHERE (w = 'Answer 2' AND NOT swapped) OR (w = 'Answer 1' AND swapped)) AS second_wins FROM u GROUP BY 1, 2)
  SELECT *, round(first_wins / n, 9) AS first_rate, round(second_wins / n, 9) AS second_rate FROM c""")(lambda s, d: _criteria(s, d))  # fmt: skip


def _criteria(s, d):
    said = lambda c: F.when(F.col(c) == "other_win", "Answer 1").when(F.col(c) == "baseline_win", "Answer 2")
    v = table(s, d, "human_annotation_pairwise_vs_hi").select("dataset", "packet_id", F.coalesce(said("human_outcome"), F.lit("tie")).alias("preference"), said("llm_strict_outcome").alias("judge"))
    return evaluate.criterion_wins(v, ["dataset"], ["preference", "judge"], F.col("packet_id") % 2 == 1)


R.add("import_summary", """WITH b AS (SELECT variant, count(*) AS n_rows, count(error) AS errors, sum(length(answer)) FILTER (WHERE error IS NULL)::BIGINT AS total, round(avg(length(answer)::DOUBLE) FILTER (WHERE error IS NULL), 9) AS mean FROM answers GROUP BY 1),
  c AS (SELECT variant, dataset, count(*) AS n FROM answers WHERE error IS NULL GROUP BY 1, 2), k AS (SELECT variant, string_agg(coalesce(dataset, '-') || ':' || n::VARCHAR, ',' ORDER BY r) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY n DESC, dataset NULLS FIRST) AS r FROM c) WHERE r <= 2 GROUP BY 1)
  SELECT b.variant, n_rows, errors, total, mean, kinds FROM b LEFT JOIN k ON b.variant = k.variant""")(
    lambda s, d: evaluate.import_summary(table(s, d, "answers").select("variant", "error", F.length("answer").cast("bigint").alias("items"), "dataset"), ["variant"], "dataset", "items", 2).withColumn("mean", F.round("mean", 9)).withColumn("kinds", F.array_join(F.transform("kinds", lambda k: F.concat(F.coalesce(k["kind"], F.lit("-")), F.lit(":"), k["n"].cast("string"))), ","))
)
_SPARSE = "(SELECT g, level, 1 - sum(x * (x - 1)) / (sum(x) * (sum(x) - 1)) AS sparsity FROM (SELECT vec_id % 3 AS g, vec_id % 4 AS level, label % (vec_id % 4 + 2) AS label, count(*) AS x FROM embeddings GROUP BY 1, 2, 3) GROUP BY 1, 2)"
R.add("sparsity_change_rates", f"""WITH c AS (SELECT g, (sparsity - lag(sparsity) OVER w) / nullif(lag(sparsity) OVER w, 0) AS change FROM {_SPARSE} WINDOW w AS (PARTITION BY g ORDER BY level))
  SELECT g, count(*) AS n, round(avg(change), 9) AS mean_change, round(min(change), 9) AS min_change, round(max(change), 9) AS max_change FROM c WHERE change IS NOT NULL GROUP BY 1""")(lambda s, d: _changes(s, d))


def _changes(s, d):
    x = table(s, d, "embeddings").select((F.col("vec_id") % 3).alias("g"), (F.col("vec_id") % 4).alias("level"), (F.col("label") % (F.col("vec_id") % 4 + 2)).alias("label")).groupBy("g", "level", "label").agg(F.count("*").alias("x"))
    sp = x.groupBy("g", "level").agg((1 - F.sum(F.col("x") * (F.col("x") - 1)) / (F.sum("x") * (F.sum("x") - 1))).alias("sparsity"))
    out = evaluate.change_rates(sp, ["g"], "level")
    return out.select("g", "n", *[F.round(c, 9).alias(c) for c in ("mean_change", "min_change", "max_change")])


R.add("variant_row_numbers", "SELECT answer_id, variant, row_number() OVER (PARTITION BY variant ORDER BY answer_id) - 1 AS number FROM answers")(
    lambda s, d: evaluate.numbered(table(s, d, "answers").select("answer_id", "variant"), ["variant"], ["answer_id"]).withColumn("number", F.col("number").cast("bigint"))
)
R.add("trace_flatten", f"""{_P1}, x AS (SELECT answer_id, v ->> '$.decision' AS decision, TRY_CAST(v ->> '$.path_edges' AS INTEGER) AS path_edges FROM d)
  SELECT answer_id, count(*) AS decisions, coalesce(sum(path_edges), 0)::BIGINT AS path_edges, max(path_edges) AS max_path_edges, count(*) FILTER (WHERE decision = 'mcts') AS mcts_success, count(*) FILTER (WHERE decision = 'mcts_weighted_fallback') AS mcts_fallback, count(*) FILTER (WHERE decision = 'mcts_no_path') AS mcts_no_path,
    count(*) FILTER (WHERE decision = 'budget_stop') AS budget_stop, count(*) FILTER (WHERE ends_with(decision, '_fallback')) AS fallbacks, count(*) FILTER (WHERE decision IN ('no_path', 'mcts_no_path')) AS no_path FROM x GROUP BY 1""")(
    lambda s, d: evaluate.flatten_decisions(nested.entity_table(table(s, d, "answers"), "decision"), "answer_id")
)
_MC = """SELECT answer_id, count(*) AS searches, avg(TRY_CAST(m ->> '$.iterations' AS INTEGER)) AS mean_iterations, max(TRY_CAST(m ->> '$.iterations' AS INTEGER)) AS max_iterations, avg(TRY_CAST(m ->> '$.candidate.hops' AS INTEGER)) AS mean_hops, max(TRY_CAST(m ->> '$.candidate.hops' AS INTEGER)) AS max_hops,
  avg(TRY_CAST(m ->> '$.candidate.nodes' AS INTEGER)) AS mean_nodes, max(TRY_CAST(m ->> '$.candidate.nodes' AS INTEGER)) AS max_nodes, count(*) FILTER (WHERE TRY_CAST(m ->> '$.radius_expanded' AS BOOLEAN)) AS radius_expanded"""
R.add("trace_searches", f"""{_P1} {_MC} FROM (SELECT answer_id, {_text("(v -> 'mcts')")} AS m FROM d) WHERE json_type(m) = 'OBJECT' GROUP BY 1""")(lambda s, d: evaluate.flatten_searches(nested.search_table(table(s, d, "answers")), "answer_id"))
_EM = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\pL\\pM\\pN\\p{{Pc}}\\s\\p{{Z}}\\x1c-\\x1f\\x85]', '', 'g'), '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g'), ' ')"
R.add("em_f1", f"""WITH n AS (SELECT answer_id, {_EM('query')} AS g, {_EM('answer')} AS p FROM answers), w AS (SELECT answer_id, unnest(string_split(g, ' ')) AS w, 1 AS a, 0 AS b FROM n UNION ALL SELECT answer_id, unnest(string_split(p, ' ')), 0, 1 FROM n),
  c AS (SELECT answer_id, sum(least(a, b)) AS s, sum(a + b) AS t FROM (SELECT answer_id, w, sum(a) AS a, sum(b) AS b FROM w WHERE w <> '' GROUP BY 1, 2) GROUP BY 1)
  SELECT answer_id, (g = p)::INTEGER AS em, CASE WHEN t > 0 THEN round(2 * s / t, 9) ELSE 1.0 END AS f1 FROM n LEFT JOIN c USING (answer_id)""")(lambda s, d: evaluate.exact_match_f1(table(s, d, "answers"), "answer_id", "query", "answer"))
R.add("selected_queries", f"""WITH q AS {_QV}, dl AS (SELECT a.query_id, max(a.x - b.x) AS up, max(b.x - a.x) AS down FROM q a JOIN q b ON a.dataset = b.dataset AND a.query_id = b.query_id AND b.variant = 'hi' WHERE a.variant = 'hi_minmax' GROUP BY 1), av AS (SELECT DISTINCT query_id FROM answers WHERE query_id IS NOT NULL),
  b1 AS (SELECT query_id FROM dl WHERE query_id IN (SELECT query_id FROM av) ORDER BY up DESC, query_id LIMIT 10), b2 AS (SELECT query_id FROM dl WHERE query_id IN (SELECT query_id FROM av) AND query_id NOT IN (SELECT query_id FROM b1) ORDER BY down DESC, query_id LIMIT 5),
  re AS (SELECT query_id FROM av WHERE query_id NOT IN (SELECT query_id FROM b1) AND query_id NOT IN (SELECT query_id FROM b2) ORDER BY md5('7|' || query_id::VARCHAR), query_id LIMIT 15)
  SELECT query_id, 'win' AS bucket FROM b1 UNION ALL SELECT query_id, 'loss' FROM b2 UNION ALL SELECT query_id, 'random' FROM re""")(lambda s, d: _selected(s, d))  # fmt: skip


def _selected(s, d):
    x = per_query(s, d)
    m = x.filter("variant = 'hi_minmax'").join(x.filter("variant = 'hi'").select("dataset", "query_id", F.col("x").alias("b")), ["dataset", "query_id"])
    b = m.groupBy("query_id").agg(F.max(F.col("x") - F.col("b")).alias("score")).withColumn("bucket", F.lit("win")).unionByName(m.groupBy("query_id").agg(F.max(F.col("b") - F.col("x")).alias("score")).withColumn("bucket", F.lit("loss")))
    return evaluate.selected_queries(b, table(s, d, "answers").filter("query_id IS NOT NULL"), "query_id", {"win": 10, "loss": 5}, 30, 7)


_ONE = "(SELECT dataset, query_id, variant, min(query) AS query, min(answer) AS answer FROM answers WHERE dataset IS NOT NULL AND query_id IS NOT NULL AND variant IS NOT NULL GROUP BY 1, 2, 3)"
_PAIR = lambda a, b: f"SELECT dataset, query_id, '{a}' AS l, '{b}' AS r, least(x.query, y.query) AS query, x.answer AS x, y.answer AS y FROM o x JOIN o y USING (dataset, query_id) WHERE x.variant = '{a}' AND y.variant = '{b}'"
_PACK = f"""WITH o AS {_ONE}, p AS ({_PAIR('hi', 'naive')} UNION ALL {_PAIR('hi', 'hi_minmax')}), f AS (SELECT *, substr(md5('7|' || l || '|' || r || '|' || dataset || '|' || query_id::VARCHAR), 1, 1) >= '8' AS flip, substr(sha256(l || '|' || r || '|' || dataset || '|' || query_id::VARCHAR), 1, 16) AS packet_id FROM p)"""
R.add("annotation_packet", f"""{_PACK} SELECT packet_id, dataset, query_id, l || ' vs ' || r AS comparison_pair, query, CASE WHEN flip THEN y ELSE x END AS answer_a, CASE WHEN flip THEN x ELSE y END AS answer_b, {', '.join(f"'' AS {c}" for c in evaluate.ANNOTATED)} FROM f""")(lambda s, d: _packet(s, d)[0])
R.add("annotation_hidden", f"{_PACK} SELECT packet_id, dataset, query_id, CASE WHEN flip THEN r ELSE l END AS variant_a, CASE WHEN flip THEN l ELSE r END AS variant_b FROM f")(lambda s, d: _packet(s, d)[1])


def _packet(s, d):
    a = table(s, d, "answers").filter("dataset IS NOT NULL AND query_id IS NOT NULL AND variant IS NOT NULL").groupBy("dataset", "query_id", "variant").agg(F.min("query").alias("query"), F.min("answer").alias("answer"))
    return evaluate.annotation_packet(a, ["dataset", "query_id"], "variant", [("hi", "naive"), ("hi", "hi_minmax")], 7)


R.add("rates_from_markdown", "SELECT dataset, trim(variant) AS variant, raw_win_rate_vs_hi AS win_rate FROM core7_consolidated_results WHERE raw_win_rate_vs_hi IS NOT NULL AND variant IS NOT NULL AND dataset IS NOT NULL")(
    lambda s, d: evaluate.rates_from_markdown(table(s, d, "core7_consolidated_results").filter("dataset IS NOT NULL AND variant IS NOT NULL").groupBy("dataset").agg(F.array_join(F.collect_list(F.concat(F.lit("## "), "variant", F.lit("\n\n- **win rate:** "), F.coalesce(F.col("raw_win_rate_vs_hi").cast("string"), F.lit("none")))), "\n\n").alias("t")), "dataset", "t")
)
