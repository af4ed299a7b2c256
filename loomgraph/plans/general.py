"""Queries of the general training-data operators: nested records (p1) and repeated deliveries (p3)."""

from __future__ import annotations

from loomgraph.operators import delivery, nested
from loomgraph.plans.registry import Registry
from loomgraph.session import table

R = Registry()

#: The identifier without outer white space and case, as TESTDATA.md defines it.
_KEY = r"""lower(regexp_replace(custom_id, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g'))"""


def _dropped(name: str) -> str:
    return f"""SELECT '{name}' AS source_table, delivery_id FROM (
      SELECT delivery_id, row_number() OVER (PARTITION BY run_id, {_KEY} ORDER BY received_at NULLS LAST, delivery_id) AS n
      FROM {name} WHERE custom_id IS NOT NULL) WHERE n > 1"""


def _text(x: str) -> str:
    """SQL: a JSON value that is a string holding JSON, decoded up to three times; null where it holds none."""
    one = lambda y: f"CASE WHEN json_type({y}) = 'VARCHAR' THEN CASE WHEN json_valid({y} ->> '$') THEN ({y} ->> '$')::JSON END ELSE {y} END"
    return one(f"({one(f'({one(x)})')})")


def _list(x: str) -> str:
    """SQL: a declared array; a bare object is an array of one."""
    return f"(SELECT CASE json_type(y) WHEN 'ARRAY' THEN y WHEN 'OBJECT' THEN json_array(y) END FROM (SELECT {_text(x)} AS y))"


def _each(frm: str, arr: str, keep: str) -> str:
    """SQL: the object elements of an array with their positions."""
    return f"SELECT {keep}, pos, v FROM (SELECT {keep}, unnest(range(json_array_length(a)::BIGINT))::INTEGER AS pos, a, a -> ('$[' || unnest(range(json_array_length(a)::BIGINT)) || ']') AS v FROM (SELECT {keep}, {arr} AS a FROM {frm}) WHERE a IS NOT NULL) WHERE json_type(v) = 'OBJECT'"


#: The records' objects and child objects, decoded by SQL alone. NaN is no JSON, so it is made null first.
_P1 = f"""WITH t AS (SELECT answer_id, regexp_replace(context_debug, '([:\\[,]\\s*)-?(NaN|Infinity)', '\\1null', 'g') AS x FROM answers),
  u AS (SELECT answer_id, CASE WHEN json_valid(x) THEN {_text('x::JSON')} END AS v FROM t),
  r AS (SELECT answer_id, v FROM (SELECT answer_id, CASE WHEN json_type(v) = 'ARRAY' AND json_array_length(v) = 1 THEN v -> '$[0]' ELSE v END AS v FROM u) WHERE json_type(v) = 'OBJECT'),
  o AS (SELECT answer_id, v AS r, {_text("(v -> 'retrieval')")} AS t, {_text("(v -> 'budgets')")} AS b FROM r),
  d AS ({_each('o', f"coalesce({_list('(r -> $$bridge_path_decisions$$)')}, {_list('(t -> $$bridge_path_decisions$$)')})", 'answer_id')}),
  c AS ({_each('o', f"coalesce({_list('(r -> $$communities$$)')}, {_list('(t -> $$communities$$)')})", 'answer_id')}),
  a AS ({_each('o', f"coalesce({_list('(r -> $$context_budget_attempts$$)')}, {_list('(b -> $$context_budget_attempts$$)')})", 'answer_id')}),
  e AS ({_each('(SELECT answer_id, pos AS parent_pos, v AS w FROM d)', _list('(w -> $$edges$$)'), 'answer_id, parent_pos')})"""
_num = lambda k, t: f"TRY_CAST(v ->> '$.{k}' AS {t})"
_items = lambda frm, label, item: f"""{_P1}, l AS (SELECT answer_id, parent_pos, child_pos, {_list(f"(v -> '{label}')")} AS x FROM ({frm}))
  SELECT answer_id, parent_pos, child_pos, item_pos, {item} FROM (SELECT answer_id, parent_pos, child_pos, unnest(range(json_array_length(x)::BIGINT))::INTEGER AS item_pos, unnest(x ->> '$[*]') AS {item} FROM l WHERE x IS NOT NULL) WHERE {item} IS NOT NULL"""  # noqa: E731

R.add("p1_found", f"""{_P1} SELECT answer_id, 'decision' AS child_kind, -1 AS parent_pos, pos AS child_pos FROM d UNION ALL SELECT answer_id, 'community', -1, pos FROM c
  UNION ALL SELECT answer_id, 'attempt', -1, pos FROM a UNION ALL SELECT answer_id, 'edge', parent_pos, pos FROM e""")(lambda s, d: nested.found(table(s, d, "answers")))
_MINE = {"bridge_strategy": "VARCHAR", "local_rerank_strategy": "VARCHAR", "bridge_path_edges": "INTEGER", "community_count": "INTEGER", "mean_edge_score": "DOUBLE", "bridge_budget_stopped": "BOOLEAN", "bridge_budget_fallbacks": "INTEGER"}
_COUNTS = ", ".join(f"(SELECT count(*) FROM {t} WHERE {t}.answer_id = o.answer_id) AS n_{k}" for t, k in (("d", "decision"), ("e", "edge"), ("c", "community"), ("a", "attempt")))
_ANSWERS = f"""{_P1}, root AS (SELECT answer_id, {', '.join(f"coalesce(TRY_CAST(r ->> '$.{k}' AS {t}), TRY_CAST(t ->> '$.{k}' AS {t})) AS {k}" for k, t in _MINE.items())}, {_COUNTS} FROM o)"""
R.add("p1_answers", f"{_ANSWERS} SELECT * FROM root")(lambda s, d: nested.answer_table(table(s, d, "answers")))
R.add("p1_decisions", f"{_P1} SELECT answer_id, -1 AS parent_pos, pos AS child_pos, v ->> '$.source' AS source, v ->> '$.target' AS target, v ->> '$.decision' AS decision, {_num('path_edges', 'INTEGER')} AS path_edges FROM d")(
    lambda s, d: nested.entity_table(table(s, d, "answers"), "decision")
)
R.add("p1_edges", f"{_P1} SELECT answer_id, parent_pos, pos AS child_pos, v ->> '$.src_id' AS src_id, v ->> '$.tgt_id' AS tgt_id, {_num('cost', 'DOUBLE')} AS cost, {_num('order', 'INTEGER')} AS \"order\" FROM e")(
    lambda s, d: nested.entity_table(table(s, d, "answers"), "edge")
)
R.add("p1_communities", f"{_P1} SELECT answer_id, -1 AS parent_pos, pos AS child_pos, {_num('level', 'INTEGER')} AS level, v ->> '$.title' AS title FROM c")(lambda s, d: nested.entity_table(table(s, d, "answers"), "community"))
R.add("p1_attempts", f"{_P1} SELECT answer_id, -1 AS parent_pos, pos AS child_pos, {_num('attempt', 'INTEGER')} AS attempt, {_num('scale', 'DOUBLE')} AS scale, {_num('input_tokens', 'BIGINT')} AS input_tokens FROM a")(
    lambda s, d: nested.entity_table(table(s, d, "answers"), "attempt")
)
R.add("p1_edge_chunks", _items("SELECT answer_id, parent_pos, pos AS child_pos, v FROM e", "chunk_ids", "chunk_id"))(lambda s, d: nested.list_table(table(s, d, "answers"), "edge"))
R.add("p1_community_nodes", _items("SELECT answer_id, -1 AS parent_pos, pos AS child_pos, v FROM c", "nodes", "member"))(lambda s, d: nested.list_table(table(s, d, "answers"), "community"))
R.add("p1_searches", f"""{_P1} SELECT answer_id, pos AS decision_pos, TRY_CAST(m ->> '$.iterations' AS INTEGER) AS iterations, TRY_CAST(m ->> '$.radius_expanded' AS BOOLEAN) AS radius_expanded,
  TRY_CAST(m ->> '$.candidate.hops' AS INTEGER) AS candidate_hops, TRY_CAST(m ->> '$.candidate.nodes' AS INTEGER) AS candidate_nodes FROM (SELECT answer_id, pos, {_text("(v -> 'mcts')")} AS m FROM d) WHERE json_type(m) = 'OBJECT'""")(
    lambda s, d: nested.search_table(table(s, d, "answers"))
)
R.add("p1_section_budgets", f"""{_P1}, k AS (SELECT answer_id, pos AS attempt_pos, m, unnest(json_keys(m)) AS section FROM (SELECT answer_id, pos, {_text("(v -> 'section_budgets')")} AS m FROM a) WHERE json_type(m) = 'OBJECT')
  SELECT answer_id, attempt_pos, section, TRY_CAST(m ->> ('$.' || section) AS BIGINT) AS tokens FROM k""")(lambda s, d: nested.section_table(table(s, d, "answers")))
R.add("p1_attempts_against_metrics", f"""{_ANSWERS}, trace AS (SELECT run_id, query_id, variant, budget_attempt_count AS metric_attempts FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, variant ORDER BY received_at NULLS LAST, delivery_id) AS n
    FROM retrieval_trace_metrics WHERE budget_attempt_count IS NOT NULL AND variant IS NOT NULL) WHERE n = 1)
  SELECT x.answer_id, n_attempt AS record_attempts, metric_attempts, n_attempt = metric_attempts AS agrees FROM answers x LEFT JOIN root USING (answer_id) LEFT JOIN trace m ON x.run_id = m.run_id AND x.query_id = m.query_id AND x.variant = m.variant""")(
    lambda s, d: nested.attempts_against_metrics(table(s, d, "answers"), table(s, d, "retrieval_trace_metrics"))
)
R.add("p3_found", _dropped("batch_errors") + " UNION ALL " + _dropped("retrieval_trace_metrics"))(
    lambda s, d: delivery.found({n: table(s, d, n) for n in ("batch_errors", "retrieval_trace_metrics")})
)
R.add("p3_batch_errors_once", f"""SELECT delivery_id, run_id, batch_id, custom_id FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, {_KEY} ORDER BY received_at NULLS LAST, delivery_id) AS n FROM batch_errors)
      WHERE n = 1 OR custom_id IS NULL""")(
    lambda s, d: delivery.once(table(s, d, "batch_errors")).select("delivery_id", "run_id", "batch_id", "custom_id")
)
