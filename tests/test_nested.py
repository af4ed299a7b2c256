import json

from loomgraph.operators import nested

FULL = {
    "retrieval": {"bridge_strategy": "mcts", "bridge_path_edges": "3", "bridge_path_decisions": [{"source": "a", "target": "b", "path_edges": 1, "edges": {"src_id": "x", "tgt_id": "y", "cost": float("nan")}}, None, {"source": "c", "edges": [None, {"src_id": "p", "cost": "0.5"}]}]},
    "budgets": json.dumps({"context_budget_attempts": json.dumps([{"attempt": 1, "scale": 1.0, "input_tokens": 7}])}),
    "communities": "[]",
}
ROWS = [
    (1, json.dumps(FULL)), (2, json.dumps(json.dumps(FULL))), (3, None), (4, ""), (5, '{"communities": [{"level": 1}'), (6, "[1, 2]"), (7, "{}"),
    (8, json.dumps({"communities": {"level": 2, "title": "t"}, "retrieval": {"communities": [{"level": 9}, {"level": 8}]}})), (9, '{"communities": null, "budgets": 5, "bridge_path_decisions": "oops"}'),
]


def frame(spark):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in ROWS], "answer_id bigint, context_debug string, record int, parent string")


def test_found(spark):
    got = sorted(map(tuple, nested.found(frame(spark)).collect()))
    one = [("attempt", -1, 0), ("decision", -1, 0), ("decision", -1, 2), ("edge", 0, 0), ("edge", 2, 1)]
    assert got == sorted([(i, *x) for i in (1, 2) for x in one] + [(8, "community", -1, 0)])


def test_entity_tables(spark):
    e = {(r.answer_id, r.parent_pos, r.child_pos): (r.src_id, r.cost) for r in nested.entity_table(frame(spark), "edge").collect()}
    assert e == {(i, *k): v for i in (1, 2) for k, v in {(0, 0): ("x", None), (2, 1): ("p", 0.5)}.items()}
    a = {r.answer_id: r for r in nested.answer_table(frame(spark)).collect()}
    assert sorted(a) == [1, 2, 7, 8, 9]
    assert (a[1].bridge_strategy, a[1].bridge_path_edges, a[1].n_decision, a[1].n_attempt, a[1].n_edge) == ("mcts", 3, 2, 1, 2)
    assert a[7].n_attempt == 0
    assert [r.title for r in nested.entity_table(frame(spark), "community").collect()] == ["t"]


def test_empty(spark):
    empty = frame(spark).limit(0)
    assert nested.found(empty).count() == 0
    assert nested.answer_table(empty).count() == 0


def test_attempts_against_metrics(spark):
    a = spark.createDataFrame([(1, "r", 5, "hi", json.dumps(FULL)), (2, "r", 6, None, json.dumps(FULL)), (3, "r", 7, "hi", "{broken")], "answer_id bigint, run_id string, query_id int, variant string, context_debug string")
    m = spark.createDataFrame([(10, "r", 5, "hi", 2, None), (11, "r", 5, "hi", 1, "2026-01-01 00:00:00"), (12, "r", 7, "hi", 3, None)], "delivery_id bigint, run_id string, query_id int, variant string, budget_attempt_count int, received_at string")
    m = m.withColumn("received_at", m.received_at.cast("timestamp"))
    got = {r.answer_id: (r.record_attempts, r.metric_attempts, r.agrees) for r in nested.attempts_against_metrics(a, m).collect()}
    assert got == {1: (1, 1, True), 2: (1, None, None), 3: (None, 3, None)}


def test_inner_tables(spark):
    deep = {
        "bridge_path_decisions": [{"edges": [{"chunk_ids": ["c1", None, "c2"]}], "mcts": {"iterations": 7, "radius_expanded": True, "candidate": {"hops": 2, "nodes": "9"}}}, {"mcts": "{}"}, {"mcts": None}],
        "communities": {"nodes": json.dumps(["x", "y"])},
        "budgets": {"context_budget_attempts": [{"section_budgets": {"text": None, "local": 5}}, {"section_budgets": None}]},
    }
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, None)], "answer_id bigint, context_debug string")
    rows = lambda x: sorted(map(tuple, x.collect()), key=repr)
    assert rows(nested.list_table(df, "edge")) == [(1, 0, 0, 0, "c1"), (1, 0, 0, 2, "c2")]
    assert rows(nested.list_table(df, "community")) == [(1, -1, 0, 0, "x"), (1, -1, 0, 1, "y")]
    assert rows(nested.search_table(df)) == [(1, 0, 7, True, 2, 9), (1, 1, None, None, None, None)]
    assert rows(nested.section_table(df)) == [(1, 0, "local", 5), (1, 0, "text", None)]
    assert all(x.count() == 0 for x in (nested.search_table(df.limit(0)), nested.section_table(df.limit(0)), nested.list_table(df.limit(0), "edge")))
