"""Deeply nested records to related flat tables: adjacency-table shredding.

`shred` stores a record as rows (record, node, parent, label, ordinal, kind, scalar). Entity tables come from joining
object nodes with their scalar children and pivoting the children by label.

Defined results for odd input: null, blank or broken JSON and JSON that is no object give no node at all; a null element
keeps its ordinal in its array but is no object; NaN and infinite numbers are null scalars; a declared container given as
a JSON string is decoded (repeatedly, if encoded more than once); a declared array given as a bare object is an array of
one; repeated keys: the last wins; rows with a null record id are kept under that null id but have no joined children.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import written

ADJACENCY = "record bigint, node int, parent int, label string, ordinal int, kind string, scalar string"
_ARROW = pa.schema([("record", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])

#: The labels of a retrieval debug record that hold arrays and objects (fixed by the record's format).
ARRAYS = ("bridge_path_decisions", "edges", "communities", "context_budget_attempts", "chunk_ids", "nodes")
OBJECTS = ("retrieval", "budgets", "mcts", "section_budgets", "candidate")


def _decode(value):
    for _ in range(4):
        if not isinstance(value, str):
            return value
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return None


def _walk(text: str | None, arrays: frozenset, objects: frozenset):
    root = _decode(text)
    if isinstance(root, list) and len(root) == 1:
        root = root[0]
    if not isinstance(root, dict):
        return
    todo, n = [(root, None, None, None)], 0
    while todo:
        value, parent, label, ordinal = todo.pop()
        if label in arrays or label in objects:
            if isinstance(value, str):
                value = _decode(value)
            if label in arrays and isinstance(value, dict):
                value = [value]
        if isinstance(value, dict):
            yield n, parent, label, ordinal, "object", None
            todo.extend((v, n, str(k), None) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            yield n, parent, label, ordinal, "array", None
            todo.extend((v, n, None, i) for i, v in reversed(list(enumerate(value))))
        else:
            if isinstance(value, float) and not math.isfinite(value):
                value = None
            if isinstance(value, bool):
                value = "true" if value else "false"
            yield n, parent, label, ordinal, "null" if value is None else "scalar", None if value is None else str(value)
        n += 1


def shred(df: DataFrame, record: str, text: str, arrays=ARRAYS, objects=OBJECTS) -> DataFrame:
    """The adjacency table of the JSON column `text`. Node 0 is the record's root; an array element has an ordinal, a
    member has a label."""
    a, o = frozenset(arrays), frozenset(objects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.extend((key, *x) for x in _walk(value, a, o))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return df.select(F.col(record).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, ADJACENCY)


def array_of(adj: DataFrame, label: str, under: str) -> DataFrame:
    """(record, arr): the array `label` of each record, below its root or the root's object `under`; the root's wins."""
    arr = adj.filter((F.col("kind") == "array") & (F.col("label") == label)).select("record", F.col("node").alias("arr"), "parent")
    sup = adj.filter((F.col("kind") == "object") & ((F.col("node") == 0) | ((F.col("label") == under) & (F.col("parent") == 0)))).select("record", F.col("node").alias("parent"))
    return arr.join(sup, ["record", "parent"]).groupBy("record").agg(F.min_by("arr", "parent").alias("arr"))


def elements_of(adj: DataFrame, arrays: DataFrame) -> DataFrame:
    """(record, node, pos) of the object elements of the given arrays; other columns of `arrays` are kept."""
    el = adj.filter((F.col("kind") == "object") & F.col("ordinal").isNotNull()).select("record", "node", F.col("parent").alias("arr"), F.col("ordinal").alias("pos"))
    return el.join(arrays, ["record", "arr"]).drop("arr")


def _kinds(adj: DataFrame) -> DataFrame:
    """(record, node, child_kind, parent_pos, pos) of the object nodes that are rows of the child tables."""
    out = None
    for kind, label, under in (("decision", "bridge_path_decisions", "retrieval"), ("community", "communities", "retrieval"), ("attempt", "context_budget_attempts", "budgets")):
        x = elements_of(adj, array_of(adj, label, under)).select("record", "node", F.lit(kind).alias("child_kind"), F.lit(-1).alias("parent_pos"), "pos")
        dec = x if kind == "decision" else dec  # noqa: F821
        out = x if out is None else out.unionByName(x)
    edges = adj.filter((F.col("kind") == "array") & (F.col("label") == "edges")).select("record", F.col("node").alias("arr"), "parent")
    own = edges.join(dec.select("record", F.col("node").alias("parent"), F.col("pos").alias("parent_pos")), ["record", "parent"]).drop("parent")
    return out.unionByName(elements_of(adj, own).select("record", "node", F.lit("edge").alias("child_kind"), "parent_pos", "pos"))


def pivoted(adj: DataFrame, objects: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Join object nodes with their scalar children and pivot those: one row per object node, one typed column per label.
    A scalar that doesn't fit its type is null. Labels are aggregated map-side, so a node is never collected."""
    leaf = adj.filter(F.col("kind") == "scalar").filter(F.col("label").isin(list(fields))).select("record", F.col("parent").alias("node"), "label", "scalar")
    wide = leaf.groupBy("record", "node").agg(*[F.expr(f"try_cast(max(CASE WHEN label = '{k}' THEN scalar END) AS {t})").alias(k) for k, t in fields.items()])
    finite = [F.when(~F.isnan(k) & (F.abs(F.col(k)) != float("inf")), F.col(k)).alias(k) if t == "double" else F.col(k) for k, t in fields.items()]
    return objects.join(wide.select("record", "node", *finite), ["record", "node"], "left")


#: Typed scalar members of each entity, by the record's format.
ENTITIES = {
    "decision": {"source": "string", "target": "string", "decision": "string", "path_edges": "int"},
    "edge": {"src_id": "string", "tgt_id": "string", "cost": "double", "order": "int"},
    "community": {"level": "int", "title": "string"},
    "attempt": {"attempt": "int", "scale": "double", "input_tokens": "bigint"},
}
ROOT = {"bridge_strategy": "string", "local_rerank_strategy": "string", "bridge_path_edges": "int", "community_count": "int", "mean_edge_score": "double", "bridge_budget_stopped": "boolean", "bridge_budget_fallbacks": "int"}
#: Arrays of scalars inside an entity: the child table's item column and the label of the array.
LISTS = {"edge": ("chunk_id", "chunk_ids"), "community": ("member", "nodes")}


def adjacency(df: DataFrame, record: str = "answer_id", text: str = "context_debug") -> DataFrame:
    """The adjacency table of all records, written once to the shared folder."""
    return written(shred(df, record, text), "adjacency")


def entities(adj: DataFrame) -> DataFrame:
    """(record, node, child_kind, parent_pos, pos, and the scalar members of every kind): all entity tables in one, from one join of
    object nodes with their scalar children and one pivot."""
    return pivoted(adj, _kinds(adj), {k: t for fields in ENTITIES.values() for k, t in fields.items()})


def _link(*names: str) -> list:
    return [F.col("record").alias("answer_id"), *[F.col(a).cast("int").alias(b) for a, b in (n.split(":") for n in names)]]


def found(df: DataFrame, record: str = "answer_id", text: str = "context_debug") -> DataFrame:
    """One row per child object, read off the entity tables: answer_id, child_kind, parent_pos, child_pos."""
    return entities(adjacency(df, record, text)).select(F.col("record").alias("answer_id"), "child_kind", F.col("parent_pos").cast("int"), F.col("pos").cast("int").alias("child_pos"))


def entity_table(df: DataFrame, kind: str, record: str = "answer_id", text: str = "context_debug") -> DataFrame:
    """The flat table of one child kind with its parent link, position and typed fields."""
    adj = adjacency(df, record, text)
    out = pivoted(adj, _kinds(adj).filter(F.col("child_kind") == kind), ENTITIES[kind])
    return out.select(*_link("parent_pos:parent_pos", "pos:child_pos"), *ENTITIES[kind])


def list_table(df: DataFrame, kind: str, record: str = "answer_id", text: str = "context_debug") -> DataFrame:
    """The items of an entity's array of scalars: answer_id, parent_pos, child_pos (the entity's), item_pos and the item; null items
    keep their position but are no row."""
    item, label = LISTS[kind]
    adj = adjacency(df, record, text)
    arr = adj.filter((F.col("kind") == "array") & (F.col("label") == label)).select("record", F.col("node").alias("arr"), F.col("parent").alias("node"))
    of = arr.join(_kinds(adj).filter(F.col("child_kind") == kind), ["record", "node"]).select("record", "arr", "parent_pos", "pos")
    leaf = adj.filter((F.col("kind") == "scalar") & F.col("ordinal").isNotNull()).select("record", F.col("parent").alias("arr"), "ordinal", "scalar")
    return leaf.join(of, ["record", "arr"]).select(*_link("parent_pos:parent_pos", "pos:child_pos", "ordinal:item_pos"), F.col("scalar").alias(item))


def _inner(adj: DataFrame, objects: DataFrame, label: str) -> DataFrame:
    """The object `label` of each of the given objects: record, node and the given other columns."""
    x = adj.filter((F.col("kind") == "object") & (F.col("label") == label)).select("record", F.col("node").alias("__inner"), F.col("parent").alias("node"))
    return x.join(objects, ["record", "node"]).drop("node").withColumnRenamed("__inner", "node")


def search_table(df: DataFrame, record: str = "answer_id", text: str = "context_debug") -> DataFrame:
    """The search details (`mcts`) of path decisions: answer_id, decision_pos, iterations, radius_expanded, candidate_hops,
    candidate_nodes."""
    adj = adjacency(df, record, text)
    dec = _kinds(adj).filter(F.col("child_kind") == "decision").select("record", "node", "pos")
    top = written(pivoted(adj, _inner(adj, dec, "mcts"), {"iterations": "int", "radius_expanded": "boolean"}), "searches")
    cand = pivoted(adj, _inner(adj, top.select("record", "node", "pos"), "candidate"), {"hops": "int", "nodes": "int"}).select("record", "pos", F.col("hops").alias("candidate_hops"), F.col("nodes").alias("candidate_nodes"))
    return top.join(cand, ["record", "pos"], "left").select(*_link("pos:decision_pos"), "iterations", "radius_expanded", "candidate_hops", "candidate_nodes")


def section_table(df: DataFrame, record: str = "answer_id", text: str = "context_debug") -> DataFrame:
    """The section budgets of the attempts: answer_id, attempt_pos, section, tokens (null where it is no number)."""
    adj = adjacency(df, record, text)
    att = _kinds(adj).filter(F.col("child_kind") == "attempt").select("record", "node", "pos")
    leaf = adj.filter(F.col("kind").isin("scalar", "null") & F.col("label").isNotNull()).select("record", F.col("parent").alias("node"), "label", "scalar")
    return leaf.join(_inner(adj, att, "section_budgets"), ["record", "node"]).select(*_link("pos:attempt_pos"), F.col("label").alias("section"), F.col("scalar").try_cast("bigint").alias("tokens"))


def answer_table(df: DataFrame, record: str = "answer_id", text: str = "context_debug") -> DataFrame:
    """One row per record that has an object, with root scalars (the root's before those under `retrieval`) and the
    number of children of each kind."""
    adj = adjacency(df, record, text)
    tops = adj.filter((F.col("kind") == "object") & ((F.col("node") == 0) | ((F.col("label") == "retrieval") & (F.col("parent") == 0)))).select("record", "node")
    flat = pivoted(adj, tops, ROOT)
    root = flat.groupBy("record").agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("node"))).alias(k) for k in ROOT])
    counts = _kinds(adj).groupBy("record").agg(*[F.count_if(F.col("child_kind") == k).alias(f"n_{k}") for k in ENTITIES])
    return root.join(counts, "record", "left").fillna(0, [f"n_{k}" for k in ENTITIES]).withColumnRenamed("record", "answer_id")


def attempts_against_metrics(answers: DataFrame, metrics: DataFrame) -> DataFrame:
    """The attempts counted in each answer's record beside the budget_attempt_count of its trace message, for all answers.

    A trace message may have been delivered several times with lost or changed values; its earliest delivery that states a
    count is taken (received_at, null last, then delivery_id). Answers without a trace have a null metric_attempts, those whose
    record is null or broken a null record_attempts."""
    mine = answer_table(answers).select("answer_id", F.col("n_attempt").alias("record_attempts"))
    keys = answers.select("answer_id", "run_id", "query_id", "variant")
    trace = (
        metrics.filter("budget_attempt_count IS NOT NULL AND variant IS NOT NULL")
        .groupBy("run_id", "query_id", "variant")
        .agg(F.min_by("budget_attempt_count", F.struct(F.col("received_at").isNull(), "received_at", "delivery_id")).alias("metric_attempts"))
    )
    return (
        keys.join(mine, "answer_id", "left").join(trace, ["run_id", "query_id", "variant"], "left")
        .select("answer_id", "record_attempts", "metric_attempts", (F.col("record_attempts") == F.col("metric_attempts")).alias("agrees"))
    )
