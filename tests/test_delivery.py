import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import delivery

SCHEMA = "delivery_id bigint, run_id string, custom_id string, received_at timestamp, quotient string, kept string"


def brute(rows):
    best = {}
    for d, run, c, at, *_ in rows:
        if c is not None:
            best.setdefault((run, c.strip(" \t\r\n 　").lower()), []).append((at is None, at or 0, d))
    return {d for g in best.values() for _, _, d in sorted(g)[1:]}


def test_against_brute_force(spark):
    import datetime as dt

    rng = random.Random(3)
    rows = []
    for d in range(600):
        c = rng.choice([None, "a|1", "A|1 ", "\ta|1 ", "b|2", "b|2\r\n", "", " ", f"x{d % 50}"]) if d % 3 else "hot"
        rows.append((d, rng.choice(["r", "s", None]), c, rng.choice([None, dt.datetime(2026, 1, rng.randint(1, 9))]), "q", "k"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.delivery_id for r in delivery.to_drop(df).collect()} == brute(rows)
    left = delivery.once(df)
    assert left.columns == df.columns and left.count() == len(rows) - len(brute(rows))
    assert delivery.to_drop(df.limit(0)).count() == 0
    f = delivery.found({"t": df, "u": df.limit(0)})
    assert f.columns == ["source_table", "delivery_id"] and f.count() == len(brute(rows))


def test_permutation_is_a_bijection():
    w = np.random.default_rng(1).integers(0, 1 << 63, (500, 4)).astype(np.uint64)
    w[:250, 1:] = 0
    p = delivery.permute(w)
    assert (delivery.unpermute(p) == w).all() and len(np.unique(p, axis=0)) == 500


def test_table_against_a_dict():
    rng = np.random.default_rng(2)
    words = delivery.permute(np.column_stack([rng.integers(0, 700, 5000).astype(np.uint64)] * 4))
    words[:40, 0] = words[0, 0]  # one home slot
    at, d = rng.integers(0, 9, 5000), np.arange(5000)
    table, lost = delivery.QuotientTable(4), []
    for lo in range(0, 5000, 333):
        lost += table.insert(words[lo : lo + 333], at[lo : lo + 333], d[lo : lo + 333]).tolist()
    best = {}
    for w, a, i in zip(map(bytes, words), at.tolist(), d.tolist(), strict=True):
        best[w] = min(best.get(w, (a, i)), (a, i))
    assert sorted(lost) == sorted(set(range(5000)) - {i for _, i in best.values()})
    assert {bytes(w): (a, i) for w, a, i in zip(*table.entries(), strict=True)} == best
    assert not len(table.insert(words[:0], at[:0], d[:0]))


def test_repeated_rows_and_null_ids(spark):
    df = spark.range(300).selectExpr("id AS delivery_id", "'r' AS run_id", "cast(id % 7 AS string) AS custom_id", "CAST(NULL AS timestamp) AS received_at")
    twice = df.unionByName(df.filter("delivery_id < 7")).unionByName(df.limit(1).selectExpr("CAST(NULL AS bigint) AS delivery_id", "run_id", "'0' AS custom_id", "received_at"))
    assert sorted(r.delivery_id for r in delivery.to_drop(twice.repartition(3)).collect()) == list(range(7, 300))
    assert delivery.once(twice).count() == 15


def test_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(delivery, "TABLE", 20)
    rng = np.random.default_rng(5)
    n = rng.integers(0, 150, 900)
    word = [hashlib.sha256(str(i).encode()).digest() for i in n.tolist()]
    at, d = rng.integers(0, 4, 900), np.arange(900)
    parts = [[pa.RecordBatch.from_arrays([pa.array(word[i : i + 50], pa.binary()), pa.array(at[i : i + 50]), pa.array(d[i : i + 50])], names=["w", "at", "d"]) for i in range(lo, lo + 300, 50)] for lo in (0, 300, 600)]
    rows = pa.Table.from_batches([x for p in parts for x in delivery._before(iter(p))]).sort_by("quotient")
    lost = [x for b in delivery._shard(iter(rows.to_batches(max_chunksize=40))) for x in b.column(0).to_pylist()]
    kept = {min((a, i) for a, i, m in zip(at.tolist(), d.tolist(), n.tolist(), strict=True) if m == k)[1] for k in set(n.tolist())}
    assert sorted(lost) == sorted(set(range(900)) - kept)


def test_scope_and_identifier_dont_run_together(spark):
    df = spark.createDataFrame([(1, "a", "bc", None), (2, "ab", "c", None), (3, None, "abc", None), (4, "", "abc", None)], "delivery_id bigint, run_id string, custom_id string, received_at timestamp")
    assert delivery.to_drop(df).count() == 0
