import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.functions import records
from loomgraph.operators import chunking, community, compact, extract, retrieval, vectors

DOCS = [(1, "Green Mill grinds Corn by Clay Pond."), (2, "Clay Pond feeds Green Mill."), (3, "Old Barn keeps Corn and Hay.")]
TABLES = {"chunks", "mentions", "nodes", "edges", "members", "reports", "node_vectors", "chunk_vectors", "edge_vectors"}


def test_a_mode_makes_only_what_it_needs(spark):
    q = vectors.embed(spark.createDataFrame([("q", "mill by the pond")], "query_id string, query string"), "query_id", "query").withColumnRenamed("vec", "qvec")
    o = retrieval.QueryOptions(threshold=-1.0)
    needs = {"naive": {"chunks", "chunk_vectors"}, "hi_local": TABLES - {"chunk_vectors", "edge_vectors", "members", "reports"}, "hi_nobridge": TABLES - {"chunk_vectors", "edge_vectors"}}
    for mode, made in needs.items():
        ix = retrieval.build_index(spark.createDataFrame(DOCS, "doc_id bigint, text string"))
        assert retrieval.retrieve(ix, q, mode, o).count() > 0
        assert TABLES & set(vars(ix)) == made


def test_splits_in_a_task_and_by_joins(spark):
    e = [(f"n{i:02}", f"n{j:02}", float((i * j) % 5 + 1)) for i, j in itertools.combinations(range(60), 2) if i // 20 == j // 20 and (i + j) % 3 or (i * j) % 97 == 5]
    df = spark.createDataFrame([*e, ("loop", "loop", 1.0)], "src string, tgt string, weight double")
    got = [{tuple(r) for r in community.hierarchical_communities(df, 4, small).select("level", "community", "node").collect()} for small in (0, 150, community.SMALL)]
    assert got[0] == got[1] == got[2] and max(r[0] for r in got[0]) >= 1 and len({r[2] for r in got[0]}) == 60


def test_hashed_counts():
    a, b = vectors.hashed(["red apple red", ""], 8)
    assert a.sum() % 2 == 5 % 2 and abs(a).sum() <= 5 and not b.any()


def test_pairs_of_streamed_texts(monkeypatch):
    """Texts that go over the ends of Arrow batches, and too long ones, which are left to the blocks."""
    rows = [(k, f"n{(7 * k + i * i) % 90:02} x") for k in range(20) for i in range(3 * k)]
    for held in (1, 50, 1 << 16):
        monkeypatch.setattr(extract, "ROWS", held)
        for size in (1, 17, 1000):
            batches = [pa.RecordBatch.from_pydict({"k": [str(k) for k, _ in rows[i : i + size]], "name": [n for _, n in rows[i : i + size]]}) for i in range(0, len(rows), size)]
            got, want = Counter(), Counter()
            for p in (p for b in extract._pairs_of_texts(iter(batches), 40) for p in b.to_pylist()):
                got[p["src"], p["tgt"], p["tokens"]] += p["n"]
            for k in range(14):  # 3 x 13 rows are the most that fit
                want.update((a, b, 4) for a, b in itertools.combinations(sorted({n for x, n in rows if x == k}), 2))
            assert got == want


def test_edges_and_windows(spark):
    rows = [(k, f"n{(7 * k + i * i) % 90:02} x") for k in range(20) for i in range(3 * k)]
    want = Counter(p for k in range(20) for p in itertools.combinations(sorted({n for x, n in rows if x == k}), 2))
    for block in (4, 40, 256):
        e = extract.cooccurrence(spark.createDataFrame([*rows, (None, "a"), (None, "b"), (3, None)], "k int, name string"), "k", block, words=True)
        assert {(r.src, r.tgt): (r.weight, r.tokens) for r in e.collect()} == {p: (n, 4) for p, n in want.items()}
    d = spark.createDataFrame([(1, "\t a b\vc  d e \u2028\n"), (2, " \f"), (3, None)], "i int, t string")  # only five ASCII blanks part words
    assert [tuple(r) for r in chunking.word_windows(d, "t", ["i"], 3, 1).orderBy("chunk_order_index").collect()] == [(1, 0, 3, "a b\vc d"), (1, 1, 3, "d e \u2028"), (1, 2, 1, "\u2028")]
    assert [r.t for r in d.select(records.trim_ws(F.col("t")).alias("t")).collect()] == ["a b\vc  d e \u2028", "", None]


def test_parcels(spark):
    df = spark.createDataFrame([(f"a{i % 7}", f"b{i}", float(i)) for i in range(1000)], "src string, tgt string, w double")
    p = compact.parcels(df.coalesce(1), 100).toArrow()
    src, tgt, w = compact.unpacked(p, lambda x: np.array([int(y[1:]) for y in x.to_pylist()]))
    assert sorted(zip(src.tolist(), tgt.tolist(), w.tolist(), strict=True)) == sorted((i % 7, i, float(i)) for i in range(1000))


def test_mentions_need_no_shuffle(spark):
    docs = spark.createDataFrame([*DOCS, (4, "GREEN MILL or Green Mill, The Mill.")], "doc_id bigint, text string")
    own, given = retrieval.build_index(docs), retrieval.build_index(docs, extractor=extract.regex_entities)
    assert sorted(map(tuple, own.mentions.collect())) == sorted(map(tuple, given.mentions.collect()))
    assert own.mentions.groupBy("chunk_id", "node").count().filter("count > 1").count() == 0
