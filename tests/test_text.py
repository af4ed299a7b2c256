from pyspark.sql import functions as F

from loomgraph.functions import records as fr
from loomgraph.operators import chunking, extract

REC = '("entity"<|>"Windmill"<|>"building"<|>"A windmill grinds corn.")##("entity"<|>"Mill Pond"<|>"water"<|>"The pond feeds the wheel.")##("relationship"<|>"Windmill"<|>"Mill Pond"<|>"The mill stands by the pond."<|>2.5)<|COMPLETE|>'


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_records(spark):
    df = spark.createDataFrame([("chunk-1", REC), ("chunk-2", None), ("chunk-3", "")], "k string, t string")
    e = extract.parse_entities(df, "k", "t").collect()
    assert [r.entity_name for r in e] == ['"WINDMILL"', '"MILL POND"']
    r = extract.parse_relations(df, "k", "t").collect()
    assert [(x.src_id, x.tgt_id, x.weight) for x in r] == [('"WINDMILL"', '"MILL POND"', 2.5)]


def test_scalars(spark):
    arr = F.array(*map(F.lit, "BABCA"))
    assert one(spark, fr.ordered_unique(arr)) == ["B", "A", "C"]
    assert one(spark, fr.chunk_ids_only(fr.sep_list(F.lit("chunk-a<SEP>cluster-0-12<SEP>chunk-b")))) == ["chunk-a", "chunk-b"]
    assert one(spark, fr.prefix_snippet(F.lit("abcdef"), 3)) == "abc ..."
    assert one(spark, fr.clean_name(F.lit(" a&amp;b\x07 "))) == "a&b"
    assert one(spark, fr.custom_id(F.lit("a b"), F.lit("c|d"))) == "a_b|c_d"
    assert one(spark, fr.n_tokens(F.lit(None).cast("string"))) == 0
    assert one(spark, fr.split_markers(F.lit("a## b<|>c"), ["##", "<|>"])) == ["a", "b", "c"]
    assert fr.first_object('x {"a": {"b": 1}} {"c": 2}') == '{"a": {"b": 1}}'
    assert fr.first_object("{bad") is None
    assert fr.lenient_pairs('title: "x y", n: 3, ok: true') == '{"title": "x y", "n": 3, "ok": true}'
    s = fr.best_window("Clouds drift over. Bees carry pollen to the orchard. A cart waits.", "pollen for the orchard", 40)
    assert s == "Bees carry pollen to the orchard."
    assert fr.best_window("one two", "", 3) == "one" and fr.best_window("short", "short", 9) == "short"
    assert fr.lenient_pairs("a: {b: 1, c: {d: x}}, e: 2.5") == '{"a": {"b": 1, "c": {"d": "x"}}, "e": 2.5}'
    assert one(spark, fr.decode_tokens(fr.tokens(F.lit(" a  b ")))) == "a b"
    assert one(spark, fr.text_unit_content(F.lit("Clouds drift. Bees carry pollen."), F.lit("pollen"), 20, True)) == "Bees carry pollen. ..."
    assert one(spark, fr.text_unit_content(F.lit("abcdef"), None, 3)) == "abc ..." and one(spark, fr.text_unit_content(F.lit("abc"))) == "abc"
    assert one(spark, fr.report_markdown(F.lit("t"), F.lit("s"), fr.plain_findings(F.array(F.lit("x"))))) == "# t\n\ns\n\n## x\n\n"
    assert one(spark, fr.retrieval_seconds(F.lit("a [Retrieval Time: 1.5 seconds] b"))) == 1.5
    assert one(spark, fr.first_of_sep(F.lit("a<SEP>b"))) == "a"
    assert one(spark, fr.edge_text(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("B"), F.lit("r"))) == "source: a\n\nrelation: r\ntarget: b\nB"
    report = '{"title": "t", "summary": "s", "findings": "[{\\"summary\\": \\"f\\", \\"explanation\\": \\"e\\"}]"}'
    assert [tuple(x) for x in one(spark, fr.report_findings(F.lit(report)))] == [("f", "e")]
    assert one(spark, fr.repaired_json(F.lit("x: 1"))) == '{"x": 1}'


def test_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, None), (3, "  ")], "id int, t string")
    w = {(r.chunk_order_index): (r.tokens, r.content) for r in chunking.word_windows(df, "t", ["id"], 4, 2).collect()}
    assert w[0] == (4, "0 1 2 3") and w[4] == (2, "8 9") and len(w) == 5
    assert chunking.word_windows(df, "t", ["id"], 4, 2, False).count() == 4
    long = spark.createDataFrame([(1, "w " * 100_000)], "id int, t string")
    assert chunking.word_windows(long, "t", ["id"]).agg(F.max("tokens")).first()[0] == 1200


def test_separator_chunks_and_batches(spark):
    df = spark.createDataFrame([(1, "a b. c d. e f g h i j k l. m")], "id int, t string")
    c = chunking.separator_chunks(df, "id", "t", [". "], 4, 1).orderBy("chunk_order_index").collect()
    assert all(r.tokens <= 4 for r in c) and c[0].content == "a b. c d."
    b = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "k string, t bigint").coalesce(1).withColumn("one", F.lit("x"))
    sizes = chunking.greedy_batches(b, "k", "t", 4, 2, "one").groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in sizes] == [2, 1]


def test_chunks_last_document_wins(spark):
    docs = spark.createDataFrame([("doc-b", 1, "same words"), ("doc-a", 2, "same words"), ("doc-c", None, "other")], "doc_key string, first_id int, content string")
    c = {r.content: r.full_doc_id for r in chunking.chunks(docs).collect()}
    assert c == {"same words": "doc-a", "other": "doc-c"}
    letters = lambda df, text, keep: df.select(*keep, F.posexplode(F.split(text, " ")).alias("chunk_order_index", "content")).withColumn("tokens", F.lit(1).cast("bigint"))
    assert {r.content for r in chunking.chunks(docs, chunker=letters).collect()} == {"same", "words", "other"}


def test_cooccurrence_in_blocks(spark):
    import itertools
    import random

    rng = random.Random(3)
    rows = [(k, rng.choice("abcdefghijkl")) for k in range(9) for _ in range(k * 2)] + [(None, "a"), (None, "b")]
    want = {}
    for k in range(9):
        for p in itertools.combinations(sorted({n for j, n in rows if j == k}), 2):
            want[p] = want.get(p, 0) + 1.0
    df = spark.createDataFrame(rows, "doc int, name string")
    for block in (2, 3, 256):
        assert {(r.src, r.tgt): r.weight for r in extract.cooccurrence(df, "doc", block).collect()} == want


def test_budget(spark):
    df = spark.createDataFrame([("q", 1, 5), ("q", 2, 5), ("q", 3, 1), ("r", 1, 11)], "q string, o int, t int")
    assert sorted((r.q, r.o) for r in chunking.token_budget(df, ["q"], ["o"], "t", 10).collect()) == [("q", 1), ("q", 2)]
    assert chunking.token_budget(df, ["q"], ["o"], "t", 0).count() == 0
    big = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id % 2) AS q", "id AS o", "cast(id % 5 AS bigint) AS t", "1 AS cost")
    for budget in (0, 3, 700, 10**9):
        one, two = (sorted((str(r.q), r.o, r.running_cost) for r in chunking.token_budget(big, ["q"], [F.desc("o")], "t", budget, split).collect()) for split in (False, True))
        assert one == two
