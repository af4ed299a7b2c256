from loomgraph.plans import catalog


def test_chunks_of_bridges_between_others(spark, tmp_path):
    """The bridge from Adam to Dora goes over Bert and Cleo; document 2 holds these two alone, so only the bridge leads to it."""
    docs = [(1, "they met Adam and Bert there"), (2, "they met Bert and Cleo there"), (3, "they met Cleo and Dora there")] + [(10 + i, f"they met Adam the Aa{chr(97 + i)} there") for i in range(20)]
    spark.createDataFrame([(i, t, "x", "src") for i, t in docs], "doc_id bigint, text string, dataset string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "adam dora")], "answer_id bigint, query string").write.parquet(f"{tmp_path}/answers.parquet")
    got = {}
    for r in catalog.QUERIES["mode_scaffold"](spark, str(tmp_path)).orderBy("section", "rank").collect():
        got.setdefault(r.section, []).append(r.item)
    assert not {"Bert", "Cleo"} & set(got["entities"]) and "Bert|Cleo" in got["bridges"]
    assert "d2" in got["chunks"]
