import pytest
from pyspark.sql import functions as F

from loomgraph.operators import limits


def test_limits(spark):
    m = spark.createDataFrame([("c", 10), ("c", 5)], "chat string, t int")
    assert limits.chat_tokens(m, "chat", "t").first().estimate == 25
    assert spark.range(1).select(limits.clamped_output(F.lit(4000), F.lit(8000), F.lit(5000)).alias("x")).first().x == 952
    assert limits.stage_caps({"a": 1, "b": 2}, ["b=7"]) == {"a": 1, "b": 7}
    with pytest.raises(ValueError, match="bad stage cap"):
        limits.stage_caps({"a": 1}, ["z=1"])
    st = spark.createDataFrame([("a", 100, 200), ("b", 100, 9000)], "stage string, overhead_tokens int, output_cap int")
    ch = spark.createDataFrame([(300,)], "tokens int")
    assert {r.stage: r.fits for r in limits.preflight(ch, st, 4096).collect()} == {"a": True, "b": False}


def test_run_requests(spark):
    r = spark.createDataFrame([("x", "1"), ("y", "0")], "custom_id string, body string")
    got = {x.custom_id: (x.ok, x.text) for x in limits.run_requests(r, lambda b: str(1 // int(b))).collect()}
    assert got["x"] == (True, "1") and not got["y"][0] and got["y"][1].startswith("ZeroDivisionError")
