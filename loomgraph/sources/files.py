"""Files in and out: JSON lines, contexts, queries, question-answer corpora, GraphML, node-link JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.records import trim_ws
from loomgraph.operators.batchio import REQUEST, RESPONSE


def read_jsonl(spark: SparkSession, path: str, schema: str, bad: str = "DROPMALFORMED") -> DataFrame:
    """JSON lines with a stated schema; blank and (by default) broken lines are left out."""
    return spark.read.schema(schema).option("mode", bad).json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, REQUEST)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, RESPONSE)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, content: a .json file holds a list of strings or of objects (the first of context, text, content, passage);
    any other file is one text."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    js = raw.filter("path LIKE '%.json'").select("path", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "v"))
    obj = F.from_json("v", "struct<context: string, text: string, content: string, passage: string>")
    first = F.coalesce(*[F.nullif(trim_ws(F.col(f"o.{k}")), F.lit("")) for k in ("context", "text", "content", "passage")])
    js = js.withColumn("o", F.when(F.col("v").startswith("{"), obj)).select("path", "pos", F.when(F.col("o").isNotNull(), first).otherwise(trim_ws(F.col("v"))).alias("content"))
    rest = raw.filter("path NOT LIKE '%.json'").select("path", F.lit(0).alias("pos"), trim_ws(F.col("value")).alias("content"))
    return js.unionByName(rest).filter("content IS NOT NULL AND content <> ''")


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """query_id, query: the first of query, input, question; the id defaults to the line's place in its file, counted by the file's
    position and not by tasks, so it doesn't depend on how the file is split."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    x = raw.withColumn("n", F.row_number().over(Window.partitionBy("path", "start").orderBy("at")) - 1)  # a block of a file
    size = x.groupBy("path", "start").agg(F.count("*").alias("lines"))
    ahead = size.select("path", "start", F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    q = x.join(ahead, ["path", "start"]).withColumn("j", F.from_json("value", "query string, input string, question string, query_id int")).filter("length(trim(value)) > 0")
    text = F.coalesce(*[F.nullif(trim_ws(F.col(f"j.{k}")), F.lit("")) for k in ("query", "input", "question")])
    out = q.select(F.coalesce("j.query_id", (F.col("ahead") + F.col("n")).cast("int")).alias("query_id"), text.alias("query")).filter("query IS NOT NULL")
    return out.orderBy("query_id").limit(limit) if limit else out


def qa_passages(df: DataFrame, shape: str) -> DataFrame:
    """title, text of a multi-hop corpus; equal texts once. shape: 'pairs' (context: array of [title, sentences]), 'paragraphs'
    (array of struct with title and paragraph_text), 'hits' (ctxs: array of struct with title and text)."""
    if shape == "pairs":
        x = df.select(F.explode("context").alias("c")).select(F.col("c.title").alias("title"), F.array_join("c.sentences", " ").alias("text"))
    elif shape == "paragraphs":
        x = df.select(F.explode("paragraphs").alias("c")).select(F.col("c.title").alias("title"), F.col("c.paragraph_text").alias("text"))
    elif shape == "hits":
        x = df.select(F.explode("ctxs").alias("c")).select(F.col("c.title").alias("title"), F.col("c.text").alias("text"))
    else:
        raise ValueError(f"unknown shape {shape}")
    return x.filter("text IS NOT NULL").groupBy("text").agg(F.min("title").alias("title")).select("title", "text")


def qa_queries(df: DataFrame, shape: str = "paragraphs") -> DataFrame:
    """question, answer (the last alternative) and the supporting titles. shape: 'paragraphs' (answers, paragraphs with is_supporting),
    'pairs' (answer, supporting_facts: array of [title, sentence]), 'hits' (answers, no support stated)."""
    if shape == "paragraphs":
        return df.select("question", F.try_element_at("answers", F.lit(-1)).alias("answer"), F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: p["title"]).alias("supporting"))
    if shape == "pairs":
        return df.select("question", "answer", F.array_distinct(F.transform("supporting_facts", lambda p: p["title"])).alias("supporting"))
    if shape == "hits":
        return df.select("question", F.try_element_at("answers", F.lit(-1)).alias("answer"), F.array().cast("array<string>").alias("supporting"))
    raise ValueError(f"unknown shape {shape}")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, attributes map; edges: src, tgt, attributes map), attribute names resolved by the <key> declarations."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path)
    names = keys.select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"))

    def resolved(df: DataFrame, ids: list[str]) -> DataFrame:
        one = df.select(*ids, F.explode_outer("data").alias("d")).join(F.broadcast(names), F.col("d._key") == F.col("k"), "left")  # one row a declared attribute
        pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", F.col("d._VALUE").alias("v"))))
        return one.groupBy(*ids).agg(F.map_from_entries(pairs).alias("attributes"))

    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path).withColumnRenamed("_id", "id")
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    e = e.select(F.least("_source", "_target").alias("src"), F.greatest("_source", "_target").alias("tgt"), F.monotonically_increasing_id().alias("edge"), "data")  # parallel edges stay apart
    return resolved(n, ["id"]), resolved(e, ["src", "tgt", "edge"]).drop("edge")


def write_graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The elements of a GraphML document, one a row; attributes are entity_type and description, weight and description."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    datum = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), esc(c), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), esc(F.col("entity_name")), F.lit('">'), datum("d0", F.col("entity_type")), datum("d1", F.col("description")), F.lit("</node>")).alias("xml"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("tgt")), F.lit('">'), datum("d2", F.col("weight")), datum("d3", F.col("description")), F.lit("</edge>")).alias("xml"))
    return n.unionByName(e)


GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d1" for="node" attr.name="description" attr.type="string"/><key id="d2" for="edge" attr.name="weight" attr.type="double"/><key id="d3" for="edge" attr.name="description" attr.type="string"/><graph edgedefault="undirected">'
GRAPHML_TAIL = "</graph></graphml>"


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML document as text parts that read in order of their names: the head, nodes, edges and the tail. Any number of tasks write."""
    spark = nodes.sparkSession
    line = lambda x: spark.createDataFrame([(x,)], "xml string").coalesce(1)
    rows = write_graphml_lines(nodes, edges)
    for name, df in (("0-head", line(GRAPHML_HEAD)), ("1-nodes", rows.filter("part = 1").select("xml")), ("2-edges", rows.filter("part = 2").select("xml")), ("3-tail", line(GRAPHML_TAIL))):
        df.write.mode("overwrite").text(f"{path}/{name}")


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part (nodes or links), json: the elements of a node-link document, one a row."""
    n = nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct(F.col("entity_name").alias("id"), *[c for c in nodes.columns if c != "entity_name"])).alias("json"))
    return n.unionByName(edges.select(F.lit("links").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("tgt").alias("target"), *[c for c in edges.columns if c not in ("src", "tgt")])).alias("json")))


def write_rows(df: DataFrame, path: str, form: str = "jsonl") -> None:
    """Rows as JSON lines or CSV with a header, in as many parts as there are tasks."""
    if form == "jsonl":
        df.write.mode("overwrite").json(path)
    elif form == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form {form}")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A summary of at most `most` rows as a Markdown table; more raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join("| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]])


def property_graph(nodes: DataFrame, edges: DataFrame, members: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind; edges: src, tgt, kind) of entities, communities and their relations; members without a node are left out."""
    members = members.join(nodes.select(F.col("entity_name").alias("node")), "node", "left_semi")
    n = nodes.select(F.col("entity_name").alias("id"), F.lit("Entity").alias("kind")).unionByName(members.select(F.concat_ws("/", F.col("level").cast("string"), "community").alias("id")).distinct().withColumn("kind", F.lit("Community")))
    e = edges.select("src", "tgt", F.lit("RELATES_TO").alias("kind"))
    e = e.unionByName(members.select(F.col("node").alias("src"), F.concat_ws("/", F.col("level").cast("string"), "community").alias("tgt"), F.lit("IN_COMMUNITY").alias("kind")))
    e = e.unionByName(subs.select(F.concat_ws("/", F.col("level").cast("string"), "parent").alias("src"), F.concat_ws("/", (F.col("level") + 1).cast("string"), "child").alias("tgt"), F.lit("HAS_SUBCOMMUNITY").alias("kind")))
    return n, e
