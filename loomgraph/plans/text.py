"""Queries over documents and chunks: ids, windows, mentions, snippets, budgets, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import records as fr
from loomgraph.operators import chunking, extract
from loomgraph.plans.registry import Registry
from loomgraph.session import table

R = Registry()
B = r"[ \t\n\r\f]"
TRIM = lambda c: f"regexp_replace({c}, '^{B}+|{B}+$', '', 'g')"
WORDS = lambda c: f"CASE WHEN {c} IS NULL OR {TRIM(c)} = '' THEN []::VARCHAR[] ELSE string_split_regex({TRIM(c)}, '{B}+') END"
STOP = ", ".join(f"'{w}'" for w in fr.SNIPPET_STOPWORDS)
ENT_STOP = ", ".join(f"'{w}'" for w in fr.ENTITY_STOPWORDS)
#: DuckDB's engine has no look-around; its \b is ASCII, as the look-arounds are.
ENT = r"\b(?:[A-Z][a-z]+(?:[ \t\n\r\f]+[A-Z][a-z]+){0,2}|[A-Z]{2,}(?:[ \t\n\r\f]+[A-Z]{2,}){0,2})\b"
NAMES = f"""(SELECT DISTINCT doc_id, n AS name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{ENT}')) AS n FROM documents) WHERE n NOT IN ({ENT_STOP}))"""

R.add("doc_dedupe_ids", f"""SELECT 'doc-' || md5(t) AS doc_key, min(doc_id) AS first_id, count(*) AS copies
  FROM (SELECT doc_id, {TRIM('text')} AS t FROM documents) WHERE t <> '' GROUP BY 1""")(
    lambda s, d: chunking.dedupe_documents(table(s, d, "documents")).drop("content")
)


def _windows(size: int, overlap: int, tail: bool) -> str:
    step = size - overlap
    last = "len(w) - 1" if tail else f"greatest(len(w) - {overlap} - 1, 0)"
    return f"""SELECT doc_id, i AS chunk_order_index, least({size}, len(w) - i * {step}) AS tokens,
      md5(array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ')) AS content_md5
      FROM (SELECT doc_id, w, unnest(range(0, ({last}) // {step} + 1)) AS i FROM (SELECT doc_id, {WORDS('text')} AS w FROM documents) WHERE len(w) > 0)"""


def _window_query(size: int, overlap: int, tail: bool):
    def run(s, d):
        w = chunking.word_windows(table(s, d, "documents"), "text", ["doc_id"], size, overlap, tail)
        return w.select("doc_id", F.col("chunk_order_index").cast("bigint").alias("chunk_order_index"), "tokens", F.md5("content").alias("content_md5"))

    return run


R.add("chunk_word_windows", _windows(120, 20, True))(_window_query(120, 20, True))
R.add("chunk_word_windows_no_tail", _windows(220, 40, False))(_window_query(220, 40, False))
R.add("chunk_stats_by_lang", f"""SELECT lang, count(*) AS chunk_count, sum(tokens)::BIGINT AS total_tokens, max(tokens) AS max_tokens FROM ({_windows(120, 20, True)}) JOIN documents USING (doc_id) GROUP BY lang""")(
    lambda s, d: chunking.chunk_stats(chunking.word_windows(table(s, d, "documents"), "text", ["lang"], 120, 20), ["lang"])
)
R.add("separator_chunks")(lambda s, d: chunking.separator_chunks(table(s, d, "text_chunks").select("chunk_id", F.col("text").alias("body")).withColumnRenamed("chunk_id", "item"), "item", "body", ["\n\n", "\n", ". ", "! ", "? "], 120, 20))
R.add("dataset_stats", """SELECT coalesce(dataset, source, 'unknown') AS label, count(*) AS n_rows, round(avg(length(text)), 2) AS avg_chars, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY 1""")(
    lambda s, d: chunking.dataset_stats(table(s, d, "documents"), "text", ["dataset", "source"])
)
R.add("unique_contexts_first", """SELECT md5(context) AS context_md5, min(context_id) AS context_id FROM unique_contexts WHERE context IS NOT NULL GROUP BY 1""")(
    lambda s, d: chunking.unique_contexts(table(s, d, "unique_contexts"), "context", ["context_id"]).select(F.md5("context").alias("context_md5"), "context_id")
)
R.add("token_budget_prefix", f"""SELECT doc_id, source, running_cost FROM (SELECT doc_id, source, sum(t) OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_cost
  FROM (SELECT doc_id, source, n_chars, len({WORDS('text')}) AS t FROM documents)) WHERE running_cost <= 20000""")(
    lambda s, d: chunking.token_budget(table(s, d, "documents").select("doc_id", "source", "n_chars", fr.n_tokens(F.col("text")).alias("t")), ["source"], [F.desc_nulls_last("n_chars"), "doc_id"], "t", 20000, True).select("doc_id", "source", "running_cost")
)
_FULL = "(r.total + o.t > 50000 OR r.items >= 512)"
R.add("greedy_batches", f"""WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY chunk_id) AS n, chunk_id, len({WORDS('text')})::BIGINT AS t FROM text_chunks), r(n, chunk_id, b, total, items) AS (SELECT n, chunk_id, 0::BIGINT, t, 1 FROM o WHERE n = 1
  UNION ALL SELECT o.n, o.chunk_id, r.b + CASE WHEN {_FULL} THEN 1 ELSE 0 END, CASE WHEN {_FULL} THEN o.t ELSE r.total + o.t END, CASE WHEN {_FULL} THEN 1 ELSE r.items + 1 END FROM r JOIN o ON o.n = r.n + 1) SELECT chunk_id, '0' AS batch_shard, b AS batch_no FROM r""")(lambda s, d: chunking.greedy_batches(table(s, d, "text_chunks").select("chunk_id", "document_id", fr.n_tokens(F.col("text")).alias("t")), "chunk_id", "t", 50_000, 512).select("chunk_id", "batch_shard", "batch_no"))

R.add("entity_mentions", f"""SELECT doc_id, name, 'ent-' || md5(name) AS entity_id FROM {NAMES}""")(
    lambda s, d: extract.regex_entities(table(s, d, "documents"), "doc_id", "text").select("doc_id", "name", fr.prefixed_id("ent", F.col("name")).alias("entity_id"))
)
R.add("entity_topk", f"""SELECT name, count(*) AS mentions FROM {NAMES} GROUP BY name ORDER BY mentions DESC, name LIMIT 20""")(
    lambda s, d: extract.regex_entities(table(s, d, "documents"), "doc_id", "text").groupBy("name").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(20)
)
R.add("snippet_tokens_query_overlap", f"""WITH t AS (SELECT answer_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP}))) AS q,
  list_distinct(list_filter(regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP}))) AS a FROM answers)
  SELECT answer_id, len(q)::BIGINT AS query_tokens, len(list_intersect(q, a))::BIGINT AS shared, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, a)) / len(q), 9) END AS coverage,
  CASE WHEN len(list_distinct(list_concat(q, a))) > 0 THEN round(len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a))), 9) END AS jaccard FROM t""")(
    lambda s, d: extract.coverage(table(s, d, "answers"), "answer_id", "query", "answer")
)
R.add("query_snippets")(lambda s, d: table(s, d, "answers").select("answer_id", fr.query_snippet(F.col("answer"), F.col("query"), 240).alias("snippet")))
R.add("first_sentences", f"""SELECT doc_id, CASE WHEN len(p) > 0 THEN array_to_string(p[1:2], '. ') || '.' ELSE '' END AS lead
  FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: {TRIM('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)""")(
    lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", fr.first_sentences(F.col("text"), 2).alias("lead"))
)

_REC = """(SELECT doc_id, pos, regexp_extract(r, '\\((.*)\\)', 1) AS body FROM (SELECT doc_id, unnest(string_split(replace(text, '<|COMPLETE|>', '##'), '##')) AS r, generate_subscripts(string_split(replace(text, '<|COMPLETE|>', '##'), '##'), 1) AS pos FROM documents WHERE contains(text, '<|>')))"""
R.add("record_parse_entities", f"""SELECT doc_id, pos::BIGINT AS pos, upper({TRIM('p[2]')}) AS entity_name, upper({TRIM('p[3]')}) AS entity_type, md5({TRIM('p[4]')}) AS description_md5
  FROM (SELECT doc_id, pos, string_split(body, '<|>') AS p FROM {_REC}) WHERE len(p) >= 4 AND {TRIM('p[1]')} = '"entity"' AND {TRIM('p[2]')} <> ''""")(
    lambda s, d: extract.parse_entities(table(s, d, "documents"), "doc_id", "text", unescape=False).select("doc_id", "pos", "entity_name", "entity_type", F.md5("description").alias("description_md5"))
)
R.add("record_parse_relations", f"""SELECT doc_id, pos::BIGINT AS pos, upper({TRIM('p[2]')}) AS src_id, upper({TRIM('p[3]')}) AS tgt_id,
  CASE WHEN regexp_matches({TRIM('p[len(p)]')}, '^[-+]?[0-9]*\\.?[0-9]+$') THEN {TRIM('p[len(p)]')}::DOUBLE ELSE 1.0 END AS weight
  FROM (SELECT doc_id, pos, string_split(body, '<|>') AS p FROM {_REC}) WHERE len(p) >= 5 AND {TRIM('p[1]')} = '"relationship"'""")(
    lambda s, d: extract.parse_relations(table(s, d, "documents"), "doc_id", "text", unescape=False).select("doc_id", "pos", "src_id", "tgt_id", "weight")
)
R.add("sections_tokens", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
  h AS (SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, '^#+ ') THEN regexp_replace(line, '^#+ ', '') END AS head FROM l),
  f AS (SELECT doc_id, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section, CASE WHEN head IS NULL THEN len({WORDS('line')}) ELSE 0 END AS n FROM h)
  SELECT doc_id, coalesce(section, '') AS section, sum(n)::BIGINT AS tokens FROM f GROUP BY 1, 2""")(
    lambda s, d: extract.section_tokens(table(s, d, "documents"), "doc_id", "text")
)
R.add("csv_context_rows", f"""SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS id,
  (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::VARCHAR || ',' || chr(9) || '"' || {TRIM("coalesce(lang, '')")} || '"' AS line FROM documents WHERE source IS NOT NULL""")(
    lambda s, d: table(s, d, "documents").filter("source IS NOT NULL").select("source", "lang", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("bigint").alias("id")).select("source", "id", fr.csv_row(fr.csv_cell(F.col("id"), True), fr.csv_cell(F.col("lang"))).alias("line"))
)
R.add("vector_content", """SELECT doc_id, 'chunk-' || md5(text) AS chunk_id, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL""")(
    lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", fr.prefixed_id("chunk", F.col("text")).alias("chunk_id"), fr.text_hash(F.col("text")).alias("text_hash"))
)
R.add("custom_ids", """SELECT delivery_id, replace(replace(run_id, '|', '_'), ' ', '_') || '|' || coalesce(query_id, -1)::VARCHAR || '|' || replace(replace(coalesce(variant, ''), '|', '_'), ' ', '_') AS built,
  string_split(custom_id, '|')[1] AS stage, CASE WHEN len(string_split(custom_id, '|')) >= 3 THEN string_split(custom_id, '|')[2] END AS query_part FROM retrieval_trace_metrics WHERE custom_id IS NOT NULL""")(
    lambda s, d: table(s, d, "retrieval_trace_metrics").filter("custom_id IS NOT NULL").select("delivery_id", fr.custom_id(F.col("run_id"), F.coalesce("query_id", F.lit(-1)), F.coalesce("variant", F.lit(""))).alias("built"), F.get(F.split("custom_id", r"\|"), F.lit(0)).alias("stage"), F.when(F.size(F.split("custom_id", r"\|")) >= 3, F.get(F.split("custom_id", r"\|"), F.lit(1))).alias("query_part"))
)

R.add("chunk_entity_names", f"""SELECT doc_id, md5(string_agg(n, '|' ORDER BY i)) AS names FROM (SELECT doc_id, n, min(i) AS i FROM (SELECT doc_id, unnest(x) AS n, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{ENT}') AS x FROM documents)) WHERE n NOT IN ({ENT_STOP}) GROUP BY 1, 2) GROUP BY 1""")(
    lambda s, d: extract.chunk_entities(extract.regex_entities(table(s, d, "documents"), "doc_id", "text"), "doc_id").select("doc_id", F.md5(F.array_join("names", "|")).alias("names"))
)
