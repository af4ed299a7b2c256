"""Queries of the llm operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.llm import consensus, mixing, neardup, pairs, ranking, repetition, splitting, tokenizing
from loomgraph.plans.registry import Registry
from loomgraph.session import table

R = Registry()
_P4 = ("human_annotation_pairwise_vs_hi", "core7_consolidated_results", "variant_catalog")

_WORDS = r"regexp_extract_all(lower({}), '[\pL\pN]+')"
_FOLD = lambda c: rf"regexp_replace(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '[-\s\p{{Z}}]', '_', 'g')"
_P4_VOTES = f"""WITH p AS (SELECT packet_id, {_FOLD('baseline_variant')} AS x, {_FOLD('other_variant')} AS y, {_FOLD('human_preferred_variant')} AS pref, lower(trim(human_outcome)) AS h, lower(trim(llm_strict_outcome)) AS l FROM human_annotation_pairwise_vs_hi),
  k AS (SELECT x, y, pref, h, l FROM p WHERE packet_id IS NULL UNION ALL SELECT x, y, pref, h, l FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY x NULLS FIRST, y NULLS FIRST, pref NULLS FIRST, h NULLS FIRST, l NULLS FIRST) AS n FROM p WHERE packet_id IS NOT NULL) WHERE n = 1),
  v AS (SELECT x, y, 'human' AS source, CASE WHEN pref = x THEN 0.0 WHEN pref = y THEN 1.0 WHEN pref = 'tie' THEN 0.5 WHEN h = 'other_win' THEN 1.0 WHEN h = 'baseline_win' THEN 0.0 WHEN h = 'tie' THEN 0.5 END::DOUBLE AS w FROM k
    UNION ALL SELECT x, y, 'llm', CASE l WHEN 'other_win' THEN 1.0 WHEN 'baseline_win' THEN 0.0 WHEN 'tie' THEN 0.5 END::DOUBLE FROM k),
  u AS (SELECT x, y, source, 1 - w AS wx, w AS wy FROM v UNION ALL SELECT {_FOLD('variant')}, {_FOLD('baseline')}, 'judge', greatest(coalesce(raw_wins_vs_hi, 0), 0) + greatest(coalesce(raw_ties, 0), 0) / 2, greatest(coalesce(raw_losses_vs_hi, 0), 0) + greatest(coalesce(raw_ties, 0), 0) / 2 FROM core7_consolidated_results),
  c AS (SELECT {_FOLD('variant')} AS n FROM variant_catalog)
  SELECT least(x, y) AS a, greatest(x, y) AS b, source, sum(CASE WHEN x > y THEN wy ELSE wx END) AS wins_a, sum(CASE WHEN x > y THEN wx ELSE wy END) AS wins_b FROM u WHERE wx IS NOT NULL AND x <> y AND x IN (SELECT n FROM c) AND y IN (SELECT n FROM c) GROUP BY 1, 2, 3 HAVING sum(wx + wy) > 0"""
_P6 = f"""WITH t AS (SELECT context_id, {_WORDS.format('context')} AS w FROM unique_contexts WHERE context IS NOT NULL), s AS (SELECT context_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 30),
  m AS (SELECT context_id, len(s) AS n, unnest(s) AS x FROM s) SELECT a.context_id AS context_id_a, b.context_id AS context_id_b FROM m a JOIN m b ON a.x = b.x AND a.context_id < b.context_id GROUP BY 1, 2 HAVING count(*) >= 0.6::DOUBLE * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9"""
_P10 = f"""WITH r AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS r FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 5)
  SELECT doc_id FROM r WHERE 1 - len(list_distinct(r)) / len(r) >= 0.3::DOUBLE - 1e-12"""
#: The least-squares strengths by damped Jacobi steps in SQL: slower, but the same solution.
_P4_FIT = f"""WITH RECURSIVE vo AS MATERIALIZED ({_P4_VOTES}), e0 AS (SELECT a, b, sum(wins_a) + 0.5 AS p, sum(wins_b) + 0.5 AS q FROM vo GROUP BY 1, 2), e AS MATERIALIZED (SELECT a, b, ln(p / q) AS y, p * q / (p + q) AS w, p + q - 1 AS n FROM e0 UNION ALL SELECT b, a, ln(q / p), p * q / (p + q), p + q - 1 FROM e0),
  it AS (SELECT DISTINCT {_FOLD('variant')} AS item FROM variant_catalog WHERE variant IS NOT NULL), d AS MATERIALIZED (SELECT a, sum(w) + 0.05 AS deg, sum(w * y) AS rhs, sum(n) AS votes, count(*) AS opponents FROM e GROUP BY 1),
  r(t, item, s) AS (SELECT 0, a, 0.0::DOUBLE FROM d UNION ALL SELECT any_value(r.t) + 1, r.item, 0.5 * any_value(r.s) + 0.5 * (any_value(d.rhs) + sum(e.w * o.s)) / any_value(d.deg) FROM r JOIN d ON d.a = r.item JOIN e ON e.a = r.item JOIN r o ON o.item = e.b WHERE r.t < 5000 GROUP BY r.item),
  z AS (SELECT item, coalesce((SELECT s FROM r WHERE r.item = it.item AND t = 5000), 0) AS s FROM it), c AS (SELECT item, s - (SELECT avg(s) FROM z) AS strength FROM z),
  f AS (SELECT item AS variant, row_number() OVER (ORDER BY round(strength, 4) DESC, item)::INTEGER AS rank_pos, round(strength, 4) AS strength, coalesce(votes, 0) AS n_votes, coalesce(opponents, 0) AS n_opponents FROM c LEFT JOIN d ON d.a = item)"""
_P6_CLASSES = f"""WITH f AS MATERIALIZED ({_P6}), w AS (SELECT context_id AS id, {_WORDS.format('context')} AS w FROM unique_contexts), k AS (SELECT id, CASE WHEN len(w) >= 30 THEN min(id) OVER (PARTITION BY CASE WHEN len(w) >= 30 THEN w END) END AS class_id FROM w),
  l AS (SELECT x, count(*) AS n FROM (SELECT context_id_a AS x FROM f UNION ALL SELECT context_id_b FROM f) GROUP BY 1) SELECT id, class_id, coalesce(n, 0) AS n_links FROM k LEFT JOIN l ON x = id"""

R.add("p2_found")(lambda s, d: pairs.found(table(s, d, "answers"), table(s, d, "documents")))
R.add("p4_found", f"{_P4_FIT} SELECT variant, rank_pos FROM f")(lambda s, d: ranking.rank(*(table(s, d, n) for n in _P4)).select("variant", "rank_pos"))
R.add("p4_votes", _P4_VOTES)(lambda s, d: ranking.votes(*(table(s, d, n) for n in _P4)))
R.add("p4_strengths", f"{_P4_FIT} SELECT * FROM f")(lambda s, d: ranking.rank(*(table(s, d, n) for n in _P4)).drop("residual").withColumn("strength", F.round("strength", 4)))
R.add("p4_residual")(lambda s, d: ranking.rank(*(table(s, d, n) for n in _P4)).select("residual").distinct())
R.add("p4_inconsistency")(lambda s, d: ranking.inconsistency(*(table(s, d, n) for n in _P4)))
R.add("p5_found")(lambda s, d: consensus.found(table(s, d, "human_annotation_enriched_long")))
R.add("p5_packets")(lambda s, d: consensus.packets(table(s, d, "human_annotation_enriched_long")))
R.add("p5_annotators")(lambda s, d: consensus.annotators(table(s, d, "human_annotation_enriched_long")))
R.add("p6_found", _P6)(lambda s, d: neardup.found(table(s, d, "unique_contexts")))
R.add("p6_classes", _P6_CLASSES)(lambda s, d: neardup.classes(table(s, d, "unique_contexts")))
R.add("p7_found", "SELECT chunk_id FROM text_chunks WHERE length(text) > 1200")(lambda s, d: splitting.found(table(s, d, "text_chunks")))
R.add("p7_pieces")(lambda s, d: splitting.pieces(table(s, d, "text_chunks")))
R.add("p8_ids")(lambda s, d: tokenizing.encode(table(s, d, "documents")))
R.add("p9_shares")(lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[1])
R.add("p9_exact_shares")(lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"), exact=True)[1])
R.add("p9_documents")(lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[0])
R.add("p10_found", _P10)(lambda s, d: repetition.found(table(s, d, "documents")))
R.add("p10_by_content")(lambda s, d: repetition.by_content(table(s, d, "documents")))
R.add("p10_documents")(lambda s, d: repetition.retention(table(s, d, "documents")))

QUERIES, ORACLES = R.queries, R.oracles
