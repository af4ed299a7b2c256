"""All queries of the library and their oracle SQL."""

from __future__ import annotations

from loomgraph.plans import evaluation, general, graph, index, retrieval, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "mode_hi_local"
for _m in (general, text, graph, evaluation, index, retrieval):
    QUERIES |= _m.R.queries
    ORACLES |= _m.R.oracles
