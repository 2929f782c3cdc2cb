"""Queries of the library's own operators, and DuckDB SQL for them."""

from __future__ import annotations

from presswire.plans import q_aggregates, q_functions, q_graph, q_joins, q_pages, q_ranking, q_results, q_streaming, q_trends

_REGISTRIES = [q_functions.R, q_joins.R, q_aggregates.R, q_ranking.R, q_graph.R, q_trends.R, q_pages.R, q_results.R, q_streaming.R]
QUERIES = {k: v for r in _REGISTRIES for k, v in r.queries.items()}
ORACLE = {k: v for r in _REGISTRIES for k, v in r.oracles.items()}
FLAGSHIP = "w17_rank_pipeline"
