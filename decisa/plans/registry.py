"""All queries of the library by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from decisa.plans import corpus_queries, eval_queries, file_queries, more_queries, panel_queries, record_queries, relational_queries, replay_queries, round_queries  # noqa: F401
from decisa.plans.base import ORACLES, QUERIES

FLAGSHIP = "pit_asof_decile_spread"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
