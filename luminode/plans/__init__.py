"""Queries of the library's operators over the given tables, each beside the SQL that gives its rows."""

from luminode.plans import q_functions, q_joins, q_sources, q_summaries
from luminode.plans.base import ORACLE_SQL, QUERIES
from luminode.plans.design import best_probes

__all__ = ["ORACLE_SQL", "QUERIES", "best_probes", "q_functions", "q_joins", "q_sources", "q_summaries"]
