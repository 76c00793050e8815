"""All core queries and their SQL."""

from __future__ import annotations

from banyan.plans import base, core_problems
from banyan.plans import conform_queries, graph_queries, hybrid_queries, nested_queries, retrieval_queries, scalar_queries, source_queries, stream_queries, union_queries  # noqa: F401  registers queries

QUERIES = {**core_problems.QUERIES, **base.QUERIES}
SQL = {**core_problems.SQL, **base.SQL}
