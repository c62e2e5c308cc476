from methmix.workloads import atlas_queries, mixture_queries, table_queries  # noqa: F401  (register the queries)
from methmix.workloads.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
