"""The driver tables mapped to lineage data, the registered queries and their SQL."""

from edgeloom.workload.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
