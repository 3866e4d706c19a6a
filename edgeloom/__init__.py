"""Lineage metadata on Spark: ingest of dependency events, and questions on the tables they build."""
