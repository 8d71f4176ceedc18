"""Registered queries: each Spark plan sits next to its DuckDB twin."""
