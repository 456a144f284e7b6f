"""Registered queries: Spark job and, where SQL can say the same, its DuckDB twin."""
