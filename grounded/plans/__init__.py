"""Registered queries (Spark builders) and their DuckDB oracle SQL."""
