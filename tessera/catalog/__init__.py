"""Queries of the library, by family, each with its DuckDB statement where SQL can express it."""
