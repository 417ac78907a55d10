"""Independent SQL for the registered queries, for DuckDB."""
