"""DuckDB oracle SQL for every registered query (verification only)."""
