"""DuckDB SQL for each registered query, for checking results on the same tables."""
