"""Independent DuckDB SQL for every relational query (the correctness oracle)."""
