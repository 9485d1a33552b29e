"""Column expressions. All of them are built from native Spark functions."""
