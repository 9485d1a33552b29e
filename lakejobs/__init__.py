"""PySpark jobs over shared, partitioned tables."""
