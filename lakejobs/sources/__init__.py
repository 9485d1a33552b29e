"""Reading and writing tables, JSON records and JDBC tables."""
