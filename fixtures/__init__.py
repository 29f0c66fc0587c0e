"""Source files derived from the given tables, the same in Spark and in SQL."""
