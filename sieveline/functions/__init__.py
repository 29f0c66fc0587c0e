"""Column expressions: everything here takes and returns Spark columns and runs in the JVM."""
