"""Column functions: every one takes and returns Spark columns and stays in the JVM."""
