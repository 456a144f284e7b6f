"""Column functions: Column in, Column out, all built from native Spark expressions."""
