"""Column expressions and Arrow UDF factories."""
