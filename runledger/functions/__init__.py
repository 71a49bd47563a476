"""Column expressions. Every function takes and returns a Column; none is a UDF."""
