"""Column functions: native expressions first, pandas UDFs where Spark has no built-in."""
