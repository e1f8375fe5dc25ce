"""Document and event analytics expressed as Spark DataFrame functions."""
