"""Document-quality analytics expressed as Spark DataFrame jobs."""
