"""Document and project analytics on Spark."""
