"""Point-in-time analytics on two-sided event data, expressed as Spark DataFrame operators."""
