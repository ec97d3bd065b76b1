"""Chat-log analytics expressed as Spark DataFrame operations."""
