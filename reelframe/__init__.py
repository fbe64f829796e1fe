"""Media-operations analytics as DataFrame, SQL and Structured Streaming jobs."""
