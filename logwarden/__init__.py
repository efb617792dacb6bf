"""Access-log abuse detection and training-data operators as Spark jobs."""
