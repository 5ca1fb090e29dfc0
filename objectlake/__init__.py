"""objectlake: governed object analytics as Spark DataFrame jobs."""
