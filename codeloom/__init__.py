"""Source-code corpus analytics as PySpark DataFrame jobs."""
