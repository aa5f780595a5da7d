"""Ravelin: a Spark-first engine for security and operational event analytics."""
