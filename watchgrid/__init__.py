"""Spark-first analytics for the oversight of self-updating agents."""
