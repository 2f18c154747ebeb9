"""Earthquake catalogue analytics as Spark DataFrame jobs."""
