"""Compliance screening as set-at-a-time Spark jobs."""
