"""Audit-log anomaly analytics as Spark jobs."""
