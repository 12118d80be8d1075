"""Batch analytics for security-operations triage data, written as Spark jobs."""
