"""Structured Streaming forms of the scans and of the job store."""
