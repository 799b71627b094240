"""Structured Streaming variants of the log and scoring jobs."""
