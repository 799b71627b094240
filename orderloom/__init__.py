"""Marketplace order and review analytics as PySpark jobs."""
