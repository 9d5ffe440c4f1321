"""Queries over the driver's tables, and jobs."""
