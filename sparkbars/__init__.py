"""Time-series and event-log jobs for Spark."""
