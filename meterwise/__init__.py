"""Spark-first analytics for hourly and quarter-hourly energy series."""
