"""Tabular and time-series analytics as DataFrame operations on Spark."""
