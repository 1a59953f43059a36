"""Tallywell: auditable metrics, data quality and experiment statistics on PySpark."""
