"""Spark-first analytics over dated documents and market-style time series."""
