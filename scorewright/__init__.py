"""Benchmark analytics on Spark."""
