"""Hybrid retrieval and memory analytics on Spark."""
